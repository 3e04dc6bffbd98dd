"""The search space of rules: which column occurrences may be equal, in which combinations, split how.

Everything here is about the schema; no data is touched. A candidate is a list of edges (pairs of column occurrences
that are set equal); its classes are its variables.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product
from typing import NamedTuple

from rulequarry.catalog import Catalog
from rulequarry.functions.relations import reference


class Place(NamedTuple):
    """Column `column` of occurrence `occurrence` of table number `table`."""

    table: int
    occurrence: int
    column: int

    @property
    def atom(self) -> tuple[int, int]:
        return self.table, self.occurrence


Edge = tuple[Place, Place]


class Names:
    """Numbers of tables (in sorted order) and columns, and back."""

    def __init__(self, catalog: Catalog):
        self.tables = catalog.table_names()
        self.columns = {t: catalog.columns(t) for t in self.tables}
        self._table = {t: i for i, t in enumerate(self.tables)}

    def place(self, table: str, occurrence: int, column: str) -> Place:
        return Place(self._table[table], occurrence, self.columns[table].index(column))

    def term(self, p: Place) -> tuple[str, int, str]:
        t = self.tables[p.table]
        return t, p.occurrence, self.columns[t][p.column]


def foreign_key_pairs(catalog: Catalog) -> list[tuple[tuple[str, str], tuple[str, str]]]:
    """Pairs of columns joined by a declared key, in the catalog's order."""
    order = {(t, c): (i, j) for i, t in enumerate(catalog.table_names()) for j, c in enumerate(catalog.columns(t))}
    pairs = {tuple(sorted(((k.table, k.column), (k.ref_table, k.ref_column)), key=order.__getitem__)) for k in catalog.foreign_keys}
    return sorted(pairs, key=lambda p: (order[p[0]], order[p[1]]))


def edges(names: Names, pairs: Iterable[tuple[tuple[str, str], tuple[str, str]]], occurrences: int, limits: dict[str, dict[str, int]] | None = None) -> list[Edge]:
    """All edges between occurrences of the joinable columns; a column's limit is the last occurrence it may have."""
    out, limits = set(), limits or {}
    for (t, c), (u, d) in pairs:
        for i, j in product(range(occurrences), repeat=2):
            if i <= limits.get(t, {}).get(c, occurrences) and j <= limits.get(u, {}).get(d, occurrences):
                out.add(tuple(sorted((names.place(t, i, c), names.place(u, j, d)))))
    return sorted(out)


class Graph:
    """Edges are adjacent if they share a table occurrence."""

    def __init__(self, edges: Iterable[Edge]):
        self.nodes = sorted(edges)
        self._by_atom: dict[tuple[int, int], set[Edge]] = defaultdict(set)
        for e in self.nodes:
            for p in e:
                self._by_atom[p.atom].add(e)

    def near(self, edge: Edge) -> set[Edge]:
        return set().union(*(self._by_atom[p.atom] for p in edge)) - {edge}

    def size(self) -> tuple[int, int]:
        """(nodes, adjacencies)."""
        return len(self.nodes), sum(len(self.near(e)) for e in self.nodes) // 2


def classes(path: Iterable[Edge]) -> list[tuple[Place, ...]] | None:
    """The equality classes of a path in order of their smallest place, or None if an edge says what others imply."""
    parent: dict[Place, Place] = {}

    def root(p: Place) -> Place:
        parent.setdefault(p, p)
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in path:
        x, y = root(a), root(b)
        if x == y:
            return None
        parent[max(x, y)] = min(x, y)
    out: dict[Place, list[Place]] = defaultdict(list)
    for p in parent:
        out[root(p)].append(p)
    return [tuple(sorted(out[r])) for r in sorted(out)]


@dataclass(frozen=True)
class Candidate:
    path: tuple[Edge, ...]
    classes: tuple[tuple[Place, ...], ...]

    @cached_property
    def atoms(self) -> list[tuple[int, int]]:
        return sorted({p.atom for c in self.classes for p in c})

    @cached_property
    def shape(self) -> dict[tuple[int, int], frozenset[tuple[int, int]]]:
        """Which columns of each atom take part."""
        out: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for c in self.classes:
            for p in c:
                out[p.atom].add((p.table, p.column))
        return {a: frozenset(s) for a, s in out.items()}


def _admissible(path: tuple[Edge, ...], max_atoms: int, max_classes: int) -> list[tuple[Place, ...]] | None:
    atoms: dict[int, set[int]] = defaultdict(set)
    for e in path:
        for p in e:
            atoms[p.table].add(p.occurrence)
    if sum(map(len, atoms.values())) > max_atoms or any(max(s) + 1 != len(s) for s in atoms.values()):
        return None
    found = classes(path)
    return found if found is not None and len(found) <= max_classes else None


def candidates(graph: Graph, max_atoms: int, max_classes: int) -> Iterator[Candidate]:
    """Every closure once, by the first path that a depth-first search over sorted edges finds for it."""
    seen: set[tuple] = set()

    def grow(path: tuple[Edge, ...]) -> Iterator[Candidate]:
        found = tuple(classes(path))
        if found in seen:
            return
        seen.add(found)
        yield Candidate(path, found)
        near = set().union(*(graph.near(e) for e in path)) - set(path)
        for e in sorted(near):
            if _admissible((*path, e), max_atoms, max_classes) is not None:
                yield from grow((*path, e))

    for e in graph.nodes:
        if _admissible((e,), max_atoms, max_classes) is not None:
            yield from grow((e,))


def horn_splits(c: Candidate) -> Iterator[tuple[tuple[tuple[int, int], ...], tuple[int, int]]]:
    """(body atoms, head atom): safe splits; of atoms alike in shape the first one stays in the body."""
    for head in c.atoms:
        body = tuple(a for a in c.atoms if a != head)
        if not body or any(a[0] == head[0] and head[1] < a[1] and c.shape[a] == c.shape[head] for a in body):
            continue
        if all(any(p.atom != head for p in cls) for cls in c.classes if any(p.atom == head for p in cls)):
            yield body, head


def horn_key(c: Candidate, head: tuple[int, int]) -> tuple:
    """Equal for rules that differ in the numbering of occurrences only; the head becomes occurrence 0.

    Atoms are told apart by what they are and, again and again, by the atoms that they share classes with. Where that
    leaves atoms of a table alike, each of them is told apart in turn and the smallest result stands.
    """

    def refined(mark: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
        while True:
            seen = {a: (a[0], mark[a], tuple(sorted((p.column, tuple(sorted((q.table, mark[q.atom], q.column) for q in cls))) for cls in c.classes for p in cls if p.atom == a))) for a in c.atoms}
            rank = {x: n for n, x in enumerate(sorted(set(seen.values())))}
            new = {a: rank[seen[a]] for a in c.atoms}
            if len(set(new.values())) == len(set(mark.values())):
                return new
            mark = new

    def written(mark: dict[tuple[int, int], int]) -> tuple:
        mark = refined(mark)
        alike = next((own for m in sorted(set(mark.values())) if len(own := [a for a in c.atoms if mark[a] == m]) > 1), None)
        if alike:
            return min(written({a: 2 * m + (a != one) for a, m in mark.items()}) for one in alike)
        places: dict[int, list] = defaultdict(list)
        for a in sorted(c.atoms, key=lambda a: (a != head, mark[a])):
            places[a[0]].append(a)
        new = {a: (t, n) for t, own in places.items() for n, a in enumerate(own)}
        form = tuple(sorted(tuple(sorted((*new[p.atom], p.column) for p in cls)) for cls in c.classes))
        return tuple(sorted(new[a] for a in c.atoms if a != head)), new[head], form

    return written({a: int(a != head) for a in c.atoms})


def display(c: Candidate, head: tuple[int, int], names: Names) -> str:
    """The rule as text: x for variables of both sides, y of the body, z of the head; atoms as the path meets them."""
    counts, variable = {"x": 0, "y": 0, "z": 0}, {}
    sides: dict[str, set[str]] = {"body": set(), "head": set()}
    for cls in c.classes:
        in_head, in_body = any(p.atom == head for p in cls), any(p.atom != head for p in cls)
        letter = "x" if in_head and in_body else "y" if in_body else "z"
        name = f"{letter}{counts[letter]}"
        counts[letter] += 1
        variable.update(dict.fromkeys(cls, name))
        for side, there in (("body", in_body), ("head", in_head)):
            if there:
                sides[side].add(name)
    terms: dict[tuple[int, int], dict[str, None]] = {}
    for e in c.path:
        for p in e:
            terms.setdefault(p.atom, {})[f"{names.term(p)[2]}={variable[p]}"] = None
    write = lambda a: f"{reference(names.tables[a[0]], a[1])}({', '.join(terms[a])})"
    body = " ∧ ".join(write(a) for a in terms if a != head)
    only_head = sides["head"] - sides["body"]
    left = f"∀ {', '.join(sorted(sides['body']))}: {body}" if sides["body"] and body else body or "⊤"
    right = f"∃ {', '.join(sorted(only_head))}: {write(head)}" if only_head else write(head)
    return f"{left} ⇒ {right}"
