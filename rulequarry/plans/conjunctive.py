"""Conjunctive queries: occurrences of tables, equalities between their columns, a projection.

One representation serves counting, existence tests, the miner and the audit. Plans are DataFrame joins. Three rewrites
that the optimizer does not make are made here: every occurrence is reduced to the distinct rows of the columns that
the query needs before it is joined, and where the projection lies in one occurrence of an acyclic query the others
are folded in by semi-joins, so no intermediate result outgrows a table. Of a primary key that is asked for only
because occurrences must differ in it, one more value than there are others to differ from tells as much as all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, permutations, product
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulequarry.catalog import Catalog

Occurrence = tuple[str, int]
Term = tuple[str, int, str]

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


@dataclass(frozen=True)
class Query:
    """disjoint: two occurrences of a table must differ in its primary key; without a key nothing does."""

    occurrences: tuple[Occurrence, ...]
    equalities: tuple[tuple[Term, Term], ...] = ()
    project: tuple[Term, ...] = ()
    disjoint: bool = False

    def key(self) -> tuple:
        """Equal for queries that differ in the order of their parts only."""
        return tuple(sorted(self.occurrences)), tuple(sorted(tuple(sorted(e)) for e in self.equalities)), tuple(sorted(set(self.project))), self.disjoint


def _name(term: Term) -> str:
    return f"{term[0]}_{term[1]}__{term[2]}"


def _classes(query: Query) -> list[frozenset[Term]]:
    """The equality classes, closed under transitivity."""
    parent: dict[Term, Term] = {}

    def root(t: Term) -> Term:
        parent.setdefault(t, t)
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in query.equalities:
        parent[root(a)] = root(b)
    out: dict[Term, set[Term]] = defaultdict(set)
    for t in list(parent):
        out[root(t)].add(t)
    return [frozenset(c) for c in out.values()]


class Planner:
    """Plans for the queries over one catalog."""

    def __init__(self, catalog: Catalog, semijoins: bool = True):
        self.catalog, self.semijoins = catalog, semijoins

    def _equal(self, a: Term, b: Term) -> Column:
        """Equality; columns of unlike types are compared as text, so no cast can fail."""
        x, y = F.col(f"`{_name(a)}`"), F.col(f"`{_name(b)}`")
        kinds = self.catalog.domain(a[0], a[2]), self.catalog.domain(b[0], b[2])
        if kinds[0] == kinds[1] or all(k.startswith(NUMBERS) for k in kinds):
            return x == y
        return x.cast("string") == y.cast("string")

    def _differ(self, table: str, i: int, j: int) -> Column:
        pairs = [F.col(f"`{_name((table, i, c))}`") != F.col(f"`{_name((table, j, c))}`") for c in self.catalog.primary_keys.get(table, ())]
        return reduce(lambda a, b: a | b, pairs) if pairs else F.lit(False)

    def _repeated(self, query: Query) -> list[tuple[str, int, int]]:
        by_table: dict[str, list[int]] = defaultdict(list)
        for t, j in query.occurrences:
            by_table[t].append(j)
        return [(t, i, j) for t, js in by_table.items() for i, j in combinations(js, 2)] if query.disjoint else []

    def _scan(self, query: Query, occurrence: Occurrence, apart: list, distinct: bool) -> DataFrame:
        table, j = occurrence
        terms = {t for e in query.equalities for t in e} | set(query.project)
        own = {t[2] for t in terms if t[:2] == occurrence}
        others = sum(t == table and j in (a, b) for t, a, b in apart)
        columns = own | set(self.catalog.primary_keys.get(table, ()) if others else ())
        kept = tuple(c for c in self.catalog.columns(table) if c in columns)
        if missing := columns - set(kept):
            raise ValueError(f"unknown column {table}.{sorted(missing)[0]}")
        key = columns - own
        if distinct and len(key) == 1 == len(self.catalog.primary_keys[table]):
            df = self.catalog.differing(table, tuple(c for c in kept if c in own), *key, others)
        elif distinct and kept:
            df = self.catalog.distinct(table, kept)
        else:
            df = self.catalog.tables[table].select(*[F.col(f"`{c}`") for c in kept])
            if distinct:
                df = df.limit(1)  # nothing of the occurrence is asked but that it has a row
        df = df.select(*[F.col(f"`{c}`").alias(_name((table, j, c))) for c in kept])
        for a, b in query.equalities:
            if a[:2] == b[:2] == occurrence and a != b:
                df = df.where(self._equal(a, b))
        return df

    def _join_terms(self, query: Query, left: set[Occurrence], right: Occurrence) -> list[tuple[Term, Term]]:
        """One equality for each class that both sides hold, and all within the newcomer."""
        out = []
        for c in _classes(query):
            a = sorted(t for t in c if t[:2] in left)
            b = sorted(t for t in c if t[:2] == right)
            if a and b:
                out.append((a[0], b[0]))
        return out

    def _impossible(self, query: Query) -> bool:
        """Whether two occurrences must differ that cannot: no primary key tells them apart, or all of it is set equal.

        Classes of several types are left to the data: a number compared with one of another type may equal two.
        """
        groups = [c for c in _classes(query) if len({self.catalog.domain(t[0], t[2]) for t in c}) == 1]
        same = lambda a, b: any(a in c and b in c for c in groups)
        return any(all(same((t, i, c), (t, j, c)) for c in self.catalog.primary_keys.get(t, ())) for t, i, j in self._repeated(query))

    def _tree(self, query: Query, apart: list) -> list[tuple[Occurrence, Occurrence]] | None:
        """(leaf, neighbour) in the order in which leaves may be folded into the projection's occurrence, or None."""
        homes = {t[:2] for t in query.project}
        if len(homes) != 1 or len(query.occurrences) < 2:
            return None
        (home,) = homes
        held: dict[Occurrence, set[int]] = {o: set() for o in query.occurrences}
        for n, c in enumerate(_classes(query)):
            for t in c:
                held[t[:2]].add(n)
        left, out = list(query.occurrences), []
        while len(left) > 1:
            for leaf in left:
                if leaf == home:
                    continue
                others = [o for o in left if o != leaf]
                shared = {n for n in held[leaf] if any(n in held[o] for o in others)}
                partners = {(t, b if (t, a) == leaf else a) for t, a, b in apart if leaf in ((t, a), (t, b))}
                gone = {x for x, _ in out}
                near = [o for o in others if (shared or partners) and shared <= held[o] and partners <= {o} and not partners & gone]
                if near:
                    out.append((leaf, home if home in near else near[0]))
                    left.remove(leaf)
                    break
            else:
                return None
        return out

    @staticmethod
    def _complete(query: Query) -> Query:
        """The query with every occurrence that its terms name, each part once."""
        named = {o for e in query.equalities for o in (e[0][:2], e[1][:2])} | {t[:2] for t in query.project}
        return Query(tuple(dict.fromkeys((*query.occurrences, *sorted(named - set(query.occurrences))))), query.equalities, tuple(dict.fromkeys(query.project)), query.disjoint)

    def rows(self, query: Query, distinct: bool = True) -> DataFrame:
        """The projected rows, each once; with distinct=False one for every match."""
        if not query.occurrences:
            raise ValueError("a query needs an occurrence")
        query = self._complete(query)
        apart = self._repeated(query)
        reduced = distinct and bool(query.project)
        order = self._tree(query, apart) if reduced and self.semijoins else None
        # In a chain of semi-joins repeats do no harm, so only the leaves, which are shuffled whole, are reduced first.
        inner = {near for _, near in order} if order is not None else set()
        scans = {o: self._scan(query, o, apart, reduced and o not in inner) for o in query.occurrences}
        if order is not None:
            for leaf, near in order:
                on = [self._equal(a, b) for a, b in self._join_terms(query, {near}, leaf)]
                on += [self._differ(t, i, j) for t, i, j in apart if {(t, i), (t, j)} == {leaf, near}]
                scans[near] = scans[near].join(scans[leaf], reduce(lambda a, b: a & b, on), "left_semi")
            out = scans[query.project[0][:2]]
        else:
            waiting = list(query.occurrences)
            first = next((o for o in waiting if query.project and o == query.project[0][:2]), waiting[0])
            waiting.remove(first)
            out, joined = scans[first], {first}
            while waiting:
                linked = next((o for o in waiting if self._join_terms(query, joined, o)), None)
                o = linked or waiting[0]
                on = [self._equal(a, b) for a, b in self._join_terms(query, joined, o)]
                on += [self._differ(t, i, j) for t, i, j in apart if o in ((t, i), (t, j)) and {(t, i), (t, j)} - {o} <= joined]
                out = out.join(scans[o], reduce(lambda a, b: a & b, on)) if on else out.crossJoin(scans[o])
                waiting.remove(o)
                joined.add(o)
        if not query.project:
            return out
        out = out.select(*[F.col(f"`{_name(t)}`") for t in query.project])
        return out.distinct() if distinct else out

    def count(self, query: Query, distinct: bool = True) -> DataFrame:
        """One row `n`. Without a projection every match counts; null counts as a value.

        Distinct rows over occurrences that nothing links are counted apart and multiplied, never crossed.
        """
        parts = self._unlinked(query) if distinct and query.project else [query]
        if len(parts) < 2:
            return self.rows(query, distinct).agg(F.count("*").alias("n"))
        out = None
        for part in parts:
            one = (self.rows(part) if part.project else self.rows(part, False).limit(1)).agg(F.count("*").alias("m"))
            out = one.select(F.col("m").alias("n")) if out is None else out.crossJoin(one).select((F.col("n") * F.col("m")).alias("n"))
        return out

    def _unlinked(self, query: Query) -> list[Query]:
        """The query's parts that share no equality and no disjointness; itself if all its occurrences are linked."""
        terms = [t for e in query.equalities for t in e] + list(query.project)
        occurrences = tuple(dict.fromkeys((*query.occurrences, *(t[:2] for t in terms))))
        group = {o: {o} for o in occurrences}
        pairs = [(a[:2], b[:2]) for a, b in query.equalities]
        if query.disjoint:
            pairs += [(o, u) for i, o in enumerate(occurrences) for u in occurrences[i + 1 :] if o[0] == u[0]]
        for a, b in pairs:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for o in group[b]:
                    group[o] = group[a]
        own = list({id(g): g for g in group.values()}.values())
        if len(own) < 2:
            return [query]
        return [Query(tuple(o for o in occurrences if o in g), tuple(e for e in query.equalities if e[0][:2] in g), tuple(t for t in query.project if t[:2] in g), query.disjoint) for g in own]

    def count_now(self, query: Query, distinct: bool = True) -> int:
        return self.count(query, distinct).first()["n"] if query.occurrences else 0

    def exceeds(self, query: Query, threshold: int) -> bool:
        """Whether there are more than `threshold` matches; no more are fetched than that takes."""
        if not query.occurrences:
            return False
        if threshold < 0:
            return self.count_now(query, distinct=bool(query.project)) > threshold
        return self.rows(query, distinct=bool(query.project)).limit(threshold + 1).count() > threshold

    def _uniform(self, query: Query) -> list[frozenset[Term]] | None:
        """The equality classes if each holds columns of one type only: what is equal then stands for each other."""
        groups = _classes(query)
        return groups if all(len({self.catalog.domain(t[0], t[2]) for t in c}) == 1 for c in groups) else None

    def _moved(self, query: Query) -> Query:
        """The query with its projection in one occurrence, if equal columns allow it and its joins can be folded there."""
        groups = self._uniform(query)
        if not groups or not query.project:
            return query
        options = list(dict.fromkeys(next((c for c in groups if t in c), frozenset((t,))) for t in query.project))
        homes = []
        for o in dict.fromkeys(query.occurrences):
            own = tuple(sorted(min(x) for c in options if (x := [t for t in c if t[:2] == o])))
            if len(own) == len(options):
                key = self.catalog.primary_keys.get(o[0])
                homes.append((not key or not set(key) <= {t[2] for t in own}, o, own))
        for _, _, own in sorted(homes):
            moved = Query(query.occurrences, query.equalities, own, query.disjoint)
            if len(query.occurrences) == 1 or self._tree(moved, self._repeated(moved)):
                return moved
        return Query(query.occurrences, query.equalities, tuple(sorted(map(min, options))), query.disjoint)

    def _form(self, query: Query) -> tuple:
        """Equal for queries of equal counts that differ in order, in the numbers of occurrences or by equal columns."""
        groups = self._uniform(query)
        if groups is None:
            return query.key()
        by_table: dict[str, list[int]] = defaultdict(list)
        for t, j in dict.fromkeys(query.occurrences):
            by_table[t].append(j)

        def written(numbers: dict[Occurrence, int]) -> tuple:
            new = lambda t: (t[0], numbers[t[:2]], t[2])
            wanted = [next((c for c in groups if t in c), (t,)) for t in query.project]
            return sorted(tuple(sorted(map(new, c))) for c in groups), sorted({tuple(sorted(map(new, c))) for c in wanted})

        ways = product(*(permutations(range(len(js))) for js in by_table.values()))
        least = min(written({(t, j): n for (t, js), way in zip(by_table.items(), chosen, strict=True) for j, n in zip(js, way, strict=True)}) for chosen in ways)
        return sorted((t, len(js)) for t, js in by_table.items()), *least, query.disjoint and max(map(len, by_table.values())) > 1

    def counts(self, queries: Sequence[Query], jobs: int = 8, known: dict[str, int] | None = None) -> list[int]:
        """The counts of many queries, `jobs` of them planned and run side by side; equal parts are counted once.

        known: counts of earlier calls over the same data, which are not made again; those of this call are added.
        """
        known = {} if known is None else known
        whole, ask = [], {}
        for q in queries:
            if not q.occurrences or self._impossible(q):
                whole.append(None)
                continue
            parts = []
            for part in self._unlinked(self._complete(q)) if q.project else [q]:
                part = self._moved(part)
                key = str((self._form(part), bool(q.project)))
                if key not in known:
                    ask.setdefault(key, (part, bool(q.project)))
                parts.append(key)
            whole.append(parts)
        with ThreadPoolExecutor(jobs) as pool:
            known.update(zip(ask, pool.map(lambda x: self._part(*x), ask.values()), strict=True))
        return [0 if parts is None else prod(known[k] for k in parts) for parts in whole]

    def _part(self, query: Query, projected: bool) -> int:
        """The count of a linked query; of one without a projection that is part of another, whether it has a row."""
        if projected and not query.project:
            return int(not self.rows(query, False).isEmpty())
        return self.count(query).first()["n"]


def join_count(planner: Planner, conditions: Sequence[tuple[str, int, str, str, int, str]], disjoint: bool = False, count_over: Sequence[Sequence[Term]] = ()) -> int:
    """Matches of a list of join conditions; with count_over, distinct values of each class's first member."""
    pairs = tuple(((a, i, x), (b, j, y)) for a, i, x, b, j, y in conditions)
    occurrences = tuple(dict.fromkeys(t[:2] for p in pairs for t in p))
    query = Query(occurrences, pairs, tuple(c[0] for c in count_over if c), disjoint)
    return planner.count_now(query, distinct=bool(count_over)) if occurrences else 0
