"""Names of relations and rules as text: quoting, parsing, splitting outside quotes and parentheses."""

from __future__ import annotations

import re
from dataclasses import dataclass

_PLAIN = re.compile(r"[A-Za-z_]\w*")
_NUMBERED = re.compile(r"(?P<name>.*)_(?P<number>\d+)\Z", re.DOTALL)


def quote(name: str) -> str:
    """The name as it stands in rules: quoted unless it is a plain word that does not end like an occurrence."""
    if _PLAIN.fullmatch(name) and not _NUMBERED.match(name):
        return name
    return '"' + name.replace('"', '""') + '"'


def reference(table: str, occurrence: int) -> str:
    return f"{quote(table)}_{occurrence}"


def parse_reference(text: str) -> tuple[str, int]:
    """(table, occurrence) of a reference; a name without a number is occurrence 0."""
    text = text.strip()
    if text.startswith('"'):
        end, i = None, 1
        while i < len(text):
            if text[i] == '"' and text[i : i + 2] != '""':
                end = i
                break
            i += 2 if text[i] == '"' else 1
        if end is None:
            raise ValueError(f"unterminated_quote:{text}")
        name, rest = text[1:end].replace('""', '"'), text[end + 1 :]
        if rest and not re.fullmatch(r"_\d+", rest):
            raise ValueError(f"invalid_relation_reference:{text}")
        return name, int(rest[1:]) if rest else 0
    m = _NUMBERED.match(text)
    return (m["name"], int(m["number"])) if m and m["name"] else (text, 0)


def split_outside(text: str, marks: tuple[str, ...]) -> list[str]:
    """Splits at any of the marks outside double quotes and parentheses."""
    out, depth, quoted, at, i = [], 0, False, 0, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if not depth and (mark := next((m for m in marks if text.startswith(m, i)), None)):
                out.append(text[at:i])
                at = i = i + len(mark)
                continue
        i += 1
    return [*out, text[at:]]


def conjuncts(text: str) -> list[str]:
    return [x.strip() for x in split_outside(text, ("∧",)) if x.strip()]


def implication(text: str) -> tuple[str, str]:
    parts = split_outside(text, ("⇒", "=>"))
    if len(parts) != 2:
        raise ValueError("missing_or_ambiguous_implication")
    return parts[0].strip(), parts[1].strip()


@dataclass(frozen=True, order=True)
class Atom:
    """An occurrence of a table whose columns hold variables."""

    table: str
    occurrence: int
    terms: tuple[tuple[str, str], ...]

    def variables(self) -> set[str]:
        return {v for _, v in self.terms}

    def __str__(self) -> str:
        return f"{reference(self.table, self.occurrence)}({', '.join(f'{c}={v}' for c, v in self.terms)})"


def parse_atom(text: str) -> Atom:
    """`table_occurrence(column=variable, ...)`."""
    text, quoted = text.strip(), False
    for i, c in enumerate(text):
        quoted ^= c == '"'
        if c == "(" and not quoted:
            break
    else:
        raise ValueError(f"invalid_atom:{text}")
    if not text.endswith(")"):
        raise ValueError(f"invalid_atom:{text}")
    table, occurrence = parse_reference(text[:i])
    terms = []
    for part in split_outside(text[i + 1 : -1], (",",)):
        column, eq, variable = part.strip().partition("=")
        if not eq or not column.strip() or not variable.strip():
            raise ValueError(f"invalid_term:{part.strip()}")
        terms.append((column.strip(), variable.strip()))
    return Atom(table, occurrence, tuple(terms))


@dataclass(frozen=True)
class Dependency:
    """A rule over relations: body and head atoms; variables of the head alone are existential."""

    body: tuple[Atom, ...]
    head: tuple[Atom, ...]

    def atoms(self) -> tuple[Atom, ...]:
        return (*self.body, *self.head)

    def body_variables(self) -> set[str]:
        return {v for a in self.body for v in a.variables()}

    def head_variables(self) -> set[str]:
        return {v for a in self.head for v in a.variables()}

    def existential(self) -> set[str]:
        return self.head_variables() - self.body_variables()

    def kind(self) -> str:
        return ("existential_" if self.existential() else "") + ("multi_head_" if len(self.head) != 1 else "") + "tgd" if self.existential() or len(self.head) != 1 else "horn"

    def key(self, parts: str = "both") -> str:
        """The rule with variables numbered by first appearance, body atoms in the order of their original form."""
        names: dict[str, str] = {}

        def write(atom: Atom) -> str:
            terms = ",".join(f"{c}={names.setdefault(v, f'v{len(names)}')}" for c, v in sorted(atom.terms))
            return f"{quote(atom.table)}({terms})"

        if parts == "head":
            return " & ".join(map(write, sorted(self.head)))
        body = " & ".join(map(write, sorted(self.body)))
        return f"{body} => {' & '.join(map(write, sorted(self.head)))}"


def parse_dependency(text: str) -> Dependency:
    """A rule as displays write it, with or without quantifiers."""
    body, head = implication(text)
    strip = lambda side, mark: side.split(":", 1)[1] if side.startswith(mark) and ":" in side else side
    sides = [tuple(Atom(a.table, a.occurrence, tuple(sorted(a.terms))) for a in map(parse_atom, conjuncts(strip(side, mark)))) for side, mark in ((body, "∀"), (head, "∃"))]
    for side, name in zip(sides, ("body", "head"), strict=True):
        if not side:
            raise ValueError(f"missing_{name}_atoms")
    return Dependency(*sides)
