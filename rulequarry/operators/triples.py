"""Relational tables as triples, their mapping, and rules over triples as rules over relations."""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulequarry.catalog import Catalog
from rulequarry.functions.relations import Atom, Dependency


def identifier(column: Column) -> Column:
    """Everything but letters and digits becomes an underscore."""
    return F.regexp_replace(column.cast("string"), r"[^\p{L}\p{N}]", "_")


def subject(table: str, columns: list[Column]) -> Column:
    """The id of a row: its table and its key's values; null if one is null."""
    whole = F.concat_ws("_", F.lit(re.sub(r"[^\w]", "_", table)), *map(identifier, columns))
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in columns]), whole)


def literal(column: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(column.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))


def exported(catalog: Catalog) -> list[str]:
    """Tables with a key and more than one column."""
    return [t for t in catalog.table_names() if catalog.primary_keys.get(t) and catalog.arity(t) > 1]


def _objects(catalog: Catalog, table: str, column: str) -> list[Column]:
    """What a column says: the rows that it references, else its value."""
    out = []
    for ref, ref_column in catalog.references(table, column):
        key = catalog.primary_keys.get(ref, ())
        parts = [F.col(f"`{column}`") if k == ref_column else F.col(f"`{k}`") if k in catalog.columns(table) else None for k in key]
        if parts and all(p is not None for p in parts):
            out.append(subject(ref, parts))
    return out or [literal(F.col(f"`{column}`"))]


def table_triples(catalog: Catalog, table: str) -> DataFrame:
    """(s, p, o) of one table: an entry for each column that is no key or references a row; null values say nothing."""
    key = catalog.primary_keys[table]
    entries = [F.struct(F.lit(f"{table}.{c}").alias("p"), o.alias("o")) for c in catalog.columns(table) if c not in key or catalog.references(table, c) for o in _objects(catalog, table, c)]
    if not entries:
        return catalog.tables[table].sparkSession.createDataFrame([], "s string, p string, o string")
    rows = catalog.tables[table].select(subject(table, [F.col(f"`{c}`") for c in key]).alias("s"), F.explode(F.array(*entries)).alias("x"))
    return rows.select("s", "x.p", "x.o").where("s IS NOT NULL AND o IS NOT NULL")


def triples(catalog: Catalog) -> DataFrame:
    parts = [table_triples(catalog, t) for t in exported(catalog)]
    if not parts:
        raise ValueError("no table has both a key and another column")
    return reduce(DataFrame.unionByName, parts)


def predicate_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("p").agg(F.count("*").alias("n"))


def write_tsv(found: DataFrame, path: str) -> None:
    """Lines of subject, predicate and object, unquoted."""
    found.select(F.concat_ws("\t", "s", "p", "o")).write.mode("overwrite").text(path)


def mapping(catalog: Catalog) -> dict:
    """Which predicates stand for which columns; skipped tables; tables whose ids collide; a signature of the schema."""
    tables = exported(catalog)
    names: dict[str, list[str]] = defaultdict(list)
    for t in tables:
        names[re.sub(r"[^\w]", "_", t)].append(t)
    predicates = {}
    for t in tables:
        for c in catalog.columns(t):
            refs = catalog.references(t, c)
            if c not in catalog.primary_keys[t] or refs:
                predicates[f"{t}.{c}"] = {"table": t, "column": c, "references": [list(r) for r in refs]}
    schema = {t: [catalog.columns(t), list(catalog.primary_keys.get(t, ()))] for t in catalog.table_names()}
    return {
        "predicates": predicates,
        "collisions": sorted(n for n, own in names.items() if len(own) > 1),
        "skipped": sorted(set(catalog.table_names()) - set(tables)),
        "primary_keys": {t: list(catalog.primary_keys[t]) for t in tables},
        "signature": hashlib.sha256(json.dumps(schema, sort_keys=True).encode()).hexdigest(),
    }


def unknown_predicates(lines: DataFrame, known: dict) -> DataFrame:
    """Predicates of tab-separated lines (`value`) that the mapping lacks, with their number; a line without three fields fails."""
    parts = F.split("value", "\t")
    names = lines.sparkSession.createDataFrame([(p,) for p in known["predicates"]], "p string")
    found = lines.select(F.when(F.size(parts) == 3, parts[1]).otherwise(F.raise_error(F.lit("a line does not have three fields"))).alias("p"))
    return found.join(F.broadcast(names), "p", "left_anti").groupBy("p").agg(F.count("*").alias("n"))  # names: the schema's columns


def translate(display: str, known: dict) -> Dependency:
    """A rule over triples, `?a p ?b ... => ?a p ?b`, as a rule over relations.

    Triples of one subject and table become one atom; its key is the subject's variable, and a reference's object is
    the variable of the row that it refers to.
    """
    text = display.split("\t")[0]
    body, mark, head = text.partition("=>")
    if not mark:
        raise ValueError("amie_missing_implication")

    def side(part: str, name: str) -> list[tuple[str, str, str]]:
        words = part.split()
        if not words:
            raise ValueError(f"amie_empty_{name}")
        if len(words) % 3:
            raise ValueError(f"amie_malformed_{name}")
        out = [tuple(words[i : i + 3]) for i in range(0, len(words), 3)]
        for s, p, o in out:
            if not s.startswith("?") or not o.startswith("?"):
                raise ValueError("amie_constants_not_supported")
            if p not in known["predicates"]:
                raise ValueError(f"amie_unknown_predicate:{p}")
            if known["predicates"][p]["table"] in known["collisions"]:
                raise ValueError(f"amie_collision:{p}")
        return out

    sides = [side(body, "body"), side(head, "head")]
    keys = known["primary_keys"]
    numbers: dict[tuple[str, str, int], int] = {}
    count: dict[str, int] = defaultdict(int)

    def atoms(triples: list[tuple[str, str, str]], which: int) -> tuple[Atom, ...]:
        terms: dict[tuple[str, str], dict[str, str]] = {}
        for s, p, o in triples:
            at = known["predicates"][p]
            key = keys[at["table"]]
            own = terms.setdefault((at["table"], s), {k: s[1:] if len(key) == 1 else f"{s[1:]}_{k}" for k in key})
            if own.setdefault(at["column"], o[1:]) != o[1:]:
                raise ValueError(f"amie_two_values:{p}")
        out = []
        for (table, s), own in terms.items():
            if (table, s, which) not in numbers:
                numbers[table, s, which] = count[table]
                count[table] += 1
            out.append(Atom(table, numbers[table, s, which], tuple(sorted(own.items()))))
        return tuple(out)

    return Dependency(atoms(sides[0], 0), atoms(sides[1], 1))
