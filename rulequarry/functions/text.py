"""Small text forms: durations, names for logic programs, lines of other systems' output."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# How a duration is written below a second, a minute, an hour, and from there on.
DURATION_FORMS = ("{ms:.2f} ms", "{seconds:.3f} seconds", "{minutes}m {rest:.1f}s", "{hours}h {minutes}m")


def duration(seconds: float) -> str:
    """Seconds for people to read; the form goes by the size."""
    minutes, rest = divmod(seconds, 60)
    hours, minutes = divmod(int(minutes), 60)
    return DURATION_FORMS[bisect_right((1, 60, 3600), seconds)].format(ms=seconds * 1000, seconds=seconds, rest=rest, minutes=minutes, hours=hours)


def program_value(column: Column, integer: bool = False) -> Column:
    """A value as a logic program writes it: integers and digits stay, other text keeps its letters a-z, lower-cased.

    Null, the word none, and what has no such letter are `_`.
    """
    text = column.cast("string")
    if integer:
        return F.coalesce(text, F.lit("_"))
    letters = F.lower(F.regexp_replace(text, "[^A-Za-z]+", ""))
    return F.when(text.isNull() | (F.lower(text) == "none"), "_").when(text.rlike(r"^\p{Nd}+$"), text).when(letters == "", "_").otherwise(letters)


def program_facts(table: DataFrame, name: str) -> DataFrame:
    """One fact `name(value,...).` a row."""
    values = F.concat_ws(",", *[program_value(F.col(f"`{c}`"), kind in ("tinyint", "smallint", "int", "bigint")) for c, kind in table.dtypes])
    return table.select(F.concat(F.lit(f"{name}("), values, F.lit(").")).alias("value"))


def triple_rules(lines: DataFrame) -> DataFrame:
    """(body, head, confidence, support, accuracy) of a triple miner's output lines; accuracy is support by facts loaded."""
    rx = r"^(.+?)\s+=>\s+(.+?)\t([0-9.]+)\t([0-9.]+)"
    loaded = lines.agg(F.max(F.regexp_extract("value", r"^Loaded (\d+)", 1).try_cast("long")).alias("loaded"))
    number = lambda n: F.regexp_extract("value", rx, n).cast("double")
    rows = lines.where(F.col("value").rlike(rx)).select(F.regexp_extract("value", rx, 1).alias("body"), F.regexp_extract("value", rx, 2).alias("head"), number(3).alias("confidence"), number(4).alias("support"))
    return rows.crossJoin(loaded).select("body", "head", "confidence", "support", F.when(F.col("loaded") > 0, F.col("support") / F.col("loaded")).otherwise(0.0).alias("accuracy"))


# The marks of a logic learner's report; a solution runs from its heading to a line of asterisks.
NO_SOLUTION = "NO SOLUTION"
_SOLUTION = re.compile(r"^.*SOLUTION.*\n((?s:.*?))(?:^[^\S\n]*\*+[^\S\n]*$|\Z)", re.MULTILINE)
_CLAUSE = re.compile(r"^[^\S\n]*(\S.*:-.*\.)[^\S\n]*$", re.MULTILINE)
_SCORES = {name: re.compile(name + r":\s*([0-9.]+)") for name in ("Precision", "Recall")}


def clause_rules(output: str) -> list[tuple[str, float, float]]:
    """(clause, precision, recall) of a logic learner's solutions; a missing score is -1."""
    if NO_SOLUTION in output:
        return []
    precision, recall = (float(m[1]) if (m := rx.search(output)) else -1.0 for rx in _SCORES.values())
    return [(clause, precision, recall) for part in _SOLUTION.findall(output) for clause in _CLAUSE.findall(part)]


def used_twice(atoms: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Atoms (variable, relation, variable) whose two variables both occur at least twice."""
    count: dict[str, int] = {}
    for a, _, b in atoms:
        for v in (a, b):
            count[v] = count.get(v, 0) + 1
    return [x for x in atoms if count[x[0]] > 1 and count[x[2]] > 1]
