"""Discovery of Horn rules: the lattice on the driver, the counts in Spark, in batches.

Adding an edge to a candidate only adds conditions, so a candidate without support has no supported descendant. Splits
are therefore counted level by level, and what extends an empty candidate is not counted at all.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulequarry.catalog import Catalog
from rulequarry.functions.relations import parse_dependency
from rulequarry.operators import joinability
from rulequarry.operators.lattice import Candidate, Graph, Names, candidates, display, edges, foreign_key_pairs, horn_key, horn_splits
from rulequarry.plans.conjunctive import Planner, Query


@dataclass(frozen=True)
class Rule:
    """support: distinct head assignments with a witness; confidence: diagnostic, never a filter.

    confidence joins body atoms only through the smallest member of each class, as the published miner counts it;
    confidence_exact joins all members of a class.
    """

    display: str
    support: int
    confidence: float
    confidence_exact: float
    body: tuple[tuple[str, int], ...]
    head: tuple[str, int]


@dataclass
class Settings:
    """walk_length: occurrences of each table; max_tables: occurrences of a rule; max_variables: classes of a rule."""

    walk_length: int = 3
    max_tables: int = 3
    max_variables: int = 3
    max_nb_occurrence_per_table_and_column: dict = field(default_factory=dict)
    disjoint_semantics: bool = False
    joinability: str = "fk"
    support_threshold: int = 1
    timeout: float | None = None

    @classmethod
    def of(cls, **given) -> Settings:
        """Settings from loosely typed values and older names; None and sizes below 1 leave the default."""
        out = cls()
        for key, value in given.items():
            if key in GONE:
                raise ValueError(f"{key} is no setting any more; {GONE[key]}")
            name = OLDER.get(key, key)
            if name not in cls.__dataclass_fields__ and name != "recursivity":
                raise ValueError(f"unknown setting {key}")
            if value is None:
                continue
            name, value = ("walk_length", int(value) + 1 if int(value) > 0 else 1) if name == "recursivity" else (name, READ.get(name, lambda x: x)(value))
            if value is not None:
                setattr(out, name, value)
        return out


# Settings that are no more, and those that were called otherwise.
GONE = {"split_mean_threshold": "use support_threshold, an integer of 1 or more"}
OLDER = {
    "nb_occurrence": "walk_length",
    "max_table": "max_tables",
    "max_vars": "max_variables",
    "disjoint_semantic": "disjoint_semantics",
    "joinability_scope": "joinability",
    "full_joinability": "joinability",
}


def _size(value) -> int | None:
    n = int(value)
    return n if n > 0 else None


def _whole(value) -> int:
    if isinstance(value, bool) or value != int(value) if not isinstance(value, str) else not value.strip().isdigit():
        raise ValueError(f"support_threshold must be an integer of 1 or more, not {value!r}")
    if int(value) < 1:
        raise ValueError(f"support_threshold must be an integer of 1 or more, not {value!r}")
    return int(value)


def _flag(value) -> bool:
    return value.strip().lower() in ("1", "true", "yes", "on") if isinstance(value, str) else bool(value)


#: How the values of a setting are read; others are taken as they are.
READ: dict[str, Callable] = {"walk_length": _size, "max_tables": _size, "max_variables": _size, "support_threshold": _whole, "disjoint_semantics": _flag, "joinability": joinability.scope}


def metrics_queries(c: Candidate, body: tuple, head: tuple, names: Names, disjoint: bool) -> tuple[Query, Query, Query, Query]:
    """Queries whose counts are support, body with head, body joined by stars, body joined by classes."""
    atom = lambda a: (names.tables[a[0]], a[1])
    term = names.term

    def project(atoms: set) -> tuple:
        return tuple(term(own[0]) for cls in c.classes if (own := [p for p in cls if p.atom in atoms]))

    stars = [(cls[0], p) for cls in c.classes for p in cls[1:]]
    within = set(body)
    inner = [(own[0], p) for cls in c.classes if (own := [p for p in cls if p.atom in within]) for p in own[1:]]
    named = lambda pairs: tuple((term(a), term(b)) for a, b in pairs)
    every, some = tuple(map(atom, c.atoms)), tuple(map(atom, body))
    return (
        Query(every, named(stars), project({head}), disjoint),
        Query(every, named(stars), project(within), disjoint),
        Query(some, named((a, b) for a, b in stars if a.atom in within and b.atom in within), project(within), disjoint),
        Query(some, named(inner), project(within), disjoint),
    )


def discover(catalog: Catalog, settings: Settings | None = None, should_stop: Callable[[], bool] | None = None, **given) -> Iterator[Rule]:
    """Rules in the order of the search; a stop or a timeout ends them early."""
    s = settings or Settings.of(**given)
    began = time.monotonic()
    over = lambda: bool(should_stop and should_stop()) or s.timeout is not None and time.monotonic() - began > s.timeout
    if over():
        return
    names = Names(catalog)
    pairs = foreign_key_pairs(catalog) if s.joinability == "fk" else joinability.overlapping_pairs(catalog)
    narrow, held = _narrowed(catalog, pairs)
    try:
        yield from _search(Planner(narrow), names, pairs, s, over)
    finally:
        for df in held:
            df.unpersist()


def _search(planner: Planner, names: Names, pairs: list, s: Settings, over: Callable[[], bool]) -> Iterator[Rule]:
    graph = Graph(edges(names, pairs, s.walk_length, s.max_nb_occurrence_per_table_and_column))
    found = list(candidates(graph, s.max_tables, s.max_variables))
    levels: dict[int, list[int]] = defaultdict(list)
    for n, c in enumerate(found):
        levels[len(c.path)].append(n)
    empty: set[frozenset] = set()
    known: dict[str, int] = {}
    rules: dict[tuple[int, tuple], tuple[int, int, int, int]] = {}
    linked = lambda c: frozenset(frozenset((a, b)) for cls in c.classes for i, a in enumerate(cls) for b in cls[i + 1 :])
    for level in sorted(levels):
        if over():
            return
        alive = [n for n in levels[level] if not empty or not any(e <= linked(found[n]) for e in empty)]
        asked = [(n, body, head) for n in alive for body, head in horn_splits(found[n])]
        plans = [metrics_queries(found[n], body, head, names, s.disjoint_semantics) for n, body, head in asked]
        support = planner.counts([p[0] for p in plans], known=known)
        kept = [k for k, v in enumerate(support) if v >= s.support_threshold]
        empty |= {linked(found[asked[k][0]]) for k, v in enumerate(support) if v == 0}
        rest = planner.counts([q for k in kept for q in plans[k][1:]], known=known)
        for i, k in enumerate(kept):
            n, _, head = asked[k]
            rules[n, head] = (support[k], *rest[3 * i : 3 * i + 3])
    emitted: set[tuple] = set()
    ratio = lambda a, b: a / b if b else 0.0
    for n, c in enumerate(found):
        for body, head in horn_splits(c):
            if (n, head) in rules and (key := horn_key(c, head)) not in emitted:
                emitted.add(key)
                if over():
                    return
                support, both, star, exact = rules[n, head]
                atom = lambda a: (names.tables[a[0]], a[1])
                yield Rule(display(c, head, names), support, ratio(both, star), ratio(both, exact), tuple(map(atom, body)), atom(head))


def _narrowed(catalog: Catalog, pairs: list) -> tuple[Catalog, list[DataFrame]]:
    """The tables that joinable columns belong to, reduced to those columns and the keys, and kept.

    Hundreds of counts read them. Rows are made distinct where no primary key already tells them apart. Returns what
    to release in the end.
    """
    used: dict[str, set[str]] = defaultdict(set)
    for pair in pairs:
        for t, c in pair:
            used[t].add(c)
    tables = {}
    for t, columns in used.items():
        key = catalog.primary_keys.get(t, ())
        df = catalog.tables[t].select(*[F.col(f"`{c}`") for c in catalog.columns(t) if c in columns or c in key])
        tables[t] = (df if key else df.distinct()).persist(StorageLevel.MEMORY_AND_DISK)
    held = list(tables.values())
    return Catalog(catalog.tables | tables, catalog.primary_keys, catalog.foreign_keys, catalog.name), held


RULES = "rule_id int, display string, head_relation string, body_size int, support long, confidence double, confidence_exact double"


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """One row a rule, in order; there are as many as the search emits, not as the data has rows."""
    return spark.createDataFrame([(i, r.display, r.head[0], len(r.body), r.support, r.confidence, r.confidence_exact) for i, r in enumerate(rules)], RULES)


def best_per_head(rules: DataFrame) -> DataFrame:
    """All rules that reach the largest support of their head relation."""
    w = Window.partitionBy("head_relation").orderBy(F.desc("support"))
    return rules.withColumn("_rank", F.rank().over(w)).where("_rank = 1").drop("_rank")


def top_rules(rules: DataFrame, n: int = 5) -> DataFrame:
    """The n rules of largest support, rules without one last, ties in order."""
    return rules.orderBy(F.desc_nulls_last("support"), "rule_id").limit(n)


def statistics(rules: DataFrame) -> DataFrame:
    """(horn_rules, average_support, average_confidence), zeros where there is none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rules.agg(F.count("*").alias("horn_rules"), zero(F.avg("support")).alias("average_support"), zero(F.avg("confidence")).alias("average_confidence"))


def rule_set_digest(rules: DataFrame) -> DataFrame:
    """One SHA-256 over the sorted displays with their counts."""
    lines = F.array_sort(F.collect_list(F.concat_ws("|", "display", F.col("support").cast("string"))))
    return rules.agg(F.sha2(F.concat_ws("\n", lines), 256).alias("digest"), F.count("*").alias("n_rules"))


def duplicates(rules: DataFrame) -> DataFrame:
    """Displays that occur more than once."""
    return rules.groupBy("display").agg(F.count("*").alias("n")).where("n > 1")


def parsed(rule: Rule):
    """The rule's atoms."""
    return parse_dependency(rule.display)
