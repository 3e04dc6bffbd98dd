"""Which columns share values: overlaps, inclusion dependencies, foreign keys held against the data.

One pass puts every column's distinct values into one table (attribute, value); groups of that table by value give the
overlaps of all pairs of columns at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.catalog import Catalog, truthy

#: Shared values that make two columns joinable, exceeded.
OVERLAP = 350


# The spellings of each scope in settings; True and False are the full scope and keys alone.
SPELLINGS = {
    "fk": ("False", "fk", "fk_only", "fk-only", "foreign_keys", "foreign-keys"),
    "full": ("True", "full", "full_join", "full-joinability", "value_overlap"),
}


def scope(value) -> str:
    """The scope that a setting names: declared keys alone, or any columns that share values."""
    word = repr(value) if isinstance(value, bool) else str(value).strip().lower()
    for name, known in SPELLINGS.items():
        if word in known:
            return name
    raise ValueError(f"no scope of joinability is called {value!r}; there are {', '.join(SPELLINGS)}")


def _atomic(catalog: Catalog, table: str, column: str) -> bool:
    return not catalog.domain(table, column).startswith(("array", "map", "struct", "binary", "variant"))


def attribute_values(catalog: Catalog, columns: list[tuple[str, str]] | None = None, falsy: bool = False) -> DataFrame:
    """(table_name, column_name, value): distinct values as text; empty, zero and false values only with falsy."""
    parts = []
    for t in catalog.table_names():
        own = [c for c in catalog.columns(t) if (columns is None or (t, c) in columns) and _atomic(catalog, t, c)]
        if own:
            value = lambda c, t=t: F.col(f"`{c}`").cast("string") if falsy else truthy(F.col(f"`{c}`"), catalog.domain(t, c))
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), value(c).alias("value")) for c in own]))
            parts.append(catalog.tables[t].select(pairs.alias("x")).select(F.lit(t).alias("table_name"), "x.column_name", "x.value").where("value IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts).distinct()


def overlaps(values: DataFrame) -> DataFrame:
    """(table_a, column_a, table_b, column_b, shared, size_a, size_b): pairs with a shared value, each once, a column with itself too."""
    attribute = F.struct("table_name", "column_name")
    # A value lies in as many attributes as the schema has at most, so its group is bounded by the schema.
    groups = values.groupBy("value").agg(F.array_sort(F.collect_set(attribute)).alias("at"))
    pairs = groups.select(F.explode("at").alias("a"), "at").select("a", F.explode(F.filter("at", lambda x: x >= F.col("a"))).alias("b"))
    sizes = values.groupBy(attribute.alias("k")).agg(F.count("*").alias("n"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    return (
        counted.join(sizes.select(F.col("k").alias("a"), F.col("n").alias("size_a")), "a")
        .join(sizes.select(F.col("k").alias("b"), F.col("n").alias("size_b")), "b")
        .select(F.col("a.table_name").alias("table_a"), F.col("a.column_name").alias("column_a"), F.col("b.table_name").alias("table_b"), F.col("b.column_name").alias("column_b"), "shared", "size_a", "size_b")
    )


def jaccard(pairs: DataFrame) -> DataFrame:
    """overlaps() with the share of common values in all values of both."""
    return pairs.withColumn("jaccard", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))


def overlapping_pairs(catalog: Catalog, least: int = OVERLAP) -> list[tuple[tuple[str, str], tuple[str, str]]]:
    """Pairs of columns with more than `least` shared values; at most the square of the schema's columns."""
    order = {(t, c): (i, j) for i, t in enumerate(catalog.table_names()) for j, c in enumerate(catalog.columns(t))}
    found = [((r["table_a"], r["column_a"]), (r["table_b"], r["column_b"])) for r in overlaps(attribute_values(catalog)).where(F.col("shared") > least).collect()]
    return sorted((tuple(sorted(p, key=order.__getitem__)) for p in found), key=lambda p: (order[p[0]], order[p[1]]))


def inclusion_dependencies(values: DataFrame) -> DataFrame:
    """(table_dependant, column_dependant, table_referenced, column_referenced): columns whose values all lie in another."""
    attribute = F.struct("table_name", "column_name")
    groups = values.groupBy("value").agg(F.collect_set(attribute).alias("at"))
    pairs = groups.select(F.explode("at").alias("a"), "at").select("a", F.explode("at").alias("b")).where("a <> b")
    sizes = values.groupBy(attribute.alias("k")).agg(F.count("*").alias("n"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).join(sizes, F.col("a") == F.col("k")).where("shared = n")
    return counted.select(F.col("a.table_name").alias("table_dependant"), F.col("a.column_name").alias("column_dependant"), F.col("b.table_name").alias("table_referenced"), F.col("b.column_name").alias("column_referenced"))


def foreign_key_violations(catalog: Catalog) -> DataFrame:
    """(table_name, column_name, ref_table, ref_column, orphans) of every declared key: values that refer to nothing."""
    parts = []
    for k in catalog.foreign_keys:
        child, parent = catalog.values(k.table, k.column), catalog.values(k.ref_table, k.ref_column).distinct()
        lost = child.join(parent, "value", "left_anti").agg(F.count("*").alias("orphans"))
        parts.append(lost.select(F.lit(k.table).alias("table_name"), F.lit(k.column).alias("column_name"), F.lit(k.ref_table).alias("ref_table"), F.lit(k.ref_column).alias("ref_column"), "orphans"))
    return reduce(DataFrame.unionByName, parts)
