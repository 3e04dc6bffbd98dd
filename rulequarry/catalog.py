"""A relational catalog: named DataFrames with the keys that Parquet does not store."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True, order=True)
class ForeignKey:
    """One column pair; a composite key is several of them."""

    table: str
    column: str
    ref_table: str
    ref_column: str


@dataclass
class Catalog:
    """Tables by name; primary keys by table; foreign keys, several targets a column allowed.

    Names are listed in sorted order: the order numbers tables in rule keys and displays.
    """

    tables: dict[str, DataFrame]
    primary_keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()
    name: str = "database"

    def __post_init__(self) -> None:
        self._projections: dict[tuple, DataFrame] = {}
        self.foreign_keys = tuple(dict.fromkeys(self.foreign_keys))

    @classmethod
    def read(cls, spark: SparkSession, source: str, names: Iterable[str], primary_keys: Mapping[str, Iterable[str]], foreign_keys: Iterable[tuple[str, str, str, str]], kind: str = "parquet", name: str = "database", **options) -> Catalog:
        """Tables from files `source/name.kind` (parquet, orc, csv, json), or from a JDBC URL."""
        if kind == "jdbc":
            tables = {n: spark.read.format("jdbc").options(url=source, dbtable=n, **options).load() for n in names}
        else:
            tables = {n: spark.read.format(kind).options(**options).load(f"{source}/{n}.{kind}") for n in names}
        return cls(tables, {t: tuple(c) for t, c in primary_keys.items()}, tuple(ForeignKey(*k) for k in foreign_keys), name)

    def dates_as_strings(self) -> Catalog:
        """The catalog with dates and timestamps as text, so that sentinels that are no dates can stand beside them."""
        dated = (T.DateType, T.TimestampType, T.TimestampNTZType)
        cast = lambda df: df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, dated) else F.col(f"`{f.name}`") for f in df.schema])
        return Catalog({n: cast(df) for n, df in self.tables.items()}, self.primary_keys, self.foreign_keys, self.name)

    def table_names(self) -> list[str]:
        return sorted(self.tables)

    def columns(self, table: str) -> list[str]:
        return self.tables[table].columns

    def domain(self, table: str, column: str) -> str:
        return dict(self.tables[table].dtypes)[column]

    def is_key(self, table: str, column: str) -> bool:
        return column in self.primary_keys.get(table, ())

    def arity(self, table: str) -> int:
        return len(self.columns(table))

    def references(self, table: str, column: str) -> tuple[tuple[str, str], ...]:
        return tuple((k.ref_table, k.ref_column) for k in self.foreign_keys if (k.table, k.column) == (table, column))

    def are_foreign_keys(self, table: str, column: str, other: str, other_column: str) -> bool:
        """Whether either column is declared to reference the other."""
        return (other, other_column) in self.references(table, column) or (table, column) in self.references(other, other_column)

    def check_foreign_keys(self) -> None:
        """Raises for keys over tables or columns that do not exist."""
        for k in self.foreign_keys:
            for t, c in ((k.table, k.column), (k.ref_table, k.ref_column)):
                if t not in self.tables or c not in self.columns(t):
                    raise ValueError(f"foreign key over unknown column {t}.{c}")

    def select(self, table: str, columns: Iterable[str]) -> DataFrame:
        """A projection; columns that the table lacks are left out."""
        have = set(self.columns(table))
        return self.tables[table].select(*[F.col(f"`{c}`") for c in columns if c in have])

    def values(self, table: str, column: str) -> DataFrame:
        """The column's values that are not null, repeats included."""
        return self.tables[table].select(F.col(f"`{column}`").alias("value")).where("value IS NOT NULL")

    def value_set(self, table: str, column: str) -> DataFrame:
        """The distinct values as text that count for overlaps: null, '', zero and false do not."""
        return self.tables[table].select(truthy(F.col(f"`{column}`"), self.domain(table, column)).alias("value")).where("value IS NOT NULL").distinct()

    def distinct(self, table: str, columns: tuple[str, ...]) -> DataFrame:
        """The distinct rows of a projection; one plan object for each, so that equal parts are planned alike."""
        key = (table, columns)
        if key not in self._projections:
            self._projections[key] = self.tables[table].select(*[F.col(f"`{c}`") for c in columns]).distinct()
        return self._projections[key]

    def differing(self, table: str, columns: tuple[str, ...], key: str, others: int) -> DataFrame:
        """The distinct rows of a projection, each with others + 1 values of a further column, or all if there are fewer.

        Whatever `others` values are given, a row has a value that differs from all of them if and only if one of those
        kept does. A null differs from nothing and is left out.
        """
        memo = (table, columns, key, others)
        if memo not in self._projections:
            own, value = [F.col(f"`{c}`") for c in columns], F.col(f"`{key}`")
            some = self.tables[table].select(*own, value).where(value.isNotNull())
            if others == 1:
                ends = some.groupBy(*own).agg(F.array(F.min(value), F.max(value)).alias(key))
                some = ends.select(*own, F.explode(F.array_distinct(F.filter(value, lambda x: x.isNotNull()))).alias(key))
            else:
                at = free_column("_at", some.columns)
                some = some.distinct().withColumn(at, F.row_number().over(Window.partitionBy(*own).orderBy(value))).where(F.col(at) <= others + 1).drop(at)
            self._projections[memo] = some
        return self._projections[memo]

    def statistics(self) -> DataFrame:
        """(table_name, n_rows, n_columns, n_foreign_keys) of every table, counted in one job."""
        parts = [self.tables[t].agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows", F.lit(self.arity(t)).cast("long").alias("n_columns"), F.lit(sum(k.table == t for k in self.foreign_keys)).cast("long").alias("n_foreign_keys")) for t in self.table_names()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def free_column(name: str, taken: list[str]) -> str:
    """A column name after `name` that is not taken, in any case of letters."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def truthy(column, domain: str):
    """The value as text, or null where it is null, empty, zero or false."""
    if domain == "boolean":
        return F.when(column, F.lit("True"))
    numeric = domain.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))
    return F.when(column != 0 if numeric else column.cast("string") != "", column.cast("string"))


# The keys of the tables of the test data.
STAR_KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": (),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "labels": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "conversations": ("conv_id", "turn"),
}
STAR_REFERENCES = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events", "user_id", "customer", "c_custkey"),
    ("labels", "doc_id", "documents", "doc_id"),
)


def star(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None) -> Catalog:
    """The test data's catalog, or the part of it over some tables."""
    names = list(names or STAR_KEYS)
    return Catalog.read(spark, sf_dir, names, {n: STAR_KEYS[n] for n in names}, [k for k in STAR_REFERENCES if k[0] in names and k[2] in names])
