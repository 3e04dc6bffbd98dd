"""Rules as files: result folders, records of audits, inclusion dependencies, statuses, logs; and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATOM = "struct<variable1:string,relation:string,variable2:string>"
#: One rule as result files hold it, whatever its kind.
RULE = (
    f"type string, body array<{ATOM}>, head array<{ATOM}>, display string, support bigint, accuracy double, confidence double, correct boolean, compatible boolean, "
    "table_dependant string, columns_dependant array<string>, table_referenced string, columns_referenced array<string>, table string, determinant array<string>, dependent array<string>"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rules of result files `path/ALG/ALG_db/ALG_db_results.json`, each an array, with their position; other files are skipped."""
    files = spark.read.option("wholetext", True).text(f"{path}/*/*/*_results.json").withColumn("file", F.col("_metadata.file_path"))
    folder = F.element_at(F.split("file", "/"), -2)
    algorithm = F.element_at(F.split("file", "/"), -3)
    rows = files.select(algorithm.alias("algorithm"), F.substr(folder, F.length(algorithm) + 2).alias("database"), F.posexplode(F.from_json("value", f"array<struct<{_fields(RULE)}>>")).alias("rule_index", "rule"))
    return rows.where("rule IS NOT NULL").select("algorithm", "database", "rule_index", "rule.*")


def _fields(ddl: str) -> str:
    return ",".join(part.replace(" ", ":", 1) for part in ddl.split(", "))


def write_rules(rules: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a rule; the writer's commit makes the folder appear whole or not at all."""
    rules.write.mode("append" if append else "overwrite").json(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULE).json(path)


def write_horn_displays(rules: DataFrame, path: str) -> None:
    """The displays of rules with one head atom, a line each."""
    rules.where(F.size("head") == 1).select("display").write.mode("overwrite").text(path)


def write_records(records: DataFrame, path: str) -> None:
    """Audit records by algorithm and database, so that a shard can be read or replaced by itself."""
    records.write.mode("overwrite").partitionBy("algorithm", "database").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records from CSV with a header; '' and 'None' are null."""
    df = spark.read.option("header", True).option("nullValue", "None").option("emptyValue", "").schema(schema).csv(path)
    return df.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read_inclusion_lines(spark: SparkSession, path: str) -> DataFrame:
    """(table_dependant, column_dependant, table_referenced, column_referenced) of a profiler's JSON lines."""
    side = "struct<columnIdentifiers:array<struct<tableIdentifier:string,columnIdentifier:string>>>"
    rows = spark.read.schema(f"type string, dependant {side}, referenced {side}").json(path).where("type = 'InclusionDependency' AND size(dependant.columnIdentifiers) = 1")
    bare = lambda c: F.regexp_replace(c, r"\.csv$", "")
    part = lambda s: F.col(f"{s}.columnIdentifiers")[0]
    return rows.select(bare(part("dependant")["tableIdentifier"]).alias("table_dependant"), part("dependant")["columnIdentifier"].alias("column_dependant"), bare(part("referenced")["tableIdentifier"]).alias("table_referenced"), part("referenced")["columnIdentifier"].alias("column_referenced"))


STATUS = "algorithm string, database string, status string, rules_count long, partial boolean, updated_at timestamp"


def read_statuses(spark: SparkSession, path: str) -> DataFrame:
    """Run statuses of `path/progress/*.json` (priority 1) and of the runs in `path/summary*.json` (priority 0)."""
    file = F.col("_metadata.file_path").alias("source_path")
    own = spark.read.schema(STATUS).option("multiLine", True).json(f"{path}/progress/*.json").select("*", F.lit(1).alias("priority"), file)
    summary = spark.read.schema(f"runs array<struct<{_fields(STATUS)}>>").option("multiLine", True).json(f"{path}/summary*.json").select(F.explode("runs").alias("r"), file).select("r.*", F.lit(0).alias("priority"), "source_path")
    return own.unionByName(summary)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(log_path, line_no, line) of log files."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("log_path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return whole


def normalized(rules: DataFrame) -> DataFrame:
    """Rules with a SHA-256 of their stable fields."""
    fields = F.struct("display", "support", "confidence")
    return rules.withColumn("rule_hash", F.sha2(F.to_json(fields), 256))
