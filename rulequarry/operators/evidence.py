"""What runs leave behind: logs, statuses, artifacts, rule sets; and the tables that compare them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of an attempt from the weakest to the one that nothing overrides, and how lines tell them.
STATUSES = ("partial", "success", "interrupted", "error", "timeout", "memory_limit", "no_joinable_indexed")
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3})\s+-?\s*(.*)$"
ANSI = "\\x1b\\[[0-9;]*[A-Za-z]"


def log_attempts(lines: DataFrame, start: str = r"(?i)\bstarting\b") -> DataFrame:
    """(log_path, attempt, database, started_at, ended_at, status, runtime_seconds, rules_count, memory_event_gb): runs of a log.

    lines: (log_path, line_no, line). A line that matches `start` begins an attempt; of its lines the strongest status
    and the last of every number hold. Lines without a timestamp and lines before the first start say nothing. A log is
    the unit that is read in order.
    """
    plain = F.regexp_replace("line", ANSI, "")
    message = F.regexp_extract(plain, LINE, 3)
    at = F.to_timestamp_ntz(F.concat_ws(".", F.regexp_extract(plain, LINE, 1), F.regexp_extract(plain, LINE, 2)), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    rows = lines.where(plain.rlike(LINE)).select("log_path", "line_no", at.alias("at"), F.trim(message).alias("m"))
    order = Window.partitionBy("log_path").orderBy("line_no")
    runs = rows.withColumn("attempt", F.sum(F.col("m").rlike(start).cast("int")).over(order)).where("attempt > 0")
    low = F.lower("m")
    rank = (
        F.when(low.contains("no joinable") & low.contains("indexed"), 6)
        .when(F.col("m").rlike(r"(?i)memory (limit|usage).*exceed|exceed.*memory"), 5)
        .when(F.col("m").rlike(r"(?i)timeout|time limit"), 4)
        .when(F.col("m").contains("Process completed successfully"), 1)
        .when(F.col("m").contains("Received signal"), 2)
        .when(F.col("m").contains("Traceback") | F.col("m").contains("An error occurred"), 3)
        .otherwise(0)
    )
    number = lambda rx: F.nullif(F.regexp_extract("m", rx, 1), F.lit(""))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    database = F.regexp_replace(F.regexp_extract("m", r"sqlite:/+(\S+)", 1), r"^.*/|\.db$", "")
    return (
        runs.groupBy("log_path", "attempt")
        .agg(
            last(F.nullif(database, F.lit(""))).alias("database"),
            F.min_by("at", "line_no").alias("started_at"),
            F.max_by("at", "line_no").alias("ended_at"),
            F.element_at(F.array(*map(F.lit, STATUSES)), F.max(rank) + 1).alias("status"),
            last(number(r"(?i)(?:in|after|took) ([0-9.]+) ?s(?:ec|econds)?\b").cast("double")).alias("runtime_seconds"),
            last(number(r"(?i)(\d+) rules").cast("long")).alias("rules_count"),
            last(number(r"(?i)([0-9.]+) ?GB").cast("double")).alias("memory_event_gb"),
        )
        .withColumn("database", F.coalesce("database", F.element_at(F.split("log_path", "/"), -2)))
    )


def status_histogram(attempts: DataFrame) -> DataFrame:
    """(status, n) for every status, zero where there is none."""
    names = attempts.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return names.join(attempts.groupBy("status").agg(F.count("*").alias("n")), "status", "left").na.fill(0)


def database_name(column: Column) -> Column:
    """A database's name without folder and ending."""
    return F.regexp_replace(column, r"^.*/|\.db$", "")


def latest_statuses(runs: DataFrame) -> DataFrame:
    """The last status of each algorithm and database; of equal times the higher priority, then the later path.

    runs: algorithm, database, status, rules_count, partial, updated_at, priority, source_path.
    """
    rows = runs.select(F.upper(F.trim("algorithm")).alias("algorithm"), database_name(F.col("database")).alias("database"), F.lower(F.coalesce(F.trim("status"), F.lit("missing"))).alias("status"), "rules_count", F.coalesce("partial", F.lit(False)).alias("partial"), "updated_at", "priority", "source_path").where("algorithm <> '' AND database <> ''")
    last = Window.partitionBy("algorithm", "database").orderBy(F.desc("updated_at"), F.desc("priority"), F.desc("source_path"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("algorithm", "database", "status", "rules_count", (F.col("partial") | (F.col("status") == "partial")).alias("partial"))


def auditable(statuses: DataFrame, results: DataFrame, target: str) -> DataFrame:
    """(database, auditable): whether the target's run ended well, whole, with as many rules as it left."""
    own = statuses.where(F.col("algorithm") == target)
    return results.join(own, "database", "left").select("database", F.coalesce((F.col("status") == "success") & ~F.col("partial") & F.coalesce(F.col("rules_count") == F.col("result_rules"), F.lit(True)), F.lit(False)).alias("auditable"))


def merge_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old runs, those of the same algorithm and database replaced by new ones."""
    return old.join(new, ["algorithm", "database"], "left_anti").unionByName(new)


def missing_shards(planned: DataFrame, done: DataFrame) -> DataFrame:
    """What is planned and not yet written, by algorithm and database."""
    return planned.join(done, ["algorithm", "database"], "left_anti")


def outcome_counts(statuses: DataFrame, jobs: int) -> DataFrame:
    """(status, n, percent): finished runs by outcome, in percent of all planned jobs."""
    return statuses.groupBy("status").agg(F.count("*").alias("n")).withColumn("percent", F.round(100 * F.col("n") / F.lit(max(jobs, 1)), 2))


def batch_summary(runs: DataFrame) -> DataFrame:
    """One row: runs, successes, failures, rules, mean duration of the successful."""
    ok = F.col("status") == "success"
    return runs.agg(F.count("*").alias("runs"), F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias("succeeded"), F.coalesce(F.sum((~ok).cast("long")), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("rules_count"))), F.lit(0)).alias("rules"), F.coalesce(F.avg(F.when(ok, F.col("duration"))), F.lit(0.0)).alias("mean_duration"))


def top_databases(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("rules_count"), "database").limit(n)


def first_of_each(records: DataFrame, by: str, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each value of a column."""
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def top_per_database(rules: DataFrame, metric: str, n: int) -> DataFrame:
    return first_of_each(rules, "database", [F.desc(metric), F.col("rule_index")], n)


def average_per_database(rules: DataFrame) -> DataFrame:
    return rules.groupBy("database").agg(F.count("*").alias("rules"), F.avg("support").alias("average_support"), F.avg("confidence").alias("average_confidence"))


def results_table(runs: DataFrame, metrics: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    """One row a database; status, rules, time and memory of each algorithm.

    runs: the latest metadata (algorithm, database, status, duration_seconds, peak_rss_bytes); metrics: what the run
    itself measured (status, rules_count, execution_time_seconds), which is preferred. A run without success shows its
    status in the place of rules.
    """
    keys = ["algorithm", "database"]
    own = metrics.select(*keys, F.col("status").alias("m_status"), "rules_count", "execution_time_seconds", F.lit(True).alias("measured"))
    both = runs.join(own, keys, "full_outer")
    status = F.lower(F.coalesce("m_status", "status", F.lit("missing")))
    seconds = F.coalesce(F.format_string("%.2f", F.when(F.col("measured"), F.col("execution_time_seconds")).otherwise(F.col("duration_seconds"))), F.lit("-"))
    seconds = F.when(F.when(F.col("measured"), F.col("execution_time_seconds")).otherwise(F.col("duration_seconds")).isNull(), "-").otherwise(seconds)
    rules = F.when(F.col("measured") & (status == "success"), F.coalesce(F.col("rules_count").cast("string"), F.lit("-"))).otherwise(F.upper(status))
    memory = F.when(F.col("peak_rss_bytes").isNull(), "-").otherwise(F.format_string("%.2f", F.col("peak_rss_bytes") / F.lit(1024.0**3)))
    cells = both.select(*keys, F.struct(status.alias("status"), rules.alias("rules"), seconds.alias("time_s"), memory.alias("rss_GB")).alias("cell"))
    wide = cells.groupBy("database").pivot("algorithm", list(algorithms)).agg(F.first("cell"))
    blank = {"status": "missing", "rules": "MISSING", "time_s": "-", "rss_GB": "-"}
    return wide.select("database", *[F.coalesce(F.col(f"`{a}`.{f}"), F.lit(v)).alias(f"{a}_{f}") for a in algorithms for f, v in blank.items()])


def sweep(metrics: DataFrame, modes: Sequence[str] = ("disjoint", "nondisjoint"), most: int = 10) -> DataFrame:
    """(mode, n, rules, wall_s) for every mode and length, with a mark where there is no run."""
    spark = metrics.sparkSession
    grid = spark.range(1, most + 1).select(F.col("id").cast("int").alias("n")).crossJoin(spark.createDataFrame([(m,) for m in modes], "mode string"))
    return grid.join(metrics, ["mode", "n"], "left").select("mode", "n", F.coalesce(F.col("rules_count").cast("string"), F.lit("TIMEOUT_OR_MISSING")).alias("rules"), F.coalesce(F.col("seconds").cast("string"), F.lit("-")).alias("wall_s"))


def rule_sets(rules: DataFrame) -> DataFrame:
    """(database, digest, n): a hash over each database's displays in order; rules of one database meet in one row."""
    return rules.groupBy("database").agg(F.concat(F.substr(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("display"))), 256), F.lit(1), F.lit(12)), F.format_string(" (%d rules)", F.count("*"))).alias("digest"))


def compare_rule_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(database, left_digest, right_digest, equivalent) of two runs' rules."""
    a, b = rule_sets(left).withColumnRenamed("digest", "left_digest"), rule_sets(right).withColumnRenamed("digest", "right_digest")
    out = a.join(b, "database", "full_outer").na.fill("MISSING")
    return out.withColumn("equivalent", F.when(F.col("left_digest") == F.col("right_digest"), "OK").otherwise("DIFF"))


def percentage_delta(before: Column, after: Column) -> Column:
    """By how many percent less; null without a base."""
    return F.when(before != 0, (before - after) / before * 100)


def compare_metrics(main: DataFrame, variant: DataFrame, keys: Sequence[str] = ("database",), measures: Sequence[str] = ("runtime_seconds", "peak_rss_bytes", "query_count")) -> DataFrame:
    a = main.select(*keys, *[F.col(m).alias(f"main_{m}") for m in measures])
    b = variant.select(*keys, *[F.col(m).alias(f"variant_{m}") for m in measures])
    return a.join(b, list(keys), "full_outer").withColumns({f"improvement_{m}": percentage_delta(F.col(f"main_{m}"), F.col(f"variant_{m}")) for m in measures})


def rank_variants(runs: DataFrame) -> DataFrame:
    """(variant, databases, matching, complete, seconds, position): variants with equal rules everywhere, by total time.

    runs: variant, database, matches (rules equal to the reference variant's), seconds.
    """
    total = runs.select(F.countDistinct("database").alias("all_databases"))
    out = runs.groupBy("variant").agg(F.count("*").alias("databases"), F.sum(F.col("matches").cast("long")).alias("matching"), F.sum("seconds").alias("seconds"), F.coalesce(F.bool_and("matches"), F.lit(False)).alias("same"))
    out = out.crossJoin(total).withColumn("complete", F.col("same") & (F.col("databases") == F.col("all_databases")))
    position = F.rank().over(Window.partitionBy("complete").orderBy("seconds"))
    return out.select("variant", "databases", "matching", "complete", "seconds", F.when(F.col("complete"), position).alias("position"))


def reconcile(attempts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(database, log_attempt_count, latest_log_status, artifact_state, rule_count, disagreements): logs held against artifacts.

    artifacts: database, state, rule_count, execution_rules, execution_status, report_rules.
    """
    logs = attempts.groupBy("database").agg(F.count("*").alias("log_attempt_count"), F.max_by("status", F.struct("log_path", "attempt")).alias("latest_log_status"))
    both = logs.join(artifacts, "database", "full_outer")
    odd = lambda c, name: F.when(c, F.lit(name))
    checks = F.array_compact(
        F.array(
            odd(F.col("rule_count") != F.col("execution_rules"), "rule_json_vs_execution_rules_count"),
            odd(F.col("rule_count") != F.col("report_rules"), "rule_json_vs_report_rules_count"),
            odd(F.col("execution_status") != F.col("latest_log_status"), "execution_status_vs_latest_log_attempt"),
        )
    )
    return both.select("database", F.coalesce("log_attempt_count", F.lit(0)).alias("log_attempt_count"), F.coalesce("latest_log_status", F.lit("missing")).alias("latest_log_status"), F.coalesce("state", F.lit("missing")).alias("artifact_state"), "rule_count", F.concat_ws(",", checks).alias("disagreements"))


def select_jobs(jobs: DataFrame, names: Sequence[str] = (), part: int = 0, parts: int = 1) -> DataFrame:
    """Jobs of some databases (all without names; upper and lower case alike), dealt to hosts in order."""
    rows = jobs.where(F.lower("database").isin([n.lower() for n in names])) if names else jobs
    # Jobs are runs of a benchmark, a few hundred rows.
    return rows.withColumn("_n", F.row_number().over(Window.orderBy(F.lower("database"), "algorithm"))).where(F.pmod(F.col("_n") - 1, F.lit(parts)) == part).drop("_n")


def job_order(jobs: DataFrame) -> DataFrame:
    """Largest first, equal sizes by the hash of their names."""
    return jobs.orderBy(F.desc("size_bytes"), F.sha2(F.concat_ws(":", "algorithm", "database"), 256))
