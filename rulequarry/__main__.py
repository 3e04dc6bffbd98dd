"""python -m rulequarry: run, audit, import-rdf, ind, smoke over a folder of Parquet tables.

The keys of the tables come from a JSON file: {"primary_keys": {table: [column]}, "foreign_keys": [[table, column,
table, column]]}. No external programs, queues, mails or downloads are run.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from rulequarry.catalog import Catalog, ForeignKey
from rulequarry.functions.relations import parse_dependency
from rulequarry.functions.text import duration
from rulequarry.operators import audit, joinability, miner, triples
from rulequarry.sources import rdf, rules


def _catalog(spark: SparkSession, args: argparse.Namespace) -> Catalog:
    keys = json.loads(Path(args.keys).read_text())
    names = keys.get("tables") or sorted(keys["primary_keys"])
    out = Catalog.read(spark, args.tables, names, keys["primary_keys"], keys.get("foreign_keys", ()), kind=args.format)
    out.check_foreign_keys()
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """Mines rules, writes them as JSON lines and shows the best."""
    settings = miner.Settings.of(walk_length=args.walk_length, max_tables=args.max_tables, max_variables=args.max_variables, disjoint_semantics=args.disjoint, joinability=args.joinability, support_threshold=args.support, timeout=args.timeout)
    found = miner.rules_frame(spark, miner.discover(_catalog(spark, args), settings)).cache()
    rules.write_rules(found, args.output)
    miner.top_rules(found).show(truncate=False)
    miner.statistics(found).show()


def audit_rules(spark: SparkSession, args: argparse.Namespace) -> None:
    """Audits result files of other miners against the target's."""
    c = _catalog(spark, args)
    given = rules.read_results(spark, args.results).collect()  # rules, as many as their authors wrote
    inclusion = lambda r: {k: r[k] for k in ("table_dependant", "columns_dependant", "table_referenced", "columns_referenced")} if r["type"] == "InclusionDependency" else None
    targets = [parse_dependency(r["display"]) for r in given if r["algorithm"] == args.target]
    sources = [audit.Source(r["algorithm"], r["database"], r["rule_index"], r["display"] or "", inclusion(r)) for r in given if r["algorithm"] != args.target]
    records = audit.records_frame(spark, audit.audit(c, sources, targets)).cache()
    rules.write_records(records, f"{args.output}/records")
    rules.write_csv(audit.funnel(records), f"{args.output}/funnel")
    rules.write_csv(audit.exclusions(records), f"{args.output}/exclusions")
    audit.totals(records).write.mode("overwrite").json(f"{args.output}/summary")
    audit.funnel(records).show(truncate=False)


def import_rdf(spark: SparkSession, args: argparse.Namespace) -> None:
    """Writes an RDF graph as an archive of tables and its variants."""
    read = rdf.read_turtle if args.input.endswith(".ttl") else rdf.read_ntriples
    graph = read(spark, args.input)
    statements = rdf.classified(graph).cache()
    archived = rdf.write_archive(statements, graph, f"{args.output}/archive", {"input_path": args.input})
    counts = {name: rdf.write_variant(statements, name, f"{args.output}/{name}", archived) for name in rdf.VARIANTS}
    kinds = {r["category"]: r["count"] for r in statements.groupBy("category").count().collect()}
    manifest = {"input": args.input, "statements": sum(kinds.values()), "categories": dict(sorted(kinds.items())), "variants": counts}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.output}/manifest")
    statements.groupBy("category").count().show()


def inclusions(spark: SparkSession, args: argparse.Namespace) -> None:
    """Unary inclusion dependencies between all columns."""
    found = joinability.inclusion_dependencies(joinability.attribute_values(_catalog(spark, args), falsy=True))
    found.write.mode("overwrite").json(args.output)
    found.show(truncate=False)


def to_triples(spark: SparkSession, args: argparse.Namespace) -> None:
    """The tables as triples, with the mapping of predicates."""
    c = _catalog(spark, args)
    triples.write_tsv(triples.triples(c), f"{args.output}/triples")
    spark.createDataFrame([(json.dumps(triples.mapping(c), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.output}/mapping")


def smoke(spark: SparkSession, args: argparse.Namespace) -> None:
    """Mines a two-table example."""
    c = Catalog({"parent": spark.createDataFrame([(1,), (2,)], "id int"), "child": spark.createDataFrame([(10, 1), (11, 1)], "id int, parent_id int")}, {"parent": ("id",), "child": ("id",)}, (ForeignKey("child", "parent_id", "parent", "id"),))
    for rule in miner.discover(c):
        print(rule.display, rule.support, round(rule.confidence, 3))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rulequarry", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name, f, tables=True, output=True):
        p = commands.add_parser(name, help=f.__doc__.splitlines()[0])
        p.set_defaults(f=f)
        if tables:
            p.add_argument("--tables", required=True)
            p.add_argument("--keys", required=True)
            p.add_argument("--format", default="parquet")
        if output:
            p.add_argument("--output", required=True)
        return p

    p = command("run", run)
    for name, default in (("walk-length", 3), ("max-tables", 3), ("max-variables", 3), ("support", 1)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--disjoint", action="store_true")
    p.add_argument("--joinability", default="fk")
    p.add_argument("--timeout", type=float)
    p = command("audit", audit_rules)
    p.add_argument("--results", required=True)
    p.add_argument("--target", required=True)
    command("import-rdf", import_rdf, tables=False).add_argument("--input", required=True)
    command("ind", inclusions)
    command("triples", to_triples)
    command("smoke", smoke, tables=False, output=False)
    args = parser.parse_args(argv)
    began = time.monotonic()
    args.f(SparkSession.builder.appName(f"rulequarry {args.command}").getOrCreate(), args)
    print(f"done in {duration(time.monotonic() - began)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
