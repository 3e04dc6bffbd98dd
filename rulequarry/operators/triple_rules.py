"""Horn rules over triples: two atoms, and chains of two body atoms, with support, head coverage and confidences.

Support counts distinct (x, y) pairs of the head with a witness. Standard confidence divides by the distinct (x, y)
pairs of the body; the partial-completeness confidence divides only by those whose x has some value in the head's
relation. Every measure of all rules of one shape is one grouped join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both_ways(facts: DataFrame) -> DataFrame:
    """(p, x, y) of every fact, and of its inverse under the name p^-1."""
    turned = facts.select(F.concat("p", F.lit("^-1")).alias("p"), F.col("o").alias("x"), F.col("s").alias("y"))
    return facts.select("p", F.col("s").alias("x"), F.col("o").alias("y")).unionByName(turned)


def _measured(bodies: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """bodies: keys and distinct (x, y); measures against every head relation."""
    head = facts.select(F.col("p").alias("head"), F.col("s").alias("x"), F.col("o").alias("y"))
    support = bodies.join(head, ["x", "y"]).groupBy(*keys, "head").agg(F.count("*").alias("support"))
    size = bodies.groupBy(*keys).agg(F.count("*").alias("body_pairs"))
    known = bodies.join(head.select("head", "x").distinct(), "x").groupBy(*keys, "head").agg(F.count("*").alias("known_pairs"))
    whole = head.groupBy("head").agg(F.count("*").alias("head_pairs"))
    out = support.join(size, keys).join(known, [*keys, "head"]).join(whole, "head")
    ratio = lambda a, b: F.col(a) / F.col(b)
    return out.select(*keys, "head", "support", ratio("support", "head_pairs").alias("head_coverage"), ratio("support", "body_pairs").alias("std_confidence"), ratio("support", "known_pairs").alias("pca_confidence"))


def implications(triples: DataFrame, least: int = 1) -> DataFrame:
    """p(x, y) => q(x, y) and p(y, x) => q(x, y); a relation does not imply itself."""
    facts = triples.select("s", "p", "o").distinct()
    out = _measured(_both_ways(facts).withColumnRenamed("p", "body").distinct(), facts, ["body"])
    return out.where((F.col("body") != F.col("head")) & (F.col("support") >= least))


def chains(triples: DataFrame, least: int = 1) -> DataFrame:
    """p(x, z) and r(z, y) => q(x, y), each body atom either way round."""
    if least < 1:
        raise ValueError(f"least must be 1 or more, not {least!r}")
    facts = triples.select("s", "p", "o").distinct()
    ways = _both_ways(facts).distinct()
    first = ways.select(F.col("p").alias("body_1"), "x", F.col("y").alias("z"))
    second = ways.select(F.col("p").alias("body_2"), F.col("x").alias("z"), "y")
    keys = ["body_1", "body_2"]
    # Only bodies that meet some head fact are measured: the others have no support, and may have a square of pairs.
    ends = facts.select(F.col("s").alias("x"), F.col("o").alias("y")).distinct()
    met = ends.join(first, "x").join(second, ["z", "y"]).select(*keys).distinct()
    bodies = first.join(F.broadcast(met), "body_1").join(second, ["body_2", "z"]).select(*keys, "x", "y").distinct()
    return _measured(bodies, facts, keys).where(F.col("support") >= least)
