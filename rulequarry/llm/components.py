"""Connected components over edge tables, with labels that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id of edges (a, b): label is the smallest id reachable. Stored in the shared folder.

    Every round sends each id to the smallest of itself and its neighbours and moves the edges along, so they shrink
    until none is left between different ids. The smallest id of a component never moves. Each round's moves are
    written, so a lost executor costs one round at most; at the end they are followed one after another.
    """

    def normal(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    live, moves = stored(normal(edges), "edges"), []
    while True:
        both = live.select("a", "b").union(live.select("b", "a"))
        move = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "moves")
        moves.append(move)
        left, right = move.select(F.col("id").alias("a"), F.col("label").alias("x")), move.select(F.col("id").alias("b"), F.col("label").alias("y"))
        live = stored(normal(live.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
        if live.isEmpty():
            break
    labels = moves[0]
    for move in moves[1:]:
        further = move.select(F.col("id").alias("via"), F.col("label").alias("beyond"))
        labels = labels.join(further, F.col("label") == F.col("via"), "left").select("id", F.coalesce("beyond", "label").alias("label"))
    return stored(labels, "labels")
