"""What the trained classifiers share: the bounded sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm.common import held_out


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled rows that are not held out: those with the smallest hashes of their ids.

    Where labels of one id disagree, 1 stands. Rows of docs that share an id are all of the sample. The chosen ids are
    broadcast: at most `rows` of them.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).groupBy("_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
