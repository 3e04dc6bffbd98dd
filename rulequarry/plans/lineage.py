"""Cutting lineage: what many later plans read is written once to the folder that executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in spark.checkpoint.dir; in local mode alone, in a temporary folder if that is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; a folder that all executors share is needed")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="rulequarry-"))
    return df.checkpoint()
