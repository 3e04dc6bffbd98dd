"""What the corpus operators share: the shared folder, typed inputs, byte buffers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that vectorised byte kernels take at once; keeps their arrays small and in cache.
BLOCK_BYTES = 1 << 20
#: Rows that append() takes at once.
PASSED = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode alone, a temporary one if unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; the operators need a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rulequarry-")
        spark.conf.set("spark.checkpoint.dir", base)
        sc.setCheckpointDir(base)
    return base.rstrip("/")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once for each application: their workers import it by name."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(Path(tempfile.mkdtemp()) / f"{root.name}.zip", "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(z.filename)
        _SHIPPED.add(sc.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> None:
    """Has the driver delete a path of the shared folder when the application ends: results are read until then."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors, goes with the application."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    passing(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of any table that has such columns; null text is empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by five: such rows never teach a classifier."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """A column name after `name` that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = f"_{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def blocks(items: list[bytes] | list[str], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of items whose lengths fit in limit; a longer item stands alone."""
    at, size = 0, 0
    for i, x in enumerate(items):
        if size and size + len(x) > limit:
            yield at, i
            at, size = i, 0
        size += len(x)
    if at < len(items):
        yield at, len(items)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each length, one after another."""
    total = int(lengths.sum())
    out = np.ones(total, dtype=np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    if total:
        heads = np.concatenate(([0], np.cumsum(n)[:-1]))
        out[heads] = s - np.concatenate(([0], (s + n - 1)[:-1]))
        np.cumsum(out, out=out)
    return out


#: What this worker process keeps from task to task, by its key.
_RESIDENT: dict = {}


def resident(key, make: Callable):
    """make()'s result, built once for each worker process and kept until a task of another key starts.

    Tasks must call this by name: a dictionary that a task's own function refers to is a new one in every task.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def keep_only(key) -> None:
    """Drops what this worker process kept for tasks of other keys, and gives its memory back before the task needs more."""
    if old := [k for k in _RESIDENT if k != key]:
        for k in old:
            del _RESIDENT[k]
        gc.collect()  # tables that refer to each other would stay until the collector happens to run
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: Arrow's pool and the C library hold it otherwise while the worker is idle."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable, key=None) -> Callable:
    """run, a function from batches to batches, as tasks should call it: a worker that has ended a task holds no more
    than resident() keeps for `key`, and one that starts a task nothing of other keys."""

    def task(batches):
        keep_only(key)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def append(docs: DataFrame, text_col: str, added: str, make: Callable[[], Callable[[list[str]], list[pa.Array]]], key=None) -> DataFrame:
    """docs with columns computed from text_col, batch by batch; every other column passes through untouched.

    make() runs once a task and gives the function from texts (null: empty) to the added columns; key is that of what
    it takes from resident(). PASSED rows are taken at once. Added names that docs already has are refused.
    """
    extra = T.StructType.fromDDL(added)
    if clash := {f.name.lower() for f in extra} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table already has columns named {sorted(clash)}")
    at = docs.columns.index(text_col)
    names = [*docs.columns, *extra.names]

    def run(batches):
        f = make()
        for batch in batches:
            for a in range(0, len(batch), PASSED):
                part = batch.slice(a, PASSED)
                given = [x or "" for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *f(given)], names=names)

    return docs.mapInArrow(tidy(run, key), T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), *extra]))
