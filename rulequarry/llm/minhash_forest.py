"""Near-duplicates: an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Each text becomes its set of hashed shingles of five words. Texts with one set are one node, so exact copies never
   multiply. A node has ORDERS labels, each of DEEP minima that no other label reads, and one bit of every minimum.
2. The forest is the nodes sorted by each label. Rows next to each other have the longest common prefixes of their
   order; those with BASE minima in common are neighbours, and candidates if their bits agree about as often as the
   bits of a pair at the threshold do.
3. Each node's likeliest candidate is tested on full sets; links join nodes to classes, so that a group of copies is
   one class before anything is compared with all of it. Candidates inside a class need no test.
4. What that leaves open: candidates that were not tested, and those that are no neighbours. A region is the nodes with
   a common prefix. Regions that still hold more than one class are read again, across classes, at the depth at which
   they have at most REGION nodes (BASE to DEEP, in each order on its own); a region that is larger at its deepest is
   read in pairs of blocks. No region is left out.
5. Nodes that open candidates connect are compared on full sets, all of them, in pairs of blocks of bounded size.

A pair at similarity s meets in no order with the chance (1 - s ** depth) ** ORDERS: 5.6e-10 at 0.80 and BASE, 5.2e-6 at
0.80 and DEEP, 5.9e-9 at 0.85 and DEEP, for ideal minima. The bits' agreement lies LEEWAY deviations lower by chance
once in 10 million.

Defined results: null, empty and wordless texts have an empty set, are linked with nothing and kept; a row with a null
id is linked with nothing, has a null component and is kept; rows that share an id are reported each, by their own
text, and deduplicated() keeps one of rows that share id and text; texts of any length are read whole; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm.common import free_name, mix64, stored, tidy
from rulequarry.llm.components import components
from rulequarry.llm.textkernel import shingle_sets

SHINGLE_WORDS = 5
#: Links need 100 * intersection >= percent * union: the default of near_duplicates, and that of deduplicated.
PERCENT = 85
STAGE_PERCENT = 80
#: Sorted orders, the minima of a label, and the common prefix that makes neighbours.
ORDERS = 40
DEEP = 6
BASE = 4
#: Minima of a signature; each gives a bit, the first ORDERS * DEEP give the labels.
SLOTS = 256
LEEWAY = 5.2
#: Nodes of a region that is read at once.
REGION = 512
#: Nodes and shingles of a block of sets.
BLOCK_NODES = 512
BLOCK_SHINGLES = 1 << 18

_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def agreeing(percent: int) -> int:
    """Bits that must agree: those of a pair at the threshold do, but for LEEWAY deviations."""
    q = (1 + percent / 100) / 2
    return math.floor(SLOTS * q - LEEWAY * math.sqrt(SLOTS * q * (1 - q)))


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, SLOTS) 32-bit minima; texts without shingles have zeros."""
    out = np.zeros((len(offsets) - 1, SLOTS), dtype=np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[full]
        for k in range(SLOTS):
            out[full, k] = np.minimum.reduceat((hashes ^ _XOR[k]) * _ODD[k], starts) >> np.uint64(32)
    return out


def labels(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """((texts, ORDERS) hashes of the first BASE minima, (texts, ORDERS) the two minima after them, (texts, SLOTS / 8) bits)."""
    wide = sig[:, : ORDERS * DEEP].astype(np.uint64).reshape(-1, ORDERS, DEEP)
    key = np.broadcast_to(np.arange(1, ORDERS + 1, dtype=np.uint64), wide.shape[:2]).copy()
    for k in range(BASE):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, k])
    tail = (wide[:, :, BASE] << np.uint64(32)) | wide[:, :, BASE + 1]
    return key.view(np.int64), tail.view(np.int64), np.packbits((sig & np.uint32(1)).astype(bool), axis=1)


def _some(batch: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(batch):
        size += len(t)
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(batch):
        yield at, len(batch)


def _digests(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(hashes[x:y].tobytes(), digest_size=16).digest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes, all of one length, as a binary array."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, text): mark tells the texts of one id apart; null text is empty text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def sketch(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, n, digest, labels, bits) of texts() rows: set size, digest of the set, its labels and bits."""

    def run(batches):
        for batch in batches:
            given = batch.column("text").to_pylist()
            for a, b in _some(given):
                h, at = shingle_sets(given[a:b], SHINGLE_WORDS)
                key, tail, bits = labels(signatures(h, at))
                both = np.concatenate((key, tail), axis=1).view(np.uint8)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(np.diff(at)), pa.array(_digests(h, at), pa.binary()), _packed(both), _packed(bits)], names=["doc_id", "mark", "n", "digest", "labels", "bits"])

    return rows.mapInArrow(tidy(run), "doc_id long, mark long, n long, digest binary, labels binary, bits binary")


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return SLOTS - np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32)


MET = "a long, b long, agree int, key long, tail long, node long, bits binary"


def forest(nodes: DataFrame, percent: int) -> DataFrame:
    """Sorts the nodes by each label and reads neighbours; stored rows of two kinds (MET).

    (a, b, agree): neighbours whose bits agree often enough. (key, tail, node, bits): a node of a region of two or more,
    or at either end of a partition, where a region may go on.
    """
    least, parts = agreeing(percent), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                both = _unpacked(batch.column("labels"), ORDERS * 16).view(np.int64)
                node, bits = batch.column("node").to_numpy(), _unpacked(batch.column("bits"), SLOTS // 8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, :ORDERS].T.reshape(-1)), pa.array(both[:, ORDERS:].T.reshape(-1)), pa.array(np.tile(node, ORDERS)), _packed(np.tile(bits, (ORDERS, 1)))], names=["key", "tail", "node", "bits"]
                )

    def met(key, tail, node, bits, member, a, b, agree):
        n, m = len(a), int(member.sum())
        fill = lambda x, y, kind: pa.concat_arrays([x, pa.nulls(m, kind)]) if y is None else pa.concat_arrays([pa.nulls(n, kind), y])
        some = lambda x: pa.array(x[member])
        return pa.RecordBatch.from_arrays(
            [fill(pa.array(a), None, pa.int64()), fill(pa.array(b), None, pa.int64()), fill(pa.array(agree, pa.int32()), None, pa.int32())]
            + [fill(None, some(x), pa.int64()) for x in (key, tail, node)]
            + [fill(None, _packed(bits[member]), pa.binary())],
            names=["a", "b", "agree", "key", "tail", "node", "bits"],
        )

    def read(batches):
        held = None  # the last row waits for the one after it
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in ("key", "tail", "node")] + [_unpacked(batch.column("bits"), SLOTS // 8)]
            first = held is None
            key, tail, node, bits = now if first else (np.concatenate((x, y)) for x, y in zip(held[0], now, strict=True))
            same = key[1:] == key[:-1]
            member = np.concatenate(([first or held[1]], same)) | np.concatenate((same, [False]))
            at = np.flatnonzero(same)
            agree = _agree(bits[at], bits[at + 1])
            at, agree = at[agree >= least], agree[agree >= least]
            x, y = node[at], node[at + 1]
            last = bool(member[-1])
            member[-1] = False
            yield met(key, tail, node, bits, member, np.minimum(x, y), np.maximum(x, y), agree)
            held = ([v[-1:] for v in (key, tail, node, bits)], last)
        if held:
            none = np.zeros(0, dtype=np.int64)
            yield met(*held[0], np.ones(1, dtype=bool), none, none, none)

    rows = nodes.select("node", "labels", "bits").mapInArrow(tidy(dealt), "key long, tail long, node long, bits binary")
    return stored(rows.repartitionByRange(parts, "key", "tail", "node").sortWithinPartitions("key", "tail", "node").mapInArrow(tidy(read), MET), "forest")


def _classes(nodes: DataFrame, joined: DataFrame | None, column: str, name: str) -> DataFrame:
    """nodes with the class of one of its columns: the smallest node that links lead to."""
    if joined is None:
        return nodes.withColumn(name, F.col(column))
    own = joined.select(F.col("id").alias(f"_{name}"), F.col("label").alias(f"_{name}_label"))
    return nodes.join(own, F.col(column) == F.col(f"_{name}"), "left").withColumn(name, F.coalesce(f"_{name}_label", column)).drop(f"_{name}", f"_{name}_label")


def _open(pairs: DataFrame, joined: DataFrame | None) -> DataFrame:
    """The pairs (a, b, agree) whose sides are in different classes."""
    return _classes(_classes(pairs, joined, "a", "one"), joined, "b", "two").where("one <> two").select("a", "b", "agree")


def open_forest(met: DataFrame, joined: DataFrame | None, percent: int) -> DataFrame:
    """(a, b): candidates across classes in every region that has more than one, at the depth that the region needs.

    Of the candidates of a unit of work only those are given that span them, so rows grow with nodes, not with pairs.
    """
    least, spark = agreeing(percent), met.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = _classes(met.where("node IS NOT NULL").select("key", "tail", "node", "bits"), joined, "node", "class")
    units = []
    for depth in range(BASE, DEEP + 1):
        prefix = F.xxhash64("key", F.shiftright("tail", 32 * (DEEP - depth))) if depth > BASE else F.col("key")
        left = left.withColumn("region", prefix)
        # Of two nodes that are alone the forest has told already.
        mixed = left.groupBy("region").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).where("n > 2 AND low <> high").select("region", "n")
        left = stored(left.join(stored(mixed, "mixed"), "region"), "regions")
        units.append(left.where(F.col("n") <= REGION).select("region", F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("block"), "node", "class", "bits"))
        left = left.where(F.col("n") > REGION).select("key", "tail", "node", "bits", "class", "n", "region")
        if left.isEmpty():
            break
        if depth < DEEP:
            left = left.drop("n", "region")
    else:
        blocks = F.ceil(F.col("n") / REGION).cast("int")
        cut = left.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units.append(cut.select("region", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "class", "bits"))
    dealt = reduce(DataFrame.unionByName, units).repartition(parts, "region", "one", "two").sortWithinPartitions("region", "one", "two", "block", "node")

    def pairs(rows):
        block = np.array([r[0] for r in rows])
        node, kind = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2))
        bits = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint64).reshape(len(rows), -1)
        split = int(np.searchsorted(block, block[-1])) if block[0] != block[-1] else 0
        group = np.arange(len(rows))
        a, b = [], []
        for i in range(split or len(rows) - 1):
            start = split or i + 1
            agree = SLOTS - np.bitwise_count(bits[i] ^ bits[start:]).sum(axis=1, dtype=np.int32)
            met = start + np.flatnonzero((agree >= least) & (kind[start:] != kind[i]))
            others, first = np.unique(group[met], return_index=True)
            first = met[first[others != group[i]]]
            if len(first):
                a += [int(node[i])] * len(first)
                b += node[first].tolist()
                group[np.isin(group, others)] = group[i]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        unit, rows = None, []

        def done():
            # A unit of two blocks may have drawn rows of one only.
            return len(rows) > 1 and (unit[1] == unit[2] or rows[0][0] != rows[-1][0])

        for batch in batches:
            for region, one, two, block, node, kind, bits in zip(*(batch.column(c).to_pylist() for c in ("region", "one", "two", "block", "node", "class", "bits")), strict=True):
                if unit != (region, one, two):
                    if unit and done():
                        yield pairs(rows)
                    unit, rows = (region, one, two), []
                rows.append((block, node, kind, bits))
        if unit and done():
            yield pairs(rows)

    return dealt.mapInArrow(tidy(run), "a long, b long")


def shingles_of(rows: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, n, shingles) of every node in the pairs, from its text; stored."""
    asked = nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node").select("node", "doc_id", "mark")

    def run(batches):
        for batch in batches:
            given = batch.column("text").to_pylist()
            for a, b in _some(given):
                h, at = shingle_sets(given[a:b], SHINGLE_WORDS)
                part = batch.slice(a, b - a)
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), sets], names=["node", "shingles"])

    held = rows.join(asked, ["doc_id", "mark"]).select("node", "text").mapInArrow(tidy(run), "node long, shingles array<long>")
    return stored(held, "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets overlap enough; stored."""
    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    shared = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), (F.size("x") + F.size("y")).cast("long").alias("both"))
    return stored(shared.where(F.col("shared") * 100 >= (F.col("both") - F.col("shared")) * percent).select("a", "b"), "links")


def _linked(sets: list[np.ndarray], kinds: list[int], apart: int, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join the nodes' classes as far as they go; with apart, only pairs (i < apart <= j) are compared."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    # A shingle of one node adds to no intersection.
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner = owner[shared]
    column = np.cumsum(np.concatenate(([0], (np.diff(column[shared]) != 0).astype(np.int64)))) if shared.any() else np.zeros(0, dtype=np.int64)
    rows = apart or n
    common = np.zeros((rows, n - apart), dtype=np.float32)
    width = 2048
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        grid = np.zeros((n, width), dtype=np.float32)
        grid[owner[a:b], column[a:b] - k * width] = 1
        common += grid[:rows] @ grid[apart:].T
    inter = common.astype(np.int64)
    union = sizes[:rows, None] + sizes[None, apart:] - inter
    kind = np.unique(np.asarray(kinds, dtype=np.int64), return_inverse=True)[1]
    i, j = np.nonzero((100 * inter >= percent * union) & (inter > 0) & (kind[:rows, None] != kind[None, apart:]))
    j = j + apart
    keep = i < j
    # One link joins two classes.
    _, one = np.unique(np.minimum(kind[i], kind[j])[keep] * n + np.maximum(kind[i], kind[j])[keep], return_index=True)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i[keep][one].tolist(), j[keep][one].tolist(), strict=True):
        ra, rb = root(int(kind[a])), root(int(kind[b]))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (grp, one, two): compares each unit of work as its last row arrives."""
    key, rows = None, []

    def done() -> pa.RecordBatch | None:
        by_side = [[r for r in rows if r[1] == key[1]], [r for r in rows if r[1] != key[1]]] if key[1] != key[2] else [rows, []]
        if len(rows) < 2 or key[1] != key[2] and not all(by_side):
            return None
        ordered = by_side[0] + by_side[1]
        links = _linked([np.frombuffer(r[2], dtype=np.uint64) for r in ordered], [r[3] for r in ordered], len(by_side[0]) if by_side[1] else 0, percent)
        return pa.RecordBatch.from_arrays([pa.array([ordered[i][0] for i, _ in links], pa.int64()), pa.array([ordered[j][0] for _, j in links], pa.int64())], names=["a", "b"]) if links else None

    for batch in batches:
        for grp, one, two, block, node, shingles, kind in zip(*(batch.column(c).to_pylist() for c in ("grp", "one", "two", "block", "node", "shingles", "class")), strict=True):
            if key != (grp, one, two):
                if key is not None and (out := done()) is not None:
                    yield out
                key, rows = (grp, one, two), []
            rows.append((node, block, shingles, kind))
    if key is not None and (out := done()) is not None:
        yield out


def compared(edges: DataFrame, joined: DataFrame | None, rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join classes, from comparing all nodes of each group that the edges connect; stored.

    A group is cut into blocks, and two blocks are one unit of work, so a unit is bounded however large a group is.
    """
    groups = components(edges).select(F.col("id").alias("node"), F.col("label").alias("grp"))
    sized = _classes(groups.join(nodes.select("node", "doc_id", "mark", "n"), "node"), joined, "node", "class")
    many = groups.join(nodes.select("node", "n"), "node").groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = stored(sized.join(stored(many, "many"), "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("n"), "placed")
    names = ["node", "grp", "class", "blocks", "block"]

    def shingles(batches):
        for batch in batches:
            given = batch.column("text").to_pylist()
            for a, b in _some(given):
                h, at = shingle_sets(given[a:b], SHINGLE_WORDS)
                part = batch.slice(a, b - a)
                sets = pa.array([h[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sets], names=[*names, "shingles"])

    sets = rows.join(placed, ["doc_id", "mark"]).select(*names, "text").mapInArrow(tidy(shingles), "node long, grp long, class long, blocks int, block int, shingles binary")
    units = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "shingles", "class")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(parts, "grp", "one", "two").sortWithinPartitions("grp", "one", "two")
    return stored(dealt.mapInArrow(tidy(lambda batches: _compare(batches, percent)), "a long, b long"), "links")


def classes(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame | None:
    """(id, label) of every node that has a link: label is the smallest node reachable. None if no two nodes are alike."""
    met = forest(nodes, percent)
    near = stored(met.where("a IS NOT NULL").groupBy("a", "b").agg(F.max("agree").alias("agree")), "near")
    if near.isEmpty():
        return None
    ways = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "agree").union(near.select("b", "a", "agree"))
    best = ways.groupBy("x").agg(F.max(F.struct("agree", "y")).alias("best"))
    tested = stored(best.select(F.least("x", "best.y").alias("a"), F.greatest("x", "best.y").alias("b")).distinct(), "tested")
    links = confirmed(tested, shingles_of(rows, nodes, tested), percent)
    joined = components(links)
    left = _open(near.join(tested, ["a", "b"], "left_anti"), joined).select("a", "b")
    edges = stored(left.union(open_forest(met, joined, percent)), "open")
    if edges.isEmpty():
        return joined
    return components(links.union(compared(edges, joined, rows, nodes, percent)))


def _judged(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, kept) of every row."""
    rows = texts(docs, id_col, text_col)
    sketches = stored(sketch(rows), "sketches")
    named = sketches.where("n > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "mark")).alias("first")
    alike = named.groupBy("digest").agg(first, F.first("n").alias("n"), F.first("labels").alias("labels"), F.first("bits").alias("bits"))
    nodes = stored(alike.select(F.monotonically_increasing_id().alias("node"), "digest", "first.doc_id", "first.mark", "n", "labels", "bits"), "nodes")
    joined = classes(rows, nodes, percent)
    grouped = _classes(nodes.select("node", "digest", "doc_id"), joined, "node", "class")
    smallest = grouped.groupBy("class").agg(F.min("doc_id").alias("component"))
    named_by = grouped.join(smallest, "class").select("digest", "component")
    out = sketches.select("doc_id", "mark", F.col("n").alias("n_shingles"), "digest").join(named_by, "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "mark", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return _judged(docs, id_col, text_col, percent).drop("mark")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = STAGE_PERCENT) -> DataFrame:
    """The rows of docs that near_duplicates() keeps: one document of each group, and rows without an id."""
    judged = stored(_judged(docs, id_col, text_col, percent).where("doc_id IS NOT NULL").groupBy("doc_id", "mark").agg(F.min("kept").alias("kept"), F.count("*").alias("times")), "judged")
    key, mark, gone, own = (free_name(docs, x) for x in ("key", "mark", "gone", "own"))
    marked = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(mark, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    told = judged.where("NOT kept").select(F.col("doc_id").alias(gone), F.col("mark").alias(own))
    left = marked.join(told, (F.col(key) == F.col(gone)) & (F.col(mark) == F.col(own)), "left_anti")
    twice = stored(judged.where("kept AND times > 1").select(F.col("doc_id").alias(gone), F.col("mark").alias(own)), "twice")
    if not twice.isEmpty():
        on = (F.col(key) == F.col(gone)) & (F.col(mark) == F.col(own))
        left = left.join(twice, on, "left_anti").unionByName(left.join(twice, on, "left_semi").dropDuplicates([key, mark]))
    return left.drop(key, mark)
