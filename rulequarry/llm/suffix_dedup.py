"""Removal of long repeated byte strings with suffix arrays.

Every string of WINDOW bytes is judged: a byte goes if some such string that covers it also starts anywhere else.

1. Anchors. Each window's anchor is the leftmost of the grams with the smallest hash inside it, so equal windows have
   equal anchors at equal places. Windows of a text that share an anchor form a run; the run's bytes are its context.
   A window lies in exactly one run, and two equal windows lie in runs with one anchor hash. Runs whose anchor hash
   occurs once in the corpus are settled; of equal contexts one copy is looked at.
2. Shards. The distinct contexts of the other anchors are dealt by anchor hash to shards; an anchor with many contexts
   is dealt to several. Each shard builds a suffix array by Larsson-Sadakane refinement (groups of equal rank are
   refined by the ranks ahead, at a distance that triples or doubles, sorted groups are left alone) and common prefixes
   by Kasai's recurrence. A window whose neighbour among the windows in suffix order has a common prefix of WINDOW
   bytes is repeated.
3. Merging. Shards of one anchor exchange sorted keys of their distinct windows by ranges of the key; each range finds
   the keys of one shard in the others' by binary search.

Defined results: null text is empty text; texts shorter than the window lose nothing; rows that share an id, or have
none, are texts of their own; very long texts are cut into runs like any other and judged whole; an empty table gives
an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm.common import mix64, ranges, stored

WINDOW = 400
#: Bytes of an anchor gram.
GRAM = 32
#: Distinct contexts of one anchor that a shard takes.
SHARE = 128
#: Bytes of a suffix array's text, at most; a rank, a rank ahead and a position must fit in 64 bits.
SHARD_BYTES = 1 << 20
#: Bytes of text up to which a suffix array takes several anchors: sorted numbers have room for two ranks ahead.
NARROW = (1 << 16) - 1
#: Bytes of text whose anchors are found at once.
SCAN_BYTES = 1 << 20

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xD1342543DE82EF95)


def _rolled(buf: np.ndarray, size: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A hash of the `size` bytes from each position on, put together from powers of two."""
    out, done, piece, width = None, 0, _BYTE[buf], 1
    while True:
        if size & width:
            if out is None:
                out, done = piece, width
            else:
                n = len(piece) - done
                scale = np.uint64(pow(int(base), width, 1 << 64))
                out = out[:n] * scale + piece[done : done + n]
                done += width
        if done == size:
            return out
        n = len(piece) - width
        piece = piece[:n] * np.uint64(pow(int(base), width, 1 << 64)) + piece[width : width + n]
        width *= 2


def anchors(buf: np.ndarray) -> np.ndarray:
    """For each window start of a buffer, the position of its anchor."""
    grams = mix64(_rolled(buf, GRAM))
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, width = WINDOW - GRAM + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(text: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, windows, anchor) of each run of windows of a text, block by block."""
    last = len(text) - WINDOW + 1
    for a in range(0, last, SCAN_BYTES):
        n = min(SCAN_BYTES, last - a)
        anchor = anchors(np.frombuffer(text, dtype=np.uint8, count=n + WINDOW - 1, offset=a)) + a
        head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        yield from zip((head + a).tolist(), np.diff(np.append(head, n)).tolist(), anchor[head].tolist(), strict=True)


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, anchor, digest, windows, starts): for each text and distinct context, where its runs start."""

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                seen: dict[tuple, list[int]] = {}
                for start, n, at in runs(data) if len(data) >= WINDOW else ():
                    digest = hashlib.blake2b(data[start : start + n + WINDOW - 1], digest_size=16).digest()
                    seen.setdefault((hashlib.blake2b(data[at : at + GRAM], digest_size=8).digest(), digest, n), []).append(start)
                for (anchor, digest, n), starts in seen.items():
                    for part, x in zip(out, (doc, mark, int.from_bytes(anchor, "little", signed=True), digest, n, starts), strict=True):
                        part.append(x)
                if len(out[0]) > 20_000:
                    yield _batch(out)
                    out = ([], [], [], [], [], [])
            yield _batch(out)

    return rows.mapInArrow(run, "doc_id long, mark long, anchor long, digest binary, windows int, starts array<int>")


def _batch(out: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "mark", "anchor", "digest", "windows", "starts"])


def _eights(buf: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each position on as a number, zeros after the end; order: "<" or ">"."""
    padded = np.concatenate((buf, np.zeros(8, dtype=np.uint8)))
    return np.ndarray(len(buf) + 1, dtype=f"{order}u8", buffer=padded, strides=(1,)).astype(np.uint64)


def suffix_array(buf: np.ndarray) -> np.ndarray:
    """The suffixes of a buffer in order, by refinement of groups; Kasai's recurrence needs the order to be full.

    Sorted numbers hold a group's rank, the ranks ahead and the place. Buffers of up to NARROW bytes have room for two
    ranks ahead, so the distance triples with each pass; in longer ones it doubles.
    """
    n = len(buf)
    bits = n.bit_length()
    width, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    ahead = 2 if n <= NARROW else 1
    reach = min(8, (64 - bits) // 8)
    key = np.sort((_eights(buf, ">")[:n] >> np.uint64(64 - 8 * reach)) << width | np.arange(n, dtype=np.uint64))
    order = np.empty(n, dtype=np.int64)
    # Ranks are places counted from 1; 0 is the rank of what lies beyond the end.
    rank = np.zeros(n + 1, dtype=np.uint64)
    at = np.arange(n)
    while True:
        own = (key & low).view(np.int64)
        key >>= width
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(first, len(own)))
        group = np.repeat((at[first] + 1).view(np.uint64), sizes)
        rank[own] = group
        order[at] = own
        # Suffixes in groups of more than one stay open.
        still = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(still):
            return order
        own, key, at = own[still], group[still], at[still]
        for k in range(1, ahead + 1):
            key <<= width
            key |= rank[np.minimum(own + k * reach, n)]
        key <<= width
        key |= own.view(np.uint64)
        key.sort()
        reach *= ahead + 1


def common_prefixes(buf: np.ndarray, order: np.ndarray, cap: int = WINDOW) -> np.ndarray:
    """The common prefix, up to cap, of each suffix in order with the one before it, by Kasai's recurrence.

    Where the bytes before a suffix and before its neighbour agree, its value is that of the suffix one place earlier
    less one; only the others are compared.
    """
    n = len(buf)
    before = np.empty(n, dtype=np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    follows = buf[:-1] == buf[before[1:] - 1]
    follows &= before[1:] > 0
    place = np.flatnonzero(np.concatenate(([True], ~follows)))
    words = _eights(buf, "<")
    other = before[place]
    got = np.zeros(len(place), dtype=np.int64)
    limit = np.where(other >= 0, n - np.maximum(place, other), 0)
    live = np.flatnonzero(limit)
    while len(live):
        done = got[live]
        differ = words[place[live] + done] ^ words[other[live] + done]
        same = differ == 0
        lowest = np.where(same, np.uint64(1), differ & (~differ + np.uint64(1)))
        done += np.where(same, 8, np.log2(lowest.astype(np.float64)).astype(np.int64) // 8)
        got[live] = np.minimum(done, limit[live])
        live = live[same & (done < limit[live])]
    out = np.repeat(got + place, np.diff(np.append(place, n))) - np.arange(n)
    return np.minimum(out, cap)[order]


def _flat(mask: np.ndarray) -> list[int]:
    """(from, to) pairs of the runs of True, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge.tolist()


def _shard(rows: list[tuple], shared: bool) -> tuple[list[tuple], list[tuple]]:
    """rows: (anchor, digest, windows, copies, context) of one shard.

    Returns (digest, repeated window ranges) of each context, and for an anchor with more shards one row (anchor,
    keys, owners, offsets): sorted keys of distinct windows; owner -1 where no answer is needed.
    """
    sizes = np.array([len(r[4]) for r in rows])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    buf = np.frombuffer(b"\xff".join(r[4] for r in rows) + b"\xff", dtype=np.uint8)
    windows = np.array([r[2] for r in rows])
    places = ranges(starts, windows)
    owner_of = np.full(len(buf), -1, dtype=np.int64)
    owner_of[places] = np.repeat(np.arange(len(rows)), windows)
    order = suffix_array(buf)
    prefix = common_prefixes(buf, order)
    some = np.flatnonzero(owner_of[order] >= 0)
    # The common prefix of two windows is the least on the way from one to the other.
    least = np.minimum.reduceat(prefix[: some[-1] + 1], np.concatenate(([0], some[:-1] + 1))) if len(some) else prefix[:0]
    joined = least >= WINDOW
    joined[:1] = False
    window = order[some]
    repeated = joined | np.concatenate((joined[1:], [False]))
    hit = np.zeros(len(buf), dtype=bool)
    hit[window[repeated]] = True
    many = np.array([r[3] for r in rows]) > 1
    found = []
    for k, (r, a) in enumerate(zip(rows, starts.tolist(), strict=True)):
        if not many[k] and (flat := _flat(hit[a : a + r[2]])):
            found.append((r[1], flat))
    if not shared:
        return found, []
    heads = np.flatnonzero(~joined)
    first = window[heads]
    owner = owner_of[first]
    answered = repeated[heads] | many[owner]
    # Of one distinct window, any copy needs an answer only if the shard itself has not found it repeated.
    keys = np.stack((_rolled(buf, WINDOW)[first], _rolled(buf, WINDOW, _SECOND)[first]), axis=1)
    by_key = np.lexsort((keys[:, 1], keys[:, 0]))
    owners = np.where(answered, -1, owner)[by_key].astype(np.int32)
    offsets = (first - starts[owner])[by_key].astype(np.int32)
    return found, [(rows[0][0], keys[by_key], owners, offsets)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, salt): builds suffix arrays over whole shards of one anchor's part or of many anchors."""
    held: list[tuple] = []
    size, key, alone = 0, None, False
    # Where the last anchor's rows begin in held, and the bytes before them.
    begun, before = 0, 0

    def done(rows):
        found, keys = _shard(rows, alone)
        kind = [0] * len(found)
        anchor, digests, flat = [0] * len(found), [[d] for d, _ in found], [x for _, x in found]
        packed: list[bytes | None] = [None] * len(found)
        part = [0] * len(found)
        for a, pairs, owners, offsets in keys:
            width = key[2]
            cell = (pairs[:, 0] >> np.uint64(40)).astype(np.int64) * width >> 24
            for c in range(width):
                x, y = np.searchsorted(cell, c), np.searchsorted(cell, c, side="right")
                if y > x:
                    used, number = np.unique(owners[x:y][owners[x:y] >= 0], return_inverse=True)
                    local = np.full(y - x, -1, dtype=np.int32)
                    local[owners[x:y] >= 0] = number
                    kind.append(1)
                    anchor.append(a)
                    digests.append([held[k][1] for k in used])
                    flat.append([])
                    packed.append(pairs[x:y].tobytes() + local.tobytes() + offsets[x:y].tobytes())
                    part.append(c)
        return pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(anchor, pa.int64()), pa.array(part, pa.int32()), pa.array(digests, pa.list_(pa.binary())), pa.array(flat, pa.list_(pa.int32())), pa.array(packed, pa.binary())],
            names=["kind", "anchor", "part", "digests", "flat", "packed"],
        )

    for batch in batches:
        for anchor, salt, shares, digest, windows, copies, context in zip(*(batch.column(c).to_pylist() for c in ("anchor", "salt", "shares", "digest", "windows", "copies", "context")), strict=True):
            own = (anchor, salt, shares)
            if own != key:
                if held and (alone or shares > 1 or size >= NARROW):
                    yield done(held)
                    held, size = [], 0
                begun, before = len(held), size
            # Anchors that do not fit in one narrow shard are looked at apart.
            if begun and size + len(context) + 1 > NARROW:
                yield done(held[:begun])
                held, size = held[begun:], size - before
                begun, before = 0, 0
            # One shard never outgrows the 20 bits of a place: an anchor's part is cut, and its parts meet when merged.
            if held and size + len(context) + 1 > SHARD_BYTES - 1:
                yield done(held)
                held, size = [], 0
            key, alone = own, shares > 1
            held.append((anchor, digest, windows, copies, context))
            size += len(context) + 1
    if held:
        yield done(held)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, part): the windows of each shard that another shard has too."""
    key, rows = None, []

    def done():
        parsed = []
        for digests, packed in rows:
            n = len(packed) // 24
            pairs = np.frombuffer(packed, dtype=np.uint64, count=2 * n).reshape(n, 2)
            rest = np.frombuffer(packed, dtype=np.int32, offset=16 * n)
            parsed.append((digests, pairs, rest[:n], rest[n:]))
        keys = np.concatenate([p[1] for p in parsed])
        keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
        head = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
        shards = np.diff(np.append(np.flatnonzero(head), len(keys)))
        first, second = keys[head, 0].copy(), keys[head, 1].copy()
        out: dict[bytes, list[int]] = {}
        for digests, pairs, owner, offset in parsed:
            asked = np.flatnonzero(owner >= 0)
            at = np.searchsorted(first, pairs[asked, 0])
            while (on := second[at] != pairs[asked, 1]).any():
                at = at + on
            for i in asked[shards[at] > 1]:
                out.setdefault(digests[owner[i]], []).append(int(offset[i]))
        flat = []
        for offsets in out.values():
            mask = np.zeros(max(offsets) + 1, dtype=bool)
            mask[offsets] = True
            flat.append(_flat(mask))
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(flat, pa.list_(pa.int32()))], names=["digest", "flat"])

    for batch in batches:
        for anchor, part, digests, packed in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "digests", "packed")), strict=True):
            if key != (anchor, part):
                if len(rows) > 1:
                    yield done()
                key, rows = (anchor, part), []
            rows.append((digests, packed))
    if len(rows) > 1:
        yield done()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, spans): for each text with repeated windows, structs (starts of runs, windows, flat ranges or null for all)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _texts(docs, id_col, text_col)
    found = stored(occurrences(rows), "runs")
    often = found.groupBy("anchor").agg(F.sum(F.size("starts")).alias("n")).where("n > 1").select("anchor")
    again = stored(found.join(often, "anchor", "left_semi"), "runs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", F.col("starts")[0].alias("start"))).alias("first")
    contexts = stored(again.groupBy("anchor", "digest", "windows").agg(F.sum(F.size("starts")).alias("copies"), first), "contexts")
    shares = contexts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
    asked = contexts.join(shares, "anchor").select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark"), F.col("first.start").alias("start"), "anchor", "digest", "windows", "copies", "shares", F.pmod(F.xxhash64("digest"), F.col("shares")).cast("int").alias("salt")
    )
    by_text = asked.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "anchor", "salt", "shares", "digest", "windows", "copies")).alias("asked"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])
    holding = rows.join(by_text, same(rows, by_text)).select(rows["text"], by_text["asked"], rows["doc_id"], rows["mark"])

    def cut(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            size = 0
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in wanted:
                    context = data[x["start"] : x["start"] + x["windows"] + WINDOW - 1]
                    for part, y in zip(out, (x["anchor"], x["salt"], x["shares"], x["digest"], x["windows"], x["copies"], context), strict=True):
                        part.append(y)
                    size += len(context)
                if size > 4 << 20:
                    yield _contexts(out)
                    out, size = ([], [], [], [], [], [], []), 0
            yield _contexts(out)

    cuts = holding.select("text", "asked").mapInArrow(cut, "anchor long, salt int, shares int, digest binary, windows int, copies long, context binary")
    built = stored(cuts.repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "salt", "digest").mapInArrow(_shards, "kind int, anchor long, part int, digests array<binary>, flat array<int>, packed binary"), "shards")
    inside = built.where("kind = 0").select(F.col("digests")[0].alias("digest"), "flat")
    merging = built.where("kind = 1").select("anchor", "part", "digests", "packed").repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part")
    across = merging.mapInArrow(_merge, "digest binary, flat array<int>")
    partly = inside.unionByName(across).groupBy("digest").agg(F.flatten(F.collect_list("flat")).alias("flat"))
    whole = contexts.where("copies > 1").select("digest", F.lit(None).cast("array<int>").alias("flat"))
    settled = stored(whole.unionByName(partly.join(whole.select("digest"), "digest", "left_anti")), "settled")
    return again.join(settled, "digest").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("starts", "windows", "flat")).alias("spans"))


def _contexts(out: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["anchor", "salt", "shares", "digest", "windows", "copies", "context"])


def _removed(size: int, spans: list[dict] | None) -> list[int]:
    """Maximal runs of bytes to remove, flat."""
    cover = np.zeros(size + 1, dtype=np.int32)
    for s in spans or ():
        flat = s["flat"] if s["flat"] is not None else [0, s["windows"]]
        starts = np.asarray(s["starts"], dtype=np.int64)
        for a, b in zip(flat[::2], flat[1::2], strict=True):
            np.add.at(cover, starts + a, 1)
            np.add.at(cover, starts + (b - 1 + WINDOW), -1)
    return _flat(np.cumsum(cover[:-1]) > 0)


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans flat array of removed byte ranges, rest binary) of every row."""
    rows = _texts(docs, id_col, text_col)
    spans = repeated(docs, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spans")
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["_id"]) & (rows["mark"] == spans["_mark"]), "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            sizes, flat, rest = [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                cuts = _removed(len(data), own) if own else []
                edges = [0, *cuts, len(data)]
                sizes.append(len(data))
                flat.append(cuts)
                rest.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(flat, pa.list_(pa.int64())), pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "spans", "rest"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<long>, rest binary")


def digest(stripped: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of strip()'s rows."""
    return stripped.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("rest")).alias("n_removed"), F.floor(F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256"))
