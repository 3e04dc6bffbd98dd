"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and items are reduced to lower-case words with one space around each. Every window of ten consecutive words of
an item is a pattern. A table gives, for the block of bytes at the end of the search window, how far the window may
move without missing a pattern; where it may not move, the block's hash selects the bucket of patterns that end their
common length with it, their first bytes and then the whole pattern are compared. Many stretches of text are searched
side by side, so the table lookups are array operations.

The items are broadcast in chunks of a fixed size, one after another, so a large benchmark adds passes over the texts
instead of growing a broadcast.

Defined results: null or wordless text has no words and no hit; items without words or without an id match nothing;
rows with null or repeated ids are searched like any other; texts of any length are searched whole; an empty benchmark
hits nothing; mark() refuses columns that have the names it adds, clean() works beside any.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm.common import append, blocks, free_name, ranges, resident, stored

WINDOW_WORDS = 10
#: Bytes of items that one broadcast holds.
CHUNK_BYTES = 32 << 20
#: Patterns are searched by length class, since the shortest of a class bounds its shifts.
CLASS_BYTES = (0, 8, 32)
LANES = 4096
HASH_BITS = 18

# A-Z become a-z; 0-9, a-z and all bytes of non-ASCII characters stay; every other byte is a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows(text: str, size: int = WINDOW_WORDS) -> list[bytes]:
    """The patterns of an item: its windows, with a space before and after every word."""
    w = words(text)
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))] if w else []


class WuManber:
    """The tables of one class of patterns; find() gives (start, pattern) of every occurrence in a buffer."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = min(5 if m >= 32 else 4 if m >= 8 else 2, m)
        grid = np.frombuffer(b"".join(p[:m] for p in patterns), dtype=np.uint8).reshape(-1, m)
        self.shift = np.full(1 << HASH_BITS, m - self.block + 1, dtype=np.int64)
        for end in range(self.block - 1, m):
            np.minimum.at(self.shift, self._hash([grid[:, end - self.block + 1 + i] for i in range(self.block)]), m - 1 - end)
        last = self._hash([grid[:, m - self.block + i] for i in range(self.block)])
        self.order = np.argsort(last, kind="stable")
        self.suffix = last[self.order]
        self.head = min(8, m)
        self.heads = self._pack([grid[self.order, i] for i in range(self.head)])

    @staticmethod
    def _pack(columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            out = out << np.uint64(8) | c.astype(np.uint64)
        return out

    def _hash(self, columns: list[np.ndarray]) -> np.ndarray:
        return ((self._pack(columns) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def find(self, text: bytes) -> list[tuple[int, int]]:
        n = len(text)
        if n < self.m:
            return []
        buf = np.frombuffer(text, dtype=np.uint8)
        lanes = max(1, min(LANES, (n - self.m + 1) // 64))
        bounds = np.linspace(self.m - 1, n, lanes + 1).astype(np.int64)
        at, end = bounds[:-1].copy(), bounds[1:]
        stops, hashes = [], []
        while len(at):
            h = self._hash([buf[at - self.block + 1 + i] for i in range(self.block)])
            move = self.shift[h]
            stopped = move == 0
            if stopped.any():
                stops.append(at[stopped])
                hashes.append(h[stopped])
            at = at + np.maximum(move, 1)
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
        if not stops:
            return []
        start, h = np.concatenate(stops) - self.m + 1, np.concatenate(hashes)
        first, after = np.searchsorted(self.suffix, h), np.searchsorted(self.suffix, h, side="right")
        heads = self._pack([buf[start + i] for i in range(self.head)])
        which = np.repeat(np.arange(len(start)), after - first)
        slot = ranges(first, after - first)
        same = self.heads[slot] == heads[which]
        found = []
        for s, k in zip(start[which[same]].tolist(), self.order[slot[same]].tolist(), strict=True):
            if text.startswith(self.patterns[k], s):
                found.append((s, k))
        return found


class Searcher:
    """All patterns of a chunk of items, by class."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        owners: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            for p in windows(text, size):
                owners[p].add(item)
        classes: dict[int, list[bytes]] = defaultdict(list)
        for p in sorted(owners):
            classes[max(c for c in CLASS_BYTES if len(p) >= c)].append(p)
        self.engines = [WuManber(ps) for _, ps in sorted(classes.items())]
        self.owners = [[(owners[p], p.count(b" ") - 1) for p in e.patterns] for e in self.engines]

    def search(self, batch: list[str]) -> tuple[list[int], list[list[int]], list[set[str]]]:
        """For each text: its number of words; flat (from, to) word ranges that are hit, apart and ascending; items.

        Words are held for one block of texts at a time.
        """
        n: list[int] = []
        hit: list[list[int]] = [[] for _ in batch]
        items: list[set[str]] = [set() for _ in batch]
        for a, b in blocks(batch):
            split = [words(t) for t in batch[a:b]]
            joined = [b" " + b" ".join(w) + b" \n" if w else b"\n" for w in split]
            n += [len(w) for w in split]
            del split
            text = b"".join(joined)
            base = np.concatenate(([0], np.cumsum([len(x) for x in joined])))
            spaces = None
            spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for engine, owners in zip(self.engines, self.owners, strict=True):
                found = engine.find(text)
                if not found:
                    continue
                if spaces is None:
                    spaces = np.concatenate(([0], np.cumsum(np.frombuffer(text, dtype=np.uint8) == 32)))
                starts = np.array([s for s, _ in found])
                docs = np.searchsorted(base, starts, side="right") - 1
                word = spaces[starts] - spaces[base[docs]]
                for d, w, (_, k) in zip(docs.tolist(), word.tolist(), found, strict=True):
                    ids, length = owners[k]
                    items[a + d] |= ids
                    spans[a + d].append((w, w + length))
            for d, own in spans.items():
                hit[d] = merged(own)
        return n, hit, items


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Ranges, united, as a flat list."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _pairs(flat):
    """[(from, to), ...] of a flat list."""
    pair = F.transform(flat, lambda x, i: F.struct(x.alias("a"), F.get(flat, i + 1).alias("b"), (i % 2).alias("odd")))
    return F.transform(F.filter(pair, lambda x: x["odd"] == 0), lambda x: F.struct(x["a"], x["b"]))


def _unite(flat, x):
    last = F.try_element_at(flat, F.lit(-1))
    longer = F.concat(F.slice(flat, 1, F.size(flat) - 1), F.array(F.greatest(last, x["b"])))
    return F.when((F.size(flat) > 0) & (last >= x["a"]), longer).otherwise(F.concat(flat, F.array(x["a"], x["b"])))


#: The columns that mark() adds: words, flat word ranges of hits, sorted ids as text.
ADDED = ("_n_words", "_hits", "_items")


def mark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """docs with the columns `added`; names that docs has are refused.

    A benchmark of several chunks is searched one chunk after another: each pass is stored and lets its broadcast go
    before the next is made, so driver and executors hold one chunk at a time.
    """
    if clash := {c.lower() for c in added} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table already has columns named {sorted(clash)}")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    sc = docs.sparkSession.sparkContext
    out, names = docs, []
    for k in range(chunks):
        part = items if chunks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k)
        held = sc.broadcast([(r["item_id"], r["text"]) for r in part.collect()])  # about chunk_bytes

        key = uuid.uuid4().hex

        def make(held=held, key=key):
            searcher = resident(key, lambda: Searcher(held.value, size))

            def columns(batch: list[str]) -> list[pa.Array]:
                n, hit, found = searcher.search(batch)
                return [pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.int64())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]

            return columns

        names.append([free_name(out, f"{c.strip('_')}_{k}") for c in added])
        n_words, hits, found = names[-1]
        out = append(out, text_col, f"`{n_words}` long, `{hits}` array<long>, `{found}` array<string>", make, key)
        if chunks > 1:
            out = stored(out, "marked")
            held.unpersist()
    own = [F.col(f"`{c}`") for c in docs.columns]
    if chunks == 1:
        return out.select(*own, *[F.col(x).alias(c) for c, x in zip(added, names[0], strict=True)])
    pairs = F.array_sort(F.flatten(F.array(*[_pairs(F.col(n[1])) for n in names])))
    united = F.aggregate(pairs, F.array().cast("array<bigint>"), _unite)
    ids = F.array_sort(F.array_distinct(F.concat(*[F.col(n[2]) for n in names])))
    return out.select(*own, F.col(names[0][0]).alias(added[0]), united.alias(added[1]), ids.alias(added[2]))


def digest(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of mark()'s rows."""
    signed = F.transform("_hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return marked.select(
        F.col(id_col).alias("doc_id"),
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs without any hit; all columns of docs, whatever their names."""
    added = tuple(free_name(docs, c.strip("_")) for c in ADDED)
    return mark(docs, benchmark, text_col=text_col, added=added).where(F.size(added[1]) == 0).drop(*added)
