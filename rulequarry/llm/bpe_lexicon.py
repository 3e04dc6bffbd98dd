"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Word counts over all texts choose the frequent words. They are compiled into a minimal automaton with shared suffixes
whose arcs carry additive outputs; the outputs along a word's path add up to the word's number, which leads to its
ids. The file is distributed by Spark and memory-mapped by the workers. Words outside the lexicon are merged exactly,
in the order of the vocabulary's merges, so the result never depends on what the lexicon holds.

Defined results: null text is empty text (no ids); rows with null or repeated ids are encoded like any other; an empty
table gives an empty result; very long texts are encoded whole; other columns, whatever their names, are not read. The vocabulary's special token is one id, in a text too.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm.common import blocks, ranges, resident, stored, texts, tidy
from rulequarry.llm.units import LONG_UNIT, UnitEncoder, plain_words

#: Frequent words that the lexicon holds; bounds the file and what the driver reads.
LEXICON_WORDS = 50_000
#: Bytes of a word of the lexicon at most.
WORD_BYTES = 32
#: Distinct units, and words, that a counting task holds before it passes them on.
COUNTED = 200_000
#: Words whose ids an encoder remembers before it starts afresh; bounds its memory.
WORDS_KEPT = 300_000

# Fixed value: the expression by which byte-level BPE vocabularies of this kind split text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Code points of texts whose ids are summed up at once.
SUMMED_CHARS = 1 << 20

#: Stands above every rank.
NO_MERGE = 1 << 62


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64)


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary file: itself if it prints, else the next from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Strings:
    """Byte strings by their number, to be joined many at once."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def joined(self, numbers: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The strings of each run of numbers joined; ends: where each run ends."""
        lengths = self.lengths[numbers]
        data = self.data[ranges(self.starts[numbers], lengths)].tobytes()
        at = np.concatenate(([0], np.cumsum(lengths)))[ends].tolist()
        return [data[a:b] for a, b in zip([0, *at], at, strict=False)]


class Vocabulary:
    """A byte-level BPE vocabulary: exact merging, and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        char_byte = {c: b for b, c in byte_chars().items()}
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(char_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self._byte_id = [ids[c] for _, c in sorted(byte_chars().items())]
        # A pair of ids, as one number, to (rank, id of the two joined).
        self._merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._merges.setdefault(ids[a] << 20 | ids[b], (rank, ids[a + b]))
        self._byte_ids = np.array(self._byte_id, dtype=np.int64)
        self._keys, self._pairs = self._pair_table()
        self.words = regex.compile(WORDS)
        self.splits = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: The ids' decimal numbers with a comma after each, and their bytes.
        self.decimal, self.raw = Strings([b"%d," % i for i in range(size)]), Strings(self.bytes_of)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self._byte_id[b] for b in word]
        return self._merge_long(ids) if len(ids) > 64 else self._merge_short(ids)

    def _pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """An open hash table of pairs: keys (a << 20 | b), and values (rank << 20 | joined id)."""
        size = 1 << (max(4, len(self._merges)) * 4 - 1).bit_length()
        keys, values = np.full(size, -1, dtype=np.int64), np.full(size, NO_MERGE, dtype=np.int64)
        left = np.fromiter(self._merges, dtype=np.int64, count=len(self._merges))
        value = np.array([r << 20 | i for r, i in self._merges.values()], dtype=np.int64)
        at = _slot(left, size)
        while len(left):
            # Each free slot takes one key; the others try the next slot.
            free = keys[at] < 0
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            one = one[free[one]]
            keys[at[one]], values[at[one]] = left[one], value[one]
            rest = np.ones(len(left), dtype=bool)
            rest[one] = False
            left, value, at = left[rest], value[rest], (at[rest] + 1) & (size - 1)
        return keys, values

    def _values(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | joined id of each pair, NO_MERGE where there is none or an id is negative."""
        key = a.astype(np.int64) << 20 | b
        key[(a < 0) | (b < 0)] = -2
        out = np.full(len(key), NO_MERGE, dtype=np.int64)
        live, at = np.flatnonzero(key >= 0), None
        at = _slot(key[live], len(self._keys))
        while len(live):
            there = self._keys[at]
            same = there == key[live]
            out[live[same]] = self._pairs[at[same]]
            on = ~same & (there >= 0)
            live, at = live[on], (at[on] + 1) & (len(self._keys) - 1)
        return out

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of many words as little-endian 32-bit integers; words of like length are merged side by side."""
        out: list[bytes] = [b""] * len(words)
        for least, most in ((1, 8), (9, 16), (17, 40)):
            some = [i for i, w in enumerate(words) if least <= len(w) <= most]
            for a in range(0, len(some), 1 << 14):
                part = some[a : a + (1 << 14)]
                for i, ids in zip(part, self._merge_grid([words[i] for i in part], most), strict=True):
                    out[i] = ids
        for i, w in enumerate(words):
            if len(w) > 40:
                out[i] = np.array(self.merge(w), dtype="<i4").tobytes()
        return out

    def _merge_grid(self, words: list[bytes], width: int) -> list[bytes]:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        grid = self._byte_ids[np.frombuffer(b"".join([w.ljust(width + 1, b"\0") for w in words]), dtype=np.uint8)].reshape(-1, width + 1)
        grid[np.arange(width + 1) >= sizes[:, None]] = -1
        value = self._values(grid[:, :-1].reshape(-1), grid[:, 1:].reshape(-1)).reshape(-1, width)
        column = np.arange(width + 1)
        live = np.arange(len(words))
        while len(live):
            at = value[live].argmin(axis=1)
            best = value[live, at]
            live, at, best = live[go := best != NO_MERGE], at[go], best[go]
            if not len(live):
                break
            # The pair's place takes the joined id; what stands behind moves one to the left.
            move = column[None, :] + (column[None, :] > at[:, None])
            np.minimum(move, width, out=move)
            rows = np.take_along_axis(grid[live], move, axis=1)
            rows[np.arange(len(live)), at] = best & 0xFFFFF
            rows[:, -1] = -1
            grid[live] = rows
            ranks = np.take_along_axis(value[live], np.minimum(move[:, :-1], width - 1), axis=1)
            ranks[:, -1] = NO_MERGE
            each = np.arange(len(live))
            ranks[each, at] = self._values(rows[each, at], rows[each, at + 1])
            before = np.maximum(at - 1, 0)
            left = self._values(rows[each, before], rows[each, at])
            has = at > 0
            ranks[each[has], before[has]] = left[has]
            value[live] = ranks
            sizes[live] -= 1
        flat = grid.astype("<i4")
        data, step = flat.tobytes(), 4 * (width + 1)
        return [data[k * step : k * step + 4 * n] for k, n in enumerate(sizes.tolist())]

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self._merges.get
        while len(ids) > 1:
            best = None
            for a, b in zip(ids, ids[1:]):
                m = get(a << 20 | b)
                if m is not None and (best is None or m < best):
                    best, left, right = m, a, b
            if best is None:
                break
            out, i, n = [], 0, len(ids)
            while i < n:
                if ids[i] == left and i + 1 < n and ids[i + 1] == right:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n = self._merges.get, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        heap.sort(key=lambda x: (x[0], x[2]))
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if m := get(new << 20 | ids[after[i]]):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[after[i]]))
            if (p := before[i]) >= 0 and (m := get(ids[p] << 20 | new)):
                heapq.heappush(heap, (m[0], p, m[1], ids[p], new))
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> list[str]:
        """The words of a text; a special token is a word of its own."""
        if self.splits is None or not self.splits.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.splits.finditer(text):
            out += [*self.words.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.words.findall(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Lexicon:
    """The automaton: sorted arcs (state << 8 | byte) with targets and outputs; final states; ids by word number."""

    FIELDS = ("arc", "target", "output", "final", "offset", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Lexicon:
        """Compiles words with their ids, state by state in the order of the sorted words (incremental minimisation)."""
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}

        def freeze(path: list[tuple[int, int, int]], keep: int) -> None:
            while len(path) > keep:
                parent, byte, child = path.pop()
                key = (final[child], tuple(arcs[child].items()))
                if (same := register.setdefault(key, child)) != child:
                    arcs[parent][byte] = same

        path: list[tuple[int, int, int]] = []
        before = b""
        ordered = sorted(words)
        for w in ordered:
            n = len(os.path.commonprefix([w, before]))
            freeze(path, n)
            state = path[-1][2] if path else 0
            for byte in w[n:]:
                arcs.append({})
                final.append(False)
                arcs[state][byte] = len(arcs) - 1
                path.append((state, byte, len(arcs) - 1))
                state = len(arcs) - 1
            final[state] = True
            before = w
        freeze(path, 0)
        # States that are still reachable, numbered afresh; words below each, for the outputs.
        order, number, stack = [], {0: 0}, [0]
        while stack:
            s = stack.pop()
            order.append(s)
            for t in arcs[s].values():
                if t not in number:
                    number[t] = len(number)
                    stack.append(t)
        below: dict[int, int] = {}

        def count(root: int) -> None:
            todo = [(root, False)]
            while todo:
                s, ready = todo.pop()
                if s in below:
                    continue
                if ready:
                    below[s] = final[s] + sum(below[t] for t in arcs[s].values())
                else:
                    todo.append((s, True))
                    todo += [(t, False) for t in arcs[s].values() if t not in below]

        count(0)
        rows = []
        for s in order:
            passed = int(final[s])
            for byte in sorted(arcs[s]):
                t = arcs[s][byte]
                rows.append((number[s] << 8 | byte, number[t], passed))
                passed += below[t]
        rows.sort()
        flat = np.array(rows, dtype=np.int64).reshape(-1, 3)
        ends = np.zeros(len(number), dtype=np.int8)
        for s in order:
            ends[number[s]] = final[s]
        lengths = [len(words[w]) for w in ordered]
        return cls(
            {
                "arc": flat[:, 0].copy(),
                "target": flat[:, 1].astype(np.int32),
                "output": flat[:, 2].astype(np.int32),
                "final": ends,
                "offset": np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype(np.int64),
                "ids": np.array([i for w in ordered for i in words[w]], dtype=np.int32),
            }
        )

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            parts = [getattr(self, k) for k in self.FIELDS]
            f.write(json.dumps([[k, a.dtype.str, len(a)] for k, a in zip(self.FIELDS, parts, strict=True)]).encode().ljust(1024))
            for a in parts:
                f.write(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0"))

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Memory-maps the file."""
        with open(path, "rb") as f:
            head = json.loads(f.read(1024))
        arrays, at = {}, 1024
        for k, kind, n in head:
            kind = np.dtype(kind)
            arrays[k] = np.memmap(path, dtype=kind, mode="r", offset=at, shape=(n,)) if n else np.zeros(0, kind)
            at += -(-n * kind.itemsize // 8) * 8
        return cls(arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1: all words walk the automaton together, a byte a step."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.arc) or not words:
            return out
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sizes[sizes > WORD_BYTES] = 0
        live = np.flatnonzero(sizes)
        grid = np.frombuffer(b"".join(w.ljust(WORD_BYTES, b"\0") if 0 < len(w) <= WORD_BYTES else bytes(WORD_BYTES) for w in words), dtype=np.uint8).reshape(-1, WORD_BYTES)
        state, total = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for step in range(WORD_BYTES):
            key = state[live] << 8 | grid[live, step]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            ok = self.arc[at] == key
            live, at = live[ok], at[ok]
            state[live] = self.target[at]
            total[live] += self.output[at]
            done = sizes[live] == step + 1
            ended = live[done]
            hit = ended[self.final[state[ended]] == 1]
            out[hit] = total[hit]
            live = live[~done]
            if not len(live):
                break
        return out


def count_words(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(word binary, n): how often each word occurs in all texts; docs as texts() gives them."""

    def counted(batches):
        find = regex.compile(WORDS).findall
        starts: Counter[str] = Counter()
        others: Counter[str] = Counter()
        words: dict[str, int] = {}

        def told_apart():
            seen = words.get
            for before, counts in (("", starts), (" ", others)):
                for unit, n in counts.items():
                    unit = before + unit
                    for w in m.groups("") if (m := plain_words(unit)) else find(unit):
                        words[w] = seen(w, 0) + n
                counts.clear()
            words.pop("", None)

        def given():
            out = pa.RecordBatch.from_arrays([pa.array([w.encode() for w in words], pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])
            words.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                first, *rest = text.split(" ")
                starts[first] += 1
                others.update(rest)
                if len(starts) + len(others) > COUNTED:
                    told_apart()
                    if len(words) > COUNTED:
                        yield given()
        told_apart()
        if words:
            yield given()

    return docs.select("text").mapInArrow(tidy(counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, words: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words and gives the file to all executors; returns its name for SparkFiles."""
    counts = stored(count_words(docs, vocabulary).where(F.length("word") <= WORD_BYTES), "words")
    # How many words are how frequent, by eighths of a power of two: a few hundred rows. The cut is the lowest one above
    # which no more than `words` words lie, so no more than those come to the driver.
    grade = F.floor(8 * F.log2("n"))
    cut, above = None, 0
    for r in sorted(counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("n")).collect(), reverse=True):
        above += r["n"]
        if above > words:
            break
        cut = r["grade"]
    top = counts.where(grade >= cut).select("word").collect() if cut is not None else []
    vocab = Vocabulary(vocabulary)
    lexicon = Lexicon.build({bytes(r["word"]): vocab.merge(bytes(r["word"])) for r in top})
    path = os.path.join(tempfile.mkdtemp(), f"lexicon-{uuid.uuid4().hex}.bin")
    lexicon.save(path)
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


class Encoder:
    """Encodes with a lexicon and exact merging; decodes."""

    def __init__(self, vocabulary: str, lexicon: Lexicon):
        self.vocab, self.lexicon = Vocabulary(vocabulary), lexicon
        self._ids_of: dict[str, bytes] = {}
        self._units = UnitEncoder(self._encode_units)

    def _encode_units(self, units: list[str]) -> list[bytes]:
        special, known = self.vocab.special, self._ids_of
        plain = plain_words if not any(map("".join(units).__contains__, special)) else lambda u: None
        # All pieces in one list: a tuple or list for each unit would keep the garbage collector busy.
        pieces, ends = [], []
        for u in units:
            pieces += m.groups("") if (m := plain(u)) else self.vocab.pieces(u)
            ends.append(len(pieces))
        if len(known) > WORDS_KEPT:
            known.clear()
        known[""] = b""
        distinct = list(set(pieces).difference(known))
        words = [p.encode() for p in distinct]
        offset, ids, unseen = self.lexicon.offset, self.lexicon.ids, []
        for i, (piece, k) in enumerate(zip(distinct, self.lexicon.find(words).tolist(), strict=True)):
            if piece in special:
                known[piece] = special[piece].to_bytes(4, "little")
            elif k >= 0:
                known[piece] = ids[offset[k] : offset[k + 1]].tobytes()
            else:
                unseen.append(i)
        known.update(zip([distinct[i] for i in unseen], self.vocab.merge_many([words[i] for i in unseen]), strict=True))
        found = list(map(known.__getitem__, pieces))
        out = [b"".join(found[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        for p in distinct:
            if len(p) > LONG_UNIT:
                del known[p]
        return out

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, dtype="<i4") for b in self._units.encode(batch)]

    def decode(self, ids: np.ndarray) -> str:
        return self.vocab.decode(ids.tolist())


def _encoder(vocabulary: str, name: str) -> Encoder:
    """One encoder for each worker process, whatever number of tasks it runs; its key is (vocabulary, name)."""
    return resident((vocabulary, name), lambda: Encoder(vocabulary, Lexicon.load(SparkFiles.get(name))))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids) of every text."""
    rows = texts(docs, id_col, text_col)
    name = build_lexicon(rows, vocabulary, words)

    def run(batches):
        encoder = _encoder(vocabulary, name)
        for batch in batches:
            ids = encoder.encode(batch.column("text").to_pylist())
            n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            offsets = np.concatenate(([0], np.cumsum(n)))
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)], names=["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(tidy(run, (vocabulary, name)), "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of a table with doc_id and ids."""

    def run(batches):
        vocab = Vocabulary(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [vocab.decode(list(x)) for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(tidy(run), "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text and decodes its ids, keeping digests only."""
    rows = texts(docs, id_col, text_col)
    name = build_lexicon(rows, vocabulary, words)

    def run(batches):
        encoder = _encoder(vocabulary, name)
        vocab = encoder.vocab
        for pdf in batches:
            given, n, listed, decoded = pdf["text"].tolist(), [], [], []
            for a, b in blocks(given, SUMMED_CHARS):
                ids = encoder.encode(given[a:b])
                n += map(len, ids)
                flat, ends = np.concatenate(ids), np.cumsum([len(x) for x in ids])
                listed += [hashlib.sha256(x[:-1]).hexdigest() for x in vocab.decimal.joined(flat, ends)]
                decoded += [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in vocab.raw.joined(flat, ends)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n, "ids_sha256": listed, "decoded_sha256": decoded})

    return rows.mapInPandas(tidy(run, (vocabulary, name)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
