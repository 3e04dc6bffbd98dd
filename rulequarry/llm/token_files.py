"""Token ids in Parquet files: list columns, chosen encodings, small row groups, page indexes.

Texts are dealt by ranges of their id, sorted, encoded by the tokenizers library and written by Spark's own Parquet
writer (so any store that Spark writes to will do). Ids are dictionary-encoded, the metadata columns delta-encoded;
row groups are kept small and the writer adds page indexes, so that a reader of the metadata never touches the ids
and a reader of a few documents touches few pages. Each file holds the running number of ids before each row.

Defined results: null text is empty text (the end id alone); null ids sort first; rows that share an id are all
written, ordered by their texts; very long texts are encoded whole, one list each; an empty table gives an empty result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import codecs
import json
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulequarry.llm.common import PASSED, ranges, resident, scratch, texts, tidy
from rulequarry.llm.units import LONG_UNIT

END_ID = 0
ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 64 << 10
#: Units that are encoded as one text.
JOINED_UNITS = 4096
#: Words, and units that are not plain, that a worker remembers; together they bound its memory.
UNITS, WORDS = 200_000, 600_000
#: Bytes of whole texts that are encoded at once; a longer text stands alone.
ENCODED_BYTES = 8 << 20

_WHITE = np.array([chr(b).isspace() and b < 0x80 for b in range(256)])
#: White space of two and three bytes, as numbers.
_WIDE = np.array([int.from_bytes(chr(c).encode()) for c in range(0x80, 0x3001) if chr(c).isspace()])
#: What a byte is in a plain unit (see units.plain_words), and what may follow what.
_OTHER, _LETTER, _MARK, _LINE, _SPACE, _START = range(6)
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = _MARK
_KIND[[0x0A, 0x20]] = _LINE, _SPACE
_FOLLOWS = np.zeros((6, 5), dtype=bool)
for _before, _next in ((_START, (_LETTER, _SPACE)), (_SPACE, (_LETTER,)), (_LETTER, (_LETTER, _MARK, _LINE)), (_MARK, (_MARK, _LINE)), (_LINE, (_LETTER,))):
    _FOLLOWS[_before, _next] = True

#: The pre-tokenizer that plain units hold for.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: The character that stands for each byte in a byte-level vocabulary.
_BYTE_CHARS = "".join(chr(b if b in _SHOWN else 0x100 + sum(x not in _SHOWN for x in range(b))) for b in range(256))


class _Words(dict):
    """The ids of words of a byte-level vocabulary, asked of the library's model when first met."""

    def __init__(self, model):
        super().__init__({"": b""})
        self._model = model

    def __missing__(self, word: str) -> bytes:
        shown = codecs.charmap_decode(word.encode(), "strict", _BYTE_CHARS)[0]
        ids = array("i", [t.id for t in self._model.tokenize(shown)]).tobytes()
        if len(word) <= LONG_UNIT:
            self[word] = ids
        return ids


def _spaces_to_cut(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions of the spaces that have no white space beside them; begins: whether a text begins at a byte, or all end."""
    p = 1 + np.flatnonzero((data[1:-1] == 0x20) & ~begins[2:-1])
    p = p[~(_WHITE[data[p - 1]] | _WHITE[data[p + 1]])]
    for step in (1, -1):
        wide = np.flatnonzero(data[p + step] >= 0x80)
        if len(wide):
            last = p[wide] + (3 if step > 0 else -1)
            a, b, c = (data[np.clip(last - k, 0, len(data) - 1)].astype(np.int64) for k in (2, 1, 0))
            white = np.isin(a << 16 | b << 8 | c, _WIDE) | np.isin(a << 8 | b if step > 0 else b << 8 | c, _WIDE)
            p = np.delete(p, wide[white])
    return p


def _word_bounds(data: np.ndarray, at: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of plain units begin (as plain_words tells), and other units; then whether each is of a plain unit.

    at: where units begin, and the end; none is empty. odd: units that are not plain in any case.
    """
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    before = np.roll(kind, 1)
    before[at[:-1]] = _START
    plain = ~np.logical_or.reduceat(~_FOLLOWS[before, kind], at[:-1]) & (np.add.reduceat(kind == _LINE, at[:-1], dtype=np.int64) <= 1)
    plain &= ((last := kind[at[1:] - 1]) == _LETTER) | (last == _MARK)
    plain &= ~odd
    inside = np.repeat(plain, np.diff(at))
    begins = (kind != before) & (before != _SPACE) & inside
    begins[at[:-1]] = True
    starts = np.flatnonzero(begins)
    return starts, inside[starts]


def _distinct(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings of those that begin at `at` (its last: the end), and the number of each one."""
    strings = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
    coded = strings.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of strings without nulls, and where each begins, then the end."""
    strings = strings.cast(pa.large_string())
    _, at, data = strings.buffers()
    at = np.frombuffer(at, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data else np.zeros(0, dtype=np.uint8)
    return data, at - at[0]


class _TextEncoder:
    """Texts to ids by their distinct units (see units.UnitEncoder), and those by their distinct words: texts, units and
    words are ranges of bytes, told apart and put together by Arrow and numpy, and only new ones are asked of the library."""

    def __init__(self, words: _Words, whole: Callable[[list[str]], list[bytes]], special: list[str], plain: bool):
        self._words, self._whole, self._special, self._plain = words, whole, special, plain
        self._known: dict[str, bytes] = {}

    def _ids(self, strings: list[str], plain: list[bool]) -> list[bytes]:
        """The ids of words of plain units, and of other units."""
        if len(self._words) > WORDS:
            self._words.clear()
        if len(self._known) > UNITS:
            self._known.clear()
        words, known = self._words, self._known
        out = [words[x] if p else known.get(x) for x, p in zip(strings, plain, strict=True)]
        new = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(new, self._whole([strings[i] for i in new]), strict=True):
            out[i] = ids
            if len(strings[i]) <= LONG_UNIT:
                known[strings[i]] = ids
        return out

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct units, one after another, and the number of each one's."""
        data, at = _buffers(units)
        odd = np.full(len(units), not self._plain)
        text = data.tobytes()
        for x in self._special:
            if x.encode() in text:
                odd |= pc.match_substring(units, x).to_numpy(zero_copy_only=False)
        starts, plain = _word_bounds(data, at, odd)
        words, number = _distinct(data, np.append(starts, at[-1]))
        of_plain = np.zeros(len(words), dtype=bool)
        of_plain[number] = plain
        ids = self._ids(words.to_numpy(zero_copy_only=False).tolist(), of_plain.tolist())
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        each = count[number]
        flat = np.frombuffer(b"".join(ids), dtype="<i4")[ranges((np.cumsum(count) - count)[number], each)]
        return flat, np.add.reduceat(each, np.searchsorted(starts, at[:-1]))

    def arrays(self, texts: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The number of ids of each text, `end` after it included, and all their ids, for a part of the texts at a time."""
        data, at = _buffers(texts)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(at, at[a] + ENCODED_BYTES, side="right")) - 1)
            yield from self._some(data[at[a] : at[b]], at[a : b + 1] - at[a], end)
            a = b

    def _some(self, data: np.ndarray, at: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[at] = True
        begins[_spaces_to_cut(data, begins)] = True
        bounds = np.flatnonzero(begins)
        ids, count = np.zeros(0, dtype="<i4"), np.zeros(0, dtype=np.int64)
        number = np.zeros(0, dtype=np.int32)
        if len(data):
            units, number = _distinct(data, bounds)
            ids, count = self._units(units)
        # The end is one more unit, after the last one of each text.
        ids, count = np.append(ids, np.array([end], dtype="<i4")), np.append(count, 1)
        start = np.cumsum(count) - count
        last = np.searchsorted(bounds, at[1:])
        number = np.insert(number, last, len(count) - 1)
        stop = last + np.arange(1, len(last) + 1)
        for a in range(0, len(stop), PASSED):
            some = stop[a : a + PASSED]
            first = np.concatenate(([stop[a - 1] if a else 0], some[:-1]))
            part = number[first[0] : some[-1]]
            each = count[part]
            yield np.add.reduceat(each, first - first[0]), ids[ranges(start[part], each)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        out = []
        for n, ids in self.arrays(pa.array(texts, pa.large_string()), END_ID):
            stop = np.cumsum(n).tolist()
            out += [ids[a : b - 1].tobytes() for a, b in zip([0, *stop[:-1]], stop, strict=True)]
        return out


def _unit_encoder(vocabulary: str) -> _TextEncoder:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    size = np.array([len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())], dtype=np.int64)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    # Without a normalizer, and with this pre-tokenizer, the library asks its model for these very words.
    pre = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
    plain = tokenizer.normalizer is None and pre | _BYTE_LEVEL == pre

    def alone(batch: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<i4").tobytes() for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def whole(batch: list[str]) -> list[bytes]:
        """Units that begin with a lone space are encoded as one long text, and told apart by the bytes of their ids."""
        out: list = [None] * len(batch)
        odd = {i for i, u in enumerate(batch) if any(x in u for x in special)} if any(x in "".join(batch) for x in special) else ()
        joined = [i for i, u in enumerate(batch) if u[:1] == " " and len(u.strip()) == len(u) - 1 > 0 and i not in odd]
        for a in range(0, len(joined), JOINED_UNITS):
            some = joined[a : a + JOINED_UNITS]
            ids = np.array(tokenizer.encode_batch_fast(["".join([batch[i] for i in some])], add_special_tokens=False)[0].ids, dtype="<i4")
            ends = np.cumsum([len(batch[i].encode()) for i in some])
            at = np.searchsorted(np.cumsum(size[ids]), ends)
            if not len(ids) or at[-1] != len(ids) - 1:
                raise ValueError("the vocabulary's tokens do not add up to the text")
            data = ids.tobytes()
            for i, x, y in zip(some, [0, *(at[:-1] + 1).tolist()], (at + 1).tolist(), strict=True):
                out[i] = data[4 * x : 4 * y]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, alone([batch[i] for i in rest]), strict=True):
            out[i] = x
        return out

    return _TextEncoder(_Words(tokenizer.model), whole, special, plain)


def _encoder(vocabulary: str) -> _TextEncoder:
    """One encoder for each worker process; its key is the vocabulary."""
    return resident(vocabulary, lambda: _unit_encoder(vocabulary))


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Writes (shard, doc_id, before, n_tokens, ids) files, in ascending order of doc_id from shard to shard."""
    rows = texts(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, shard, before = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for n, flat in encoder.arrays(batch.column("text"), end_id):
                offsets = np.concatenate(([0], np.cumsum(n)))
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, dtype=np.int32)), batch.column("doc_id").slice(at, len(n)), pa.array(before + offsets[:-1]), pa.array(n), ids], names=["shard", "doc_id", "before", "n_tokens", "ids"])
                before += int(offsets[-1])
                at += len(n)

    (
        rows.repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(tidy(run, vocabulary), "shard int, doc_id long, before long, n_tokens long, ids array<int>")
        .write.option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with `start`, the number of ids of all rows before; columns that are not asked for are not read."""
    files = spark.read.schema("shard int, doc_id long, before long, n_tokens long, ids array<int>").parquet(path)
    # One row for each shard: as many as files, however many documents.
    total = files.groupBy("shard").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = total.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return files.join(F.broadcast(starts), "shard").select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the CRC-32 of the ids as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            offsets, flat = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_check(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the ids of docs to the shared folder, reads the files back and sums them up by document."""
    path = scratch(docs.sparkSession, "tokens")
    write(docs, path, vocabulary)
    return checksums(read(docs.sparkSession, path))
