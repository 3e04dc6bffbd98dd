"""Cases that the operators' docstrings define: odd ids, very long texts, empty tables, ties, clashing columns, file layout."""

import glob
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from rulequarry.llm import bpe_lexicon, kdtree_topk, quality, suffix_dedup, token_files, toxicity, warc
from tests.llm import test_decontaminate, test_suffix_dedup

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "The quick brown fox, number 12345, jumps over Straße é \n" * 12_000


def plain_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_op5_odd_ids_long_text_and_clashing_columns(spark):
    rows = [(None, "no id"), (2, "same"), (2, None), (2, "same"), (-1, LONG), (1 << 40, "")]
    docs = spark.createDataFrame([(*r, 1, [1]) for r in rows], "doc_id long, text string, shard int, ids array<int>")
    start, want = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain_ids(text) + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.write_and_check(docs, PATH).collect()), key=lambda r: r[1]) == want


def test_op5_file_layout_and_selective_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "ROW_GROUP_BYTES", 16 << 10)
    rows = [(i, f"document {i} " + "common words of running text " * 60) for i in range(2500)]
    path = str(tmp_path / "tokens")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, PATH)
    groups = 0
    for name in glob.glob(path + "/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        groups = max(groups, meta.num_row_groups)
        for column in (meta.row_group(0).column(k) for k in range(meta.num_columns)):
            if column.path_in_schema.startswith("ids"):
                assert "RLE_DICTIONARY" in column.encodings
            else:
                assert "DELTA_BINARY_PACKED" in column.encodings
            assert column.has_offset_index and column.has_column_index
    assert groups > 1
    lengths = token_files.read(spark, path).select("doc_id", "n_tokens")
    plan = lengths._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    one = token_files.read(spark, path).where("doc_id = 1234")
    assert "EqualTo(doc_id,1234)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.first().ids == plain_ids(rows[1234][1]) + [0]


def test_op9_empty_table_long_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, LONG, 5, "x"), (None, LONG[:100], 5, "x")], "doc_id long, text string, n_tokens int, ids string")
    assert bpe_lexicon.round_trip(docs.limit(0), PATH).count() == 0 and bpe_lexicon.encode(docs.limit(0), PATH).count() == 0
    got = {r.doc_id: r for r in bpe_lexicon.round_trip(docs, PATH, words=3).collect()}
    for i, text in ((1, LONG), (None, LONG[:100])):
        ids = plain_ids(text)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe_lexicon.decode(bpe_lexicon.encode(docs, PATH), PATH).collect()} == {1: LONG, None: LONG[:100]}


def test_op8_long_payload_and_clashing_columns(spark):
    rows = [(4, "u", LONG, "a", 1), (2, "v", LONG, "b", 2), (9, "w", "short", "c", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, sha int")
    got = {r.page_id: r for r in warc.write_and_read(pages).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {4: ("revisit", 2, len(LONG.encode())), 2: ("response", None, len(LONG.encode())), 9: ("response", None, 5)}


def test_op7_long_text_and_empty_tables(spark):
    d = test_decontaminate.d
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, LONG + item + " " + LONG), (2, item), (None, item.upper()), (3, ""), (4, None)]
    items = [("a", item), ("b", ""), ("c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in d.digest(d.mark(docs, bench)).collect()}
    assert got == {1: (11, 1, True), 2: (11, 1, True), None: (11, 1, True), 3: (0, 0, False), 4: (0, 0, False)}
    assert d.digest(d.mark(docs.limit(0), bench)).count() == 0
    assert {r.n_hit for r in d.digest(d.mark(docs, bench.limit(0))).collect()} == {0}


def test_op2_long_text(spark):
    rng = np.random.default_rng(5)
    text = "".join(map(chr, rng.integers(97, 123, 60_000)))
    rows = [(1, text), (2, text[20_000:20_400]), (3, text[40_000:40_399]), (4, text[:700] + "#" + text[500:1200])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, anchor string")
    assert sorted(map(tuple, suffix_dedup.digest(suffix_dedup.strip(docs)).collect()), key=str) == test_suffix_dedup.brute(rows)


def test_op4_ties_and_clashing_columns(spark):
    rows = [(i, [0.5, 0.25], 7, "x") for i in range(0, 120, 10)] + [(50, None, 7, "x"), (150, [float("nan"), 1.0], 7, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank string")
    got = sorted(map(tuple, kdtree_topk.top_k(vectors).select("query_id", "rank", "vec_id").collect()))
    ids = [i for i in range(0, 120, 10)]
    assert got == [(q, k, v) for q in (0, 50, 100) for k, v in enumerate([i for i in ids if i != q][:5], 1)]


def test_classifiers_read_long_texts_whole(spark):
    """The decisive word stands at the end of a text longer than a block."""
    rows = [(i, ("calm words here " * 20) + ("grumblefink" if i % 2 else "")) for i in range(200)]
    tail = "calm words here " * 60_000
    docs = spark.createDataFrame(rows + [(1000, tail + "grumblefink"), (1001, tail)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    for module, sign in ((toxicity, 1), (quality, -1)):
        scores = {r.doc_id: r.score for r in module.predictions(docs, module.train(docs, labels)).where("doc_id >= 1000").collect()}
        assert sign * (scores[1000] - scores[1001]) > 0


def test_dropped_tables_go_before_the_next_task(monkeypatch):
    """Tables that refer to each other must not wait for the collector: the next task's memory comes on top of them."""
    import gc
    import weakref

    from rulequarry.llm import common

    class Table:
        pass

    table = Table()
    table.own, gone, given = table, weakref.ref(table), []
    monkeypatch.setattr(common, "_RESIDENT", {})
    monkeypatch.setattr(common, "give_back", lambda: given.append(gone() is None))
    common.resident("one", lambda: table)
    del table
    gc.disable()
    try:
        assert list(common.tidy(lambda batches: iter([(gone() is None, list(given))]), "two")([])) == [(True, [True])]
    finally:
        gc.enable()
