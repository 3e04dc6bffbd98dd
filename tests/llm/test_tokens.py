import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rulequarry.llm import bpe_lexicon, token_files
from rulequarry.llm.units import UnitEncoder, plain_words

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "a\n \nb", "\n\na b\n", "don't we'll I'M it's", "x<|endoftext|>y",
    "a <|endoftext|> b", "<|endoftext|>", "  <|endoftext|>  z", "éèê ñandú  Straße x  y", "日本語 テキスト\t\tx", "a\u0085 b", "1234 5678abc", "e" * 700, "ab" * 300 + " " + "xyz?!" * 50,
    "word " * 300, "foo\n", "foo\n bar", "🙂🙂 ok 🙂", "\x1c a \x1f b", "tab\tsep\t \tq",
]


def test_op9_equals_the_library(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Tokenizer.from_file(PATH)
    got = sorted(map(tuple, bpe_lexicon.round_trip(docs, PATH, words=5).collect()), key=str)
    expected = []
    for i, t in rows:
        e = want.encode(t or "", add_special_tokens=False)
        expected.append((i, len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(want.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(expected, key=str)


def test_lexicon_finds_exactly_its_words(tmp_path):
    words = {w: [i, i + 1] for i, w in enumerate([b"a", b"abc", b"abd", b"xbc", b"xbd", "é".encode(), b" the"])}
    bpe_lexicon.Lexicon.build(words).save(str(tmp_path / "l"))
    lexicon = bpe_lexicon.Lexicon.load(str(tmp_path / "l"))
    asked = [*words, b"ab", b"", b"abcd", b"zz", b"x" * 100]
    for w, k in zip(asked, lexicon.find(asked).tolist(), strict=True):
        assert (lexicon.ids[lexicon.offset[k] : lexicon.offset[k + 1]].tolist() if k >= 0 else None) == words.get(w)


def test_long_words_merge_alike():
    vocab = bpe_lexicon.Vocabulary(PATH)
    rng = np.random.default_rng(0)
    for n in (65, 200, 999):
        word = bytes(rng.choice(list(b"abcdethin"), n))
        assert vocab._merge_long([vocab._byte_id[b] for b in word]) == vocab._merge_short([vocab._byte_id[b] for b in word])


def test_unit_encoder_forgets(spark):
    t = Tokenizer.from_file(PATH)
    enc = UnitEncoder(lambda us: [np.array(e.ids, dtype="<i4").tobytes() for e in t.encode_batch_fast(us, add_special_tokens=False)], remembered=3)
    batch = [x or "" for x in TEXTS] * 2
    assert enc.encode(batch) == [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<i4").tobytes() for x in batch]


@pytest.mark.parametrize("rows", [[], [(i * 7 % 31, t) for i, t in enumerate(TEXTS)]])
def test_op5_round_trip(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    t = Tokenizer.from_file(PATH)
    start, expected = 0, []
    for i, x in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.write_and_check(docs, PATH).collect())) == expected


def test_words_merged_side_by_side():
    vocab = bpe_lexicon.Vocabulary(PATH)
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b" abcdethinou'\xc3\xa9"), rng.integers(0, 60))) for _ in range(3000)]
    assert vocab.merge_many(words) == [np.array(vocab.merge(w), dtype="<i4").tobytes() for w in words]


def test_reading_back_does_not_shuffle_the_ids(spark, tmp_path):
    """The shards' starts are a row for each file; without a size to go by they would be met by a shuffle of all ids."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        token_files.write(spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string"), f"{tmp_path}/t", PATH)
        rows = token_files.read(spark, f"{tmp_path}/t")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert rows.count() == 20
    finally:
        spark.conf.set(name, before)


def test_op5_asks_the_library_once_for_a_word_of_many_units(monkeypatch):
    """Words are shared by units that differ in their marks and lines; units that are not plain go to the whole tokenizer."""
    asked = []
    missing = token_files._Words.__missing__
    monkeypatch.setattr(token_files._Words, "__missing__", lambda self, word: asked.append(word) or missing(self, word))
    texts = ["x one one, one. one!? one.\none, it's 5 one\n\none one.\tone", "y one.\nStraße Straße, (one) one"]
    got = token_files._unit_encoder(PATH).encode(texts)
    t = Tokenizer.from_file(PATH)
    assert got == [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<i4").tobytes() for x in texts]
    assert sorted(asked) == sorted(["x", "y", " one", "one", ",", ".", "!?", "\n", " Straße", "Straße"])


@pytest.mark.parametrize("limit", [4, 100_000])
def test_op5_units_equal_the_library(monkeypatch, tmp_path, limit):
    """Letters, marks, line ends and spaces in any order, with an added token of letters and one of marks too."""
    monkeypatch.setattr(token_files, "UNITS", limit)
    monkeypatch.setattr(token_files, "WORDS", limit)
    rng = np.random.default_rng(3)
    parts = [" ", " ", " ", "\n", "\n", "the", "The", "é", "Ünd", "ñ", "ÿ", "×", "÷", "ª", "á", "ł", "日", ".", ",", "$$$", "'", "'s", "'ll", "-", "~", "`", "7", "\t", " ", "<|endoftext|>", "<|", "foo", "\x7f", "\xad"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(3000)]
    own = Tokenizer.from_file(PATH)
    own.add_tokens(["foo", "$$"])
    own.save(str(tmp_path / "own.json"))
    for path in (PATH, str(tmp_path / "own.json")):
        t = Tokenizer.from_file(path)
        want = [np.array(e.ids, dtype="<i4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
        assert token_files._unit_encoder(path).encode(texts) == want


def test_op9_looks_a_word_of_many_units_up_once(monkeypatch):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    encoder = bpe_lexicon.Encoder(vocabulary, bpe_lexicon.Lexicon.build({}))
    asked, find = [], bpe_lexicon.Lexicon.find
    monkeypatch.setattr(bpe_lexicon.Lexicon, "find", lambda self, words: asked.extend(words) or find(self, words))
    texts = ["a zebra, a zebra. a  zebra\nzebra!", "a zebra;\u00a0 zebra \n a zebra", " zebra's <|endoftext|> zebra", "zebra " + "x" * 80 + " zebra", ""]
    library = Tokenizer.from_file(vocabulary)
    for text in texts:
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked.count(b" zebra") == 1


def test_strings_are_joined_by_run():
    strings = bpe_lexicon.Strings([b"a,", b"", b"bcd,"])
    assert strings.joined(np.array([2, 0, 1, 1, 2]), np.array([0, 2, 4, 4, 5])) == [b"", b"bcd,a,", b"", b"", b"bcd,"]
    assert strings.joined(np.zeros(0, dtype=np.int32), np.array([0, 0])) == [b"", b""]


def test_op5_looks_a_word_up_once_for_all_units_of_a_block(monkeypatch):
    class Counted(token_files._Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    asked = []
    monkeypatch.setattr(token_files, "_Words", Counted)
    texts = ["x one one, one. one!\none", "x one, one;\none one"] * 50
    t = Tokenizer.from_file(PATH)
    assert token_files._unit_encoder(PATH).encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<i4").tobytes() for x in texts]
    assert sorted(asked) == sorted(["x", " one", ",", ".", "!", "\n", "one", ";"])


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_op5_small_blocks_and_parts_of_columns(monkeypatch, kind):
    """White space of every length beside spaces, texts that a block or a part of the rows ends in, empty ones, columns cut out of others."""
    monkeypatch.setattr(token_files, "ENCODED_BYTES", 90)
    monkeypatch.setattr(token_files, "PASSED", 3)
    rng = np.random.default_rng(5)
    parts = [" "] * 12 + ["the", "à", "é.", "ÿ", "Å", "…", "”", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u200a", "\u200b", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\u3001", "🙂", "7", "'s", "<|endoftext|>"]
    texts = ["", " ", *("".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(2000)), " ", ""]
    t = Tokenizer.from_file(PATH)
    want = [[*e.ids, 9] for e in t.encode_batch(texts, add_special_tokens=False)]
    encoder, column = token_files._unit_encoder(PATH), pa.array(texts, kind)
    for a, b in ((0, len(texts)), (2, 2), (0, 1), (len(texts) - 1, len(texts)), (3, 500)):
        got = [(n.tolist(), ids.tolist()) for n, ids in encoder.arrays(column.slice(a, b - a), 9)]
        assert sum((n for n, _ in got), []) == [len(x) for x in want[a:b]]
        assert sum((ids for _, ids in got), []) == sum(want[a:b], [])


def test_op5_word_bounds_are_those_of_plain_words():
    rng = np.random.default_rng(6)
    parts = ["a", "Z", "é", "À", "ÿ", "×", "÷", "²", "ł", ",", "`", "~", "'", "\n", "\x7f", "0", "\u3000"]
    units = ["".join(rng.choice(["", " "], 1)) + "".join(rng.choice(parts[: rng.integers(1, len(parts) + 1)], rng.integers(1, 7))) for _ in range(5000)]
    units += ["".join(x) for x in rng.choice(["a", "é", ",", "\n", " "], (5000, 5))]
    at = np.cumsum([0, *(len(u.encode()) for u in units)])
    starts, plain = token_files._word_bounds(np.frombuffer("".join(units).encode(), dtype=np.uint8), at, np.zeros(len(units), dtype=bool))
    want = []
    for u, a in zip(units, at.tolist(), strict=False):
        for w in [x for x in m.groups("") if x] if (m := plain_words(u)) else [u]:
            want.append((a, m is not None))
            a += len(w.encode())
    assert list(zip(starts.tolist(), plain.tolist(), strict=True)) == want
    assert 500 < sum(plain_words(u) is not None for u in units) < 9500
