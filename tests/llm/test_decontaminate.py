import hashlib
import random
import re

from rulequarry.llm import decontaminate as d

RX = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, items):
    low = lambda t: RX.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, t in docs:
        w, hit, ids = low(t), set(), set()
        for k, x in items:
            p = low(x)
            for s in range(max(1, len(p) - 9) if p and k is not None else 0):
                win = p[s : s + 10]
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        ids.add(str(k))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    vocab = ["the", "of", "a", "Éa", "x1", "tion", "and", "zürich", "b", "on"]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([1, 2, 3, 9, 10, 11, 14, 30, 12])] + [(50, None), (51, "..."), (None, "the of"), (7, "second text of an item with the same id as another one here")]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 200])))) for i in range(30)]
    docs += [(100 + i, "Intro. " + x.upper().replace(" ", ",  ") + "! end") for i, (_, x) in enumerate(items) if x]
    return [*docs, (None, "no id"), (3, None), (3, ""), (4, "x" * 3000), (5, "\x00 \x1f -- ")], items


def test_op7_equals_brute_force(spark):
    docs, items = cases()
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chunk in (d.CHUNK_BYTES, 150):
        got = sorted(map(tuple, d.digest(d.mark(table, bench, chunk_bytes=chunk)).collect()), key=str)
        assert got == brute(docs, items)


def test_long_patterns_only(spark):
    docs, items = cases()
    items = [x for x in items if x[0] in (4, 5, 6, 7, 8)]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, d.digest(d.mark(table, bench)).collect()), key=str) == brute(docs, items)
    assert d.clean(table, bench.limit(0)).count() == len(docs)


def test_clashing_names_chunks_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", 1, 2, 3), (2, "", 4, 5, 6), (3, "x " * 300_000, 7, 8, 9)], "doc_id long, text string, _hits long, _Items long, _hits_0 long")
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "zz")], "item_id long, text string")
    assert sorted(r.doc_id for r in d.clean(docs, items).collect()) == [2, 3] and d.clean(docs, items).columns == docs.columns
    plain = docs.select("doc_id", "text")
    one, more = (sorted(map(tuple, d.digest(d.mark(plain, items, chunk_bytes=n)).collect())) for n in (d.CHUNK_BYTES, 8))
    assert one == more and one[0][:4] == (1, 11, 10, 1)
    assert d.mark(plain.limit(0), items).count() == 0
