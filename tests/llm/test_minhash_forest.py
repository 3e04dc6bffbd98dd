import random
import re

import pytest

from rulequarry.llm import minhash_forest as m

RX = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = RX.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def corpus(n=260, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 6)))
    rows, i = [], 0
    base = [word() for _ in range(120)]
    while i < n:
        w = list(base) if rng.random() < 0.6 else [word() for _ in range(rng.choice([1, 3, 5, 6, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            x = list(w)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                x[rng.randrange(len(x))] = word()
            rows.append((i, rng.choice([" ", "  ", "\n"]).join(x).replace("a", rng.choice("aA"))))
            i += 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "é b c d e f")]


@pytest.mark.parametrize("small", [False, True])
def test_op1_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(m, "REGION", 5)
    rows = corpus()
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_rows_without_or_with_the_same_id(spark):
    t = "one two three four five six seven"
    rows = [(None, t), (4, t), (4, t), (2, t.upper()), (None, None)]
    got = sorted(map(tuple, m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 3, None, True), (4, 3, 2, False), (4, 3, 2, False), (2, 3, 2, True), (None, 0, None, True)], key=str)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, label long, a long")
    assert sorted(map(str, m.deduplicated(docs).select("doc_id").collect())) == ["Row(doc_id=2)", "Row(doc_id=None)", "Row(doc_id=None)"]
    assert m.near_duplicates(docs.limit(0)).count() == 0


def pairs(n, shared=84, own=10, seed=3):
    """n pairs of texts of random words; with the defaults, 80 of a pair's 100 shingles are shared."""
    rng = random.Random(seed)
    words = lambda k: [f"w{rng.getrandbits(40):x}" for _ in range(k)]
    rows = []
    for k in range(n):
        head = words(shared)
        rows += [(2 * k, " ".join(head + words(own))), (2 * k + 1, " ".join(head + words(own)))]
    return rows


def test_stage_drops_copies_from_080_on(spark):
    docs = spark.createDataFrame(pairs(40) + [(i + 80, t) for i, t in pairs(5, own=11, seed=4)], "doc_id long, text string")
    kept = lambda **given: sorted(r.doc_id for r in m.deduplicated(docs, **given).collect())
    assert kept() == [*range(0, 80, 2), *range(80, 90)]
    assert kept(percent=85) == list(range(90))


def near(n, shared, own, seed=7):
    """n texts around one template: a pair shares about `shared` of its words, all in one dense region."""
    rng = random.Random(seed)
    base = [f"w{rng.getrandbits(40):x}" for _ in range(shared + own)]
    rows = []
    for i in range(n):
        w = list(base)
        at = rng.randrange(len(w) - own)
        w[at : at + own] = [f"x{rng.getrandbits(40):x}" for _ in range(own)]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("depth", [m.BASE, m.BASE + 1, m.DEEP])
def test_recall_of_near_pairs_at_each_depth(depth):
    """500 pairs at 0.80 and 500 at 0.85, read at one depth only: more than 0.999 of them met, as brute force has them."""
    rows = [*pairs(500), *[(i + 1000, t) for i, t in pairs(500, shared=92, own=8, seed=9)]]
    sets = {i: shingles(t) for i, t in rows}
    want = {i for i in range(0, 2000, 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])}
    h, at = m.shingle_sets([t for _, t in rows])
    sig = m.signatures(h, at)[:, : m.ORDERS * m.DEEP].reshape(len(rows), m.ORDERS, m.DEEP)
    met = (sig[0::2, :, :depth] == sig[1::2, :, :depth]).all(axis=2).any(axis=1)
    bits = m._agree(*(m.np.packbits((m.signatures(h, at) & 1).astype(bool), axis=1)[k::2] for k in (0, 1))) >= m.agreeing(80)
    found = {2 * int(k) for k in (met & bits).nonzero()[0]}
    assert len(want) == 1000 and len(found & want) >= 0.999 * len(want)


@pytest.mark.parametrize("region", [4, 512])
def test_dense_regions_miss_no_link(spark, monkeypatch, region):
    """One template's texts, pairs at 0.70 to 0.95: regions are cut deeper and into blocks, links stay."""
    monkeypatch.setattr(m, "REGION", region)
    rows = near(60, 90, 6) + [(i + 60, t) for i, t in near(60, 90, 9, seed=8)]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_one_id_with_two_texts(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(5, a, 1), (5, b, 2), (2, b, 3), (5, a, 4)], "doc_id long, text string, _key long")
    got = sorted(map(tuple, m.near_duplicates(docs).collect()))
    assert got == [(2, 2, 2, True), (5, 2, 2, False), (5, 3, 5, True), (5, 3, 5, True)]
    assert sorted((r.doc_id, r.text) for r in m.deduplicated(docs).collect()) == [(2, b), (5, a)]
    assert m.deduplicated(docs).columns == docs.columns


def test_very_long_text_and_one_word_repeated(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.getrandbits(30)}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, "x " * 300_000), (4, "x" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(docs).collect()}
    assert got == {1: (199_996, 1), 2: (199_997, 1), 3: (1, 3), 4: (1, 4)}
