import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from rulequarry.llm import suffix_dedup as s


def brute(rows):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for d in data:
        for i in range(len(d) - 399):
            seen[d[i : i + 400]] = seen.get(d[i : i + 400], 0) + 1
    out = []
    for (i, _), d in zip(rows, data):
        gone = np.zeros(len(d), dtype=bool)
        for k in range(len(d) - 399):
            if seen[d[k : k + 400]] > 1:
                gone[k : k + 400] = True
        rest = bytes(np.frombuffer(d, dtype=np.uint8)[~gone])
        out.append((i, len(d), int(gone.sum()), len(s._flat(gone)) // 2, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeé ", k=6))
    text = lambda n: "".join(word() for _ in range(n))
    shared = [text(80), text(70), text(200), "ab" * 300, text(66) + "x"]
    base = text(300)
    rows = []
    for i in range(70):
        kind = rng.random()
        if kind < 0.4:
            t = list(base)
            for _ in range(rng.choice([0, 1, 3])):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            t = "".join(t)
        else:
            t = text(rng.choice([0, 5, 66, 150])) + rng.choice(shared)[: rng.choice([390, 399, 400, 401, 5000])] + text(rng.choice([0, 30]))
        rows.append((i, t))
    once = text(400)
    return [*rows, (100, None), (101, ""), (102, "z" * 3000), (103, "é" * 199), (104, once), (105, once[:700]), (None, once[300:]), (5, rows[5][1]), (6, "only here " + text(90)), (107, base[10:450] * 3)]


@pytest.mark.parametrize("share", [s.SHARE, 4])
def test_op2_equals_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(s, "SHARE", share)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, spans int, mark string").repartition(3)
    assert sorted(map(tuple, s.digest(s.strip(docs)).collect()), key=str) == brute(rows)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(4)
    for size, letters in ((1, 2), (7, 1), (900, 2), (5000, 3)):
        buf = rng.integers(97, 97 + letters, size).astype(np.uint8)
        data = buf.tobytes()
        order = s.suffix_array(buf)
        assert order.tolist() == sorted(range(size), key=lambda i: data[i:])
        prefix = s.common_prefixes(buf, order, 30)
        for k in range(1, size):
            a, b = data[order[k - 1] :][:30], data[order[k] :][:30]
            assert prefix[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_long_and_repetitive_buffers():
    rng = np.random.default_rng(5)
    base = rng.integers(97, 101, 900).astype(np.uint8).tobytes()
    near = [base[: (cut := int(rng.integers(900)))] + bytes([int(rng.integers(97, 101))]) + base[cut + 1 :] for _ in range(160)]
    for data in (b"\xff".join(near[:60]), b"\xff".join(near), b"a" * 3000, b"\0" * 50 + b"ab\0" * 900):
        buf = np.frombuffer(data, dtype=np.uint8)
        order = s.suffix_array(buf)
        assert np.array_equal(np.sort(order), np.arange(len(buf)))
        prefix = s.common_prefixes(buf, order)
        for k in range(1, len(buf)):
            i, j, n = int(order[k - 1]), int(order[k]), int(prefix[k])
            assert data[i : i + n] == data[j : j + n] and data[i:] < data[j:]
            assert n == 400 or data[i + n : i + n + 1] != data[j + n : j + n + 1]


def test_anchors_meet_in_narrow_shards(monkeypatch):
    rng = random.Random(6)
    rows, wanted = [], {}
    for anchor in range(90):
        base = bytes(rng.choices(b"abcd", k=700))
        for _ in range(120 if anchor == 40 else rng.choice([2, 3, 9])):
            cut = rng.randrange(700)
            rows.append((anchor, 0, 1, b"", 301, 1, base[:cut] + b"x" + base[cut + 1 :]))
        own = {r[6] for r in rows if r[0] == anchor}
        counts = {}
        for c in own:
            for i in range(301):
                counts[c[i : i + 400]] = counts.get(c[i : i + 400], 0) + 1
        for c in own:
            wanted[c] = [i for i in range(301) if counts[c[i : i + 400]] > 1]
    rows = [(*r[:3], hashlib.sha256(r[6]).digest(), *r[4:]) for r in {r[6]: r for r in rows}.values()]
    names = ("anchor", "salt", "shares", "digest", "windows", "copies", "context")
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 37], strict=True)], names=names) for a in range(0, len(rows), 37)]
    sizes, build = [], s.suffix_array
    monkeypatch.setattr(s, "suffix_array", lambda buf: sizes.append(len(buf)) or build(buf))
    found = {d[0]: f for b in s._shards(iter(batches)) for d, f in zip(b.column("digests").to_pylist(), b.column("flat").to_pylist(), strict=True)}
    for r in rows:
        flat = found.get(r[3], [])
        assert [i for a, b in zip(flat[::2], flat[1::2], strict=True) for i in range(a, b)] == wanted[r[6]]
    assert sum(sizes) == sum(len(r[6]) + 1 for r in rows) and len(sizes) < 20
    # Only the one anchor that needs more has a suffix array of 64 KB or more, and has it alone.
    assert [n for n in sizes if n >= 1 << 16] == [sum(len(r[6]) + 1 for r in rows if r[0] == 40)]


def test_empty(spark):
    assert s.digest(s.strip(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
