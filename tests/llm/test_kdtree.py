import math

import numpy as np
import pytest

from rulequarry.llm import kdtree_topk as t


def brute(rows, k, every):
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            best[i] = min(best.get(i, v), v)
    whole = {i: [math.floor(256 * x) for x in v] for i, v in best.items()}
    out = []
    for q in whole:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [40, 4096])
def test_op4_equals_brute_force(spark, shard):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 5).round(1)]) for i in rng.permutation(230)]
    rows += [(300, None), (350, []), (310, [0.1, None, 0.0, 0.0, 0.0]), (400, [0.0, float("nan"), 0.0, 0.0, 0.0]), (401, [float("inf")] * 5), (None, [0.5] * 5), (450, [0.25, 0.5]), (500, [0.75, -0.5]), (550, [1e6] * 5)]
    rows += [(550, [1e6] * 5), (7, [9.0] * 5), (600, [0.0] * 5)]
    got = t.top_k(spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, score int"), shard_size=shard)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 50)


def test_empty(spark):
    assert t.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
