"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed character n-grams (within lower-cased text, over code points) is counted by class over a bounded
sample of labelled rows, as a distributed sum. The n-grams whose counts differ most between the classes are kept; each
is scaled by its smoothed log-count ratio, and a logistic regression is trained on the scaled features. The driver sees
hashed counts of kept n-grams and sparse rows of the sample only; both are bounded by parameters.

Defined results: null and empty texts have no n-gram and get the intercept's score; rows with null or repeated ids are
scored like any other; rows of one class only, or none, give a constant score; an empty table gives an empty result;
very long texts are read whole, in overlapping blocks; where labels of one id disagree, 1 stands; n-grams of equal
strength are kept by smaller hash; other columns, whatever their names, pass through keep_clean().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm.common import append, free_name, held_out, stored, tidy
from rulequarry.llm.linear import sample
from rulequarry.llm.minhash_forest import _some

#: Labelled rows that training uses at most.
TRAIN_ROWS = 20_000
#: Lengths of the n-grams in code points.
SIZES = (3, 4, 5, 6)
HASH_BITS = 21
#: N-grams that are kept, and rows that must hold one.
KEPT = 8_000
LEAST_ROWS = 4
BLOCK_CHARS = 1 << 17
THRESHOLD = 0.5
_BASE = np.uint32(0x9E3779B1)


def _grams(chars: np.ndarray):
    """For each size, the hashed n-gram that starts at each code point."""
    h = np.zeros(len(chars), dtype=np.uint32)
    for k in range(max(SIZES)):
        n = len(chars) - k
        if n <= 0:
            return
        h = h[:n] * _BASE + chars[k:]
        if k + 1 in SIZES:
            x = h ^ np.uint32(k * 0x1F123BB5 & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield k + 1, (x ^ (x >> np.uint32(12))) >> np.uint32(32 - HASH_BITS)


def _blocks(batch: list[str]):
    """(texts of the segments, offsets of the segments, code points): a text is a segment with a space at either end.

    A longer text than a block is cut into segments that overlap by an n-gram less one code point.
    """
    owners, parts, size = [], [], 0

    def block():
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return np.array(owners), np.concatenate(([0], np.cumsum([len(p) for p in parts]))), chars

    for i, text in enumerate(batch):
        whole = f" {text.lower()} "
        for k in range(0, max(1, len(whole) - max(SIZES) + 1), BLOCK_CHARS):
            part = whole[k : k + BLOCK_CHARS + max(SIZES) - 1]
            if parts and size + len(part) > BLOCK_CHARS:
                yield block()
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield block()


def present(batch: list[str], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, by text: slot gives the feature of a hashed n-gram, or -1."""
    out = []
    for owners, at, chars in _blocks(batch):
        found = []
        for size, grams in _grams(chars):
            feature = slot[grams]
            place = np.flatnonzero(feature >= 0)
            segment = np.searchsorted(at, place, side="right") - 1
            inside = place + size <= at[segment + 1]
            found.append(owners[segment[inside]] << 32 | feature[place[inside]].astype(np.int64))
        out.append(np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64))
    pairs = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    if (pairs[1:] <= pairs[:-1]).any():  # a text in several blocks
        pairs = np.unique(pairs)
    return pairs >> 32, pairs & 0xFFFFFFFF


def _counts(rows: DataFrame) -> DataFrame:
    """(gram, pos, neg): the rows of each class that hold a hashed n-gram."""

    def run(batches):
        own = np.arange(1 << HASH_BITS, dtype=np.int32)
        counts = np.zeros((2, 1 << HASH_BITS), dtype=np.int32)
        for pdf in batches:
            given, label = pdf["text"].tolist(), pdf["label"].to_numpy()
            for a, b in _some(given):
                text, gram = present(given[a:b], own)
                for c in (0, 1):
                    counts[c] += np.bincount(gram[label[a:b][text] == c], minlength=1 << HASH_BITS).astype(np.int32)
        some = np.flatnonzero(counts.sum(axis=0))
        for a in range(0, len(some), 1 << 18):
            part = some[a : a + (1 << 18)]
            yield pd.DataFrame({"gram": part, "pos": counts[1][part], "neg": counts[0][part]})

    return rows.mapInPandas(tidy(run), "gram long, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


class Model:
    """kept: hashed n-grams; weight: each one's log-count ratio times its trained weight; bias."""

    def __init__(self, kept: np.ndarray, weight: np.ndarray, bias: float):
        self.kept, self.weight, self.bias = kept, weight, bias

    def scorer(self):
        slot = np.full(1 << HASH_BITS, -1, dtype=np.int32)
        slot[self.kept] = np.arange(len(self.kept), dtype=np.int32)

        def score(batch: list[str]) -> np.ndarray:
            z = np.full(len(batch), float(self.bias))
            for a, b in _some(batch):
                text, feature = present(batch[a:b], slot)
                z[a:b] += np.bincount(text, weights=self.weight[feature], minlength=b - a)
            return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

        return score


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, label: np.ndarray, width: int, rounds: int = 300, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on a sparse table, by accelerated gradient steps."""
    n = len(label)

    def times(w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(rows, weights=values * w[columns], minlength=n)

    def back(g: np.ndarray) -> np.ndarray:
        return np.bincount(columns, weights=values * g[rows], minlength=width)

    # The step is the inverse of the loss's curvature, found by power iteration.
    u, v, top = np.ones(width) / max(width, 1) ** 0.5, 1.0, 1.0
    for _ in range(15):
        z = times(u, v)
        u, v = back(z), z.sum()
        top = float(np.sqrt((u**2).sum() + v * v)) or 1.0
        u, v = u / top, v / top
    step = 1 / (1.1 * top / (4 * n) + ridge)
    w, b, dw, db = np.zeros(width), 0.0, np.zeros(width), 0.0
    for t in range(rounds):
        k = t / (t + 3)
        aw, ab = w + k * dw, b + k * db
        g = (1 / (1 + np.exp(-np.clip(times(aw, ab), -500, 500))) - label) / n
        nw, nb = aw - step * (back(g) + ridge * aw), ab - step * g.sum()
        dw, db, w, b = nw - w, nb - b, nw, nb
    return w, b


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    chosen = stored(sample(docs, labels, label, rows, id_col, text_col), "sample")  # read three times
    counts = _counts(chosen).where(F.col("pos") + F.col("neg") >= LEAST_ROWS)
    totals = chosen.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in totals}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0 if pos == neg else 4.0 if pos else -4.0)
    # Log-likelihood ratio of each n-gram against the classes' sizes, on the executors; the strongest come to the driver.
    rate = (F.col("pos") + F.col("neg")) / F.lit(float(pos + neg))

    def part(seen, size):
        there = F.when(seen > 0, seen * F.log(seen / (size * rate))).otherwise(0.0)
        return there + F.when(seen < size, (size - seen) * F.log((size - seen) / (size * (1 - rate)))).otherwise(0.0)

    strength = F.when(rate < 1, part(F.col("pos"), F.lit(float(pos))) + part(F.col("neg"), F.lit(float(neg)))).otherwise(0.0)
    top = counts.withColumn("strength", strength).orderBy(F.desc("strength"), "gram").limit(KEPT).toPandas()
    kept = top["gram"].to_numpy(dtype=np.int64)
    p, q = top["pos"].to_numpy() + 1.0, top["neg"].to_numpy() + 1.0
    ratio = np.log((p / (pos + 2)) / (q / (neg + 2)))

    narrow = np.min_scalar_type(max(len(kept) - 1, 0))

    def sparse(batches):
        slot = np.full(1 << HASH_BITS, -1, dtype=np.int32)
        slot[kept] = np.arange(len(kept), dtype=np.int32)
        for pdf in batches:
            given, features = pdf["text"].tolist(), []
            for a, b in _some(given):
                text, feature = present(given[a:b], slot)
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                features += [feature[x:y].astype(narrow).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "features": features})

    table = chosen.mapInPandas(tidy(sparse), "doc_id long, label int, features binary").toPandas().sort_values(["doc_id", "features"])
    features = [np.frombuffer(x, dtype=narrow).astype(np.int64) for x in table["features"]]
    owner = np.repeat(np.arange(len(features)), [len(x) for x in features])
    column = np.concatenate(features) if features else np.zeros(0, dtype=np.int64)
    weight, bias = logistic(owner, column, ratio[column], table["label"].to_numpy(dtype=float), len(kept))
    return Model(kept, weight * ratio, bias)


def score(docs: DataFrame, model: Model, column: str = "score", text_col: str = "text") -> DataFrame:
    """docs with the score of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # KEPT numbers at most

    def make():
        scorer = held.value.scorer()
        return lambda batch: [pa.array(scorer(batch), pa.float64())]

    return append(docs, text_col, f"{column} double", make)


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score(own, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below the threshold; all columns of docs, whatever their names."""
    column = free_name(docs, "toxicity")
    return score(docs, train(docs, labels, text_col=text_col), column, text_col).where(F.col(column) < THRESHOLD).drop(column)
