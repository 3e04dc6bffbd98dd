"""Quality: a factorisation machine on hashed words, structure statistics and metadata.

y = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, where the pairwise sum is half of the squared sum minus the sum
of squares of each factor, so a text is scored in time linear in its features. Features are hashed words with
logarithmic counts of unit length, one indicator for each statistic's range (shares of capitals, digits, symbols and
line breaks, word lengths, repetition), and the length of the text, its metadata, by powers of two.

Trained by Adagrad on a bounded sample of labelled rows. Defined results: null and empty texts have the indicators of
an empty text; rows with null or repeated ids are scored like any other; a sample of one class, or none, gives a
constant score; an empty table gives an empty result; very long texts are read whole; where labels of one id disagree, 1
stands; other columns, whatever their names, are not read by predictions().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm.common import append, held_out, tidy
from rulequarry.llm.linear import sample
from rulequarry.llm.minhash_forest import _some
from rulequarry.llm.textkernel import LOWER, word_hashes

#: Labelled rows that training uses at most.
TRAIN_ROWS = 8_000
WORD_BITS = 16
FACTORS = 8
EPOCHS = 8
BATCH = 128
RATE = 0.1
THRESHOLD = 0.3
#: Ranges of each statistic that is a share: up to 0, 1/256, 1/128 ... and above 1/2.
SHARE_CUTS = np.array([0, *(2.0 ** -np.arange(8, 0, -1))])
LOG_CUTS = np.arange(0, 24)
STATISTICS = ("capitals", "digits", "symbols", "breaks", "non-ascii", "distinct words", "repeated neighbours", "most frequent word", "symbol-ended words", "word length", "characters", "words")
RANGES = 26
WIDTH = (1 << WORD_BITS) + len(STATISTICS) * RANGES

# Classes of bytes that the statistics count.
_CLASS = np.zeros((5, 256), dtype=bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, list(b"#$%&*|!<>{}[]=+~^_@\\/")] = True
_CLASS[3, 10] = True
_CLASS[4, 128:] = True


def features(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of all texts, sorted by text."""
    n = len(batch)
    data = [t.encode("utf-8", "surrogatepass") for t in batch]
    size = np.fromiter(map(len, data), dtype=np.int64, count=n)
    flat = np.frombuffer(b"".join(data) + b" ", dtype=np.uint8)
    cuts = np.concatenate(([0], np.cumsum(size)))
    stats = np.zeros((len(STATISTICS), n))
    for k in range(5):
        total = np.concatenate(([0], np.cumsum(_CLASS[k][flat])))
        stats[k] = (total[cuts[1:]] - total[cuts[:-1]]) / np.maximum(size, 1)
    total = None
    words, at = word_hashes([x.translate(LOWER) for x in data])
    count = np.diff(at)
    owner = np.repeat(np.arange(n), count)
    keys = (owner.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24))
    distinct, times = np.unique(keys, return_counts=True)
    of = (distinct >> np.uint64(40)).astype(np.int64)
    some = np.maximum(count, 1)
    stats[5] = np.bincount(of, minlength=n) / some
    same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1]) if len(words) else np.zeros(0, dtype=bool)
    stats[6] = np.bincount(owner[1:][same], minlength=n) / some
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    stats[7] = most / some
    after = flat[1:] <= 32
    ended = np.concatenate(([0], np.cumsum(_CLASS[2][flat[:-1]] & after)))
    stats[8] = (ended[np.minimum(cuts[1:], len(ended) - 1)] - ended[np.minimum(cuts[:-1], len(ended) - 1)]) / some
    stats[9] = np.minimum(size / some, 2.0**22)
    stats[10], stats[11] = size, count
    where = np.empty(stats.shape, dtype=np.int64)
    where[:9] = np.searchsorted(SHARE_CUTS, stats[:9])
    where[9:] = np.searchsorted(LOG_CUTS, np.log2(stats[9:] + 1))
    base = (1 << WORD_BITS) + np.arange(len(STATISTICS))[:, None] * RANGES
    word = (distinct & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    value = np.log1p(times)
    value /= np.sqrt(np.maximum(np.bincount(of, weights=value**2, minlength=n), 1e-12))[of]
    text = np.concatenate((of, np.tile(np.arange(n), len(STATISTICS))))
    order = np.argsort(text, kind="stable")
    return text[order], np.concatenate((word, (base + where).reshape(-1)))[order], np.concatenate((value, np.full(where.size, 0.5)))[order]


class Machine:
    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.bias, self.weight, self.factor = bias, weight, factor

    def raw(self, text: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """The sum-of-squares identity: one pass over the features for each factor."""
        z = self.bias + np.bincount(text, weights=self.weight[feature] * value, minlength=n)
        for f in range(self.factor.shape[0]):
            vx = self.factor[f][feature] * value
            z += 0.5 * (np.bincount(text, weights=vx, minlength=n) ** 2 - np.bincount(text, weights=vx * vx, minlength=n))
        return z

    def score(self, batch: list[str]) -> np.ndarray:
        out = [1 / (1 + np.exp(-np.clip(self.raw(*features(batch[a:b]), b - a), -500, 500))) for a, b in _some(batch)]
        return np.concatenate(out) if out else np.zeros(0)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, seed: int = 11) -> Machine:
    """Adagrad on logistic loss; texts: (features, values) of each row."""
    rng = np.random.default_rng(seed)
    share = min(max(label.mean(), 1e-3), 1 - 1e-3) if len(label) else 0.5
    bias, weight = float(np.log(share / (1 - share))), np.zeros(WIDTH)
    factor = rng.normal(0, 0.02, (FACTORS, WIDTH))
    if not len(label) or label.min() == label.max():
        return Machine(bias, weight, np.zeros((FACTORS, WIDTH)))
    sw, sv, sb = np.full(WIDTH, 1e-2), np.full((FACTORS, WIDTH), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            text = np.repeat(np.arange(len(some)), [len(texts[i][0]) for i in some])
            feature, value = np.concatenate([texts[i][0] for i in some]), np.concatenate([texts[i][1] for i in some])
            z = Machine(bias, weight, factor).raw(text, feature, value, len(some))
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label[some]) / len(some) ** 0.5
            used, place = np.unique(feature, return_inverse=True)
            gx = g[text] * value
            dw = np.bincount(place, weights=gx, minlength=len(used)) + 1e-4 * weight[used]
            sw[used] += dw**2
            weight[used] -= RATE * dw / np.sqrt(sw[used])
            for f in range(FACTORS):
                vx = factor[f][feature] * value
                total = np.bincount(text, weights=vx, minlength=len(some))
                dv = np.bincount(place, weights=gx * (total[text] - vx), minlength=len(used)) + 1e-3 * factor[f][used]
                sv[f][used] += dv**2
                factor[f][used] -= 0.5 * RATE * dv / np.sqrt(sv[f][used])
            sb += g.sum() ** 2
            bias -= RATE * g.sum() / np.sqrt(sb)
    return Machine(bias, weight, factor)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Machine:
    chosen = sample(docs, labels, label, rows, id_col, text_col)

    def sparse(batches):
        for pdf in batches:
            given = pdf["text"].tolist()
            for a, b in _some(given):
                text, feature, value = features(given[a:b])
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
                part = pdf.iloc[a:b]
                yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["label"], "features": [feature[x:y].astype(np.int32).tobytes() for x, y in pairs], "amounts": [value[x:y].astype(np.float32).tobytes() for x, y in pairs]})

    table = chosen.mapInPandas(tidy(sparse), "doc_id long, label int, features binary, amounts binary").toPandas().sort_values(["doc_id", "features"])
    rows_of = [(np.frombuffer(x, dtype=np.int32).astype(np.int64), np.frombuffer(v, dtype=np.float32).astype(np.float64)) for x, v in zip(table["features"], table["amounts"], strict=True)]
    return fit(rows_of, table["label"].to_numpy(dtype=float))


def score(docs: DataFrame, machine: Machine, column: str = "score", text_col: str = "text") -> DataFrame:
    """docs with the score of each row."""
    small = Machine(machine.bias, machine.weight.astype(np.float32), machine.factor.astype(np.float32))
    held = docs.sparkSession.sparkContext.broadcast(small)  # WIDTH * (FACTORS + 1) numbers

    def make():
        return lambda batch: [pa.array(held.value.score(batch), pa.float64())]

    return append(docs, text_col, f"{column} double", make)


def predictions(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score(own, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
