"""Toxicity (operator 1): a character n-gram linear classifier on naive-Bayes
scaled features.

A text is the set of hashed character n-grams of its lower-cased form (white
space runs count as one blank). Each feature is scaled by its naive Bayes
log-count ratio, the log of how much likelier it is in a toxic than in a clean
text, and a logistic regression is fitted on the scaled features. Most n-grams
of a text say nothing, so features whose ratio lies within ``dead_zone`` of
zero are left out: a long text is then not judged by the noise it adds up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, smallest

ORDERS = (5, 7, 8)
BITS = 21
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Featurizer:
    """Distinct hashed n-grams of a text, without sorting."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.seen = np.zeros(1 << bits, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        codes = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes = codes * _SPREAD + np.uint64(1)
        parts = []
        gram = codes
        for n in range(2, max(ORDERS) + 1):
            gram = gram[:-1] * _SPREAD + codes[n - 1 :] if len(gram) > 1 else gram[:0]
            if n in ORDERS:
                parts.append(((gram ^ (gram >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - self.bits))
        at = np.concatenate(parts).astype(np.int32)
        order = np.arange(len(at), dtype=np.int32)
        self.seen[at] = order  # the last of equal ones stays
        return at[self.seen[at] == order]


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def __getstate__(self):  # most weights are zero
        at = np.flatnonzero(self.weights)
        return len(self.weights), at.astype(np.int32), self.weights[at], self.bias

    def __setstate__(self, state):
        size, at, values, self.bias = state
        self.weights = np.zeros(size, np.float32)
        self.weights[at] = values

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum(dtype=np.float64) + self.bias)


def log_count_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, alpha: float = 4.0) -> np.ndarray:
    """Of document frequencies per class, not shares of all features: long texts
    count no more than short ones."""
    return np.log((pos + alpha) / (n_pos + 2 * alpha)) - np.log((neg + alpha) / (n_neg + 2 * alpha))


def fit(rows: list[np.ndarray], labels: np.ndarray, used: np.ndarray, ratio: np.ndarray, bits: int = BITS, l2: float = 0.1, steps: int = 100, toxic_weight: float = 2.5) -> Model:
    """Logistic regression on the features ``used`` (sorted), each scaled by its
    ratio; rows hold used features only. A toxic row counts ``toxic_weight``
    times: unseen texts have smaller margins than those of the fit. Without both classes, a constant of
    the base rate."""
    y = labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.02
        return Model(np.zeros(1 << bits), np.log(rate / (1 - rate)))
    share = np.where(y > 0, toxic_weight, 1.0)
    share /= share.sum()
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), np.fromiter(map(len, rows), np.int64, len(rows)))
    flat = np.searchsorted(used, np.concatenate(rows)).astype(np.int32)
    value = ratio.astype(np.float32)[flat]
    w, b = np.zeros(len(used)), np.log(y.mean() / (1 - y.mean()))
    # a step of Adam moves every weight alike: scaled so that a text of mean length moves by one or less
    pace = 1.0 / max(1.0, float(np.abs(value).sum()) / len(y))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[flat] * value, len(y)) + b
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.bincount(flat, value * g[owner], len(used)) + l2 * w / len(y)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = pace / (1 + t / 50)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << bits)
    weights[used] = w * ratio
    return Model(weights, b)



def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1500, dead_zone: float = 1.6, least: int = 5, share: float = 0.03) -> Model:
    """Fit on labelled documents.

    The fit uses a bounded sample: of each class the ``per_class`` ids of the
    smallest hash. A row of ``labels`` with a null id or label is skipped; an
    id with several labels counts as toxic if one of them says so. Features are
    computed and counted on the executors; to the driver come the counts of
    features in ``least`` texts and ``share`` of the smaller class or more, and for each text those of them whose
    ratio lies outside the dead zone.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    sample = smallest(own.withColumn("h", F.xxhash64("i")), "y", ["h", "i"], per_class).select("i", "y")
    # at most 2 x per_class rows: a proven bound
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(sample), "i").select("y", "t")

    def count(batches):
        features = Featurizer()
        tally = [np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)]
        for batch in batches:
            labels = np.asarray(batch.column(0))
            for i, texts in slices(batch, "t"):
                for k, x in enumerate(texts):
                    tally[labels[i + k]][features(x)] += 1
        at = np.flatnonzero(tally[0] + tally[1]).astype(np.int32)
        for s in range(0, len(at), 100_000):
            part = at[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(tally[1][part]), pa.array(tally[0][part])], names=["f", "pos", "neg"])

    classes = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    least = max(least, int(share * min(classes.get(0, 0), classes.get(1, 0))))
    counts = rows.mapInArrow(count, "f int, pos int, neg int").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= least).toArrow()
    f, pos, neg = (np.asarray(counts.column(i)) for i in range(3))
    ratio = log_count_ratio(pos, neg, classes.get(1, 0), classes.get(0, 0))
    order = np.argsort(f, kind="stable")
    order = order[np.abs(ratio[order]) >= dead_zone]
    used, ratio = f[order], ratio[order]

    def run(batches):
        features = Featurizer()
        wanted = np.zeros(1 << BITS, bool)
        wanted[used] = True
        for batch in batches:
            found = [(x := features(t))[wanted[x]].tobytes() for _, texts in slices(batch, "t") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["y", "f"])

    got = rows.mapInArrow(run, "y int, f binary").toArrow()
    return fit([np.frombuffer(x.as_buffer(), np.int32) for x in got.column(1)], np.asarray(got.column(0)), used, ratio)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Score every text.

    Result, one row per input row: the id column, ``score`` double in [0, 1]
    and ``predicted`` int (score >= threshold). A null or empty text has no
    n-grams and scores the model's base rate.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        features = Featurizer()
        for batch in batches:
            z = np.array([model.margin(features(x)) for _, texts in slices(batch, text_col) for x in texts])
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
