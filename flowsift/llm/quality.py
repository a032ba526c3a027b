"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Labelled negatives are never used: trusted positives and unlabelled web text give the class
prior (mixture proportion) and, with it, the risk that is minimised. Its loss is logistic,
so the score is an estimate of the probability itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold, raw, sigmoid

#: Rows learned from: trusted positives, unlabelled texts.
POSITIVES, UNLABELLED = 6_000, 12_000

_MARKS = [b"!", b"#%&*$@^~=+<>", b"|\\/_[]{}", b".,;:?", b"0123456789", bytes(range(65, 91))]
_KIND = np.zeros(256, np.int64)
for _k, _m in enumerate(_MARKS):
    _KIND[list(_m)] = _k + 1
_KIND[128:] = len(_MARKS) + 1
N_FEATURES = len(_MARKS) + 1 + 9


def features(text: bytes) -> np.ndarray:
    """Shape of a whole text: marks, upper case, digits, word lengths, repetition. Empty: zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(N_FEATURES)
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=len(_MARKS) + 2)[1:]
    lines = [x for x in text.split(b"\n") if x.strip()]
    low = text.lower().split()
    pairs = len(set(zip(low, low[1:]))) / max(1, n - 1)
    again = sum(a == b for a, b in zip(low, low[1:])) / n
    marked = sum(w[-1:] in b"!#%&*$|" for w in words) / n
    letters = max(1.0, len(text) - n)
    rest = [len(set(low)) / n, pairs, again, marked, np.log1p(letters / n), np.log1p(n), len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), 1.0]
    return np.r_[np.sqrt(kinds / letters), rest]


def _rows(docs: DataFrame, ids: DataFrame) -> pd.DataFrame:
    """Features of the documents named by a bounded table of ids; `ids` keeps its other columns."""
    names = [f"f{i}" for i in range(N_FEATURES)]
    keep = [c for c in ids.columns if c != "doc_id"]
    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in raw(b.column("text"))]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(c).cast(pa.float64()) for c in keep] + [pa.array(x[:, i]) for i in range(N_FEATURES)], keep + names)

    return got.mapInArrow(run, ", ".join(f"{c} double" for c in keep + names)).toArrow().to_pandas()


def _spread(x: np.ndarray) -> np.ndarray:
    """Features, their squares and products with the amount of repetition."""
    return np.c_[x, x * x, x[:, :-1] * x[:, [8]]]


class Model:
    """Linear log-odds of spread features."""

    def __init__(self, mean: np.ndarray, dev: np.ndarray, w: np.ndarray, prior: float):
        self.mean, self.dev, self.w, self.prior = mean, dev, w, prior

    def rows(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((_spread(x) - self.mean) / self.dev, -8, 8)
        z[:, N_FEATURES - 1] = 1.0  # the constant
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.rows(x) @ self.w)


def _fresh(both: np.ndarray, prior: float) -> Model:
    """A model with the features' means and deviations and no weights yet."""
    spread = _spread(both)
    dev = spread.std(0)
    return Model(spread.mean(0), np.where(dev < 1e-9, 1.0, dev), np.zeros(spread.shape[1]), prior)


def _adam(w: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m = v = np.zeros(len(w))
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def pu_risk(w: np.ndarray, zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * R_p(+) and R_u(-) - prior * R_p(-) for the logistic loss."""
    loss = lambda z: np.logaddexp(0, -z).mean()
    return prior * loss(zp @ w), loss(-(zu @ w)) - prior * loss(-(zp @ w))


def pu_gradients(w: np.ndarray, zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of both parts of pu_risk."""
    sp, su = sigmoid(zp @ w), sigmoid(zu @ w)
    return -prior * (zp.T @ (1 - sp)) / len(zp), zu.T @ su / len(zu) - prior * (zp.T @ sp) / len(zp)


def fit_pu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 800, rate: float = 0.03, decay: float = 1e-3) -> Model:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) by Adam.

    If the bracket falls under zero its gradient is followed upwards, as the
    non-negative estimator does, so that the unlabelled texts aren't overfitted.
    """
    model = _fresh(np.r_[p, u], prior)
    zp, zu = model.rows(p), model.rows(u)

    def gradient(w: np.ndarray) -> np.ndarray:
        plus, minus = pu_gradients(w, zp, zu, prior)
        return (plus + minus if pu_risk(w, zp, zu, prior)[1] >= 0 else -minus) + decay * w

    model.w = _adam(model.w, gradient, steps, rate)
    return model


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among the unlabelled, from positives and unlabelled texts alone.

    One half of each tells them apart; on the other half the share of unlabelled over that
    of positives above a cut bounds the prior from above, as purely positive texts are left
    at the top. The cut with the least upper confidence bound is taken (best-bin estimation).
    """
    model = _fresh(np.r_[p, u], 0.5)
    zp, zu = model.rows(p[::2]), model.rows(u[::2])
    apart = lambda w: -(zp.T @ (1 - sigmoid(zp @ w))) / len(zp) + zu.T @ sigmoid(zu @ w) / len(zu) + 1e-3 * w
    w = _adam(model.w, apart, 400, 0.03)
    sp, su = np.sort(model.rows(p[1::2]) @ w), np.sort(model.rows(u[1::2]) @ w)
    if not len(sp) or not len(su):
        return 0.5
    above = lambda s: 1 - np.searchsorted(s, sp, "left") / len(s)
    room = np.sqrt(np.log(4 / delta) / 2) * (len(su) ** -0.5 + len(sp) ** -0.5)
    at = int(np.argmin((above(su) + (1 + gamma) * room) / above(sp)))
    return float(np.clip(above(su)[at] / above(sp)[at], 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learns outside the held-out fold (crc32 of the id modulo 4 is 2); None without positives.

    Positives are rows labelled 1, the unlabelled texts any documents; the class prior is
    estimated from these two. Rows labelled 0 take no part.
    """
    known = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).distinct()
    outside = lambda df: df.where(fold(F.col("doc_id"), 4) != 2)
    ids = bounded(outside(known), "doc_id", POSITIVES).withColumn("positive", F.lit(1))
    ids = ids.unionByName(bounded(outside(docs.select(F.col("doc_id").cast("long"))), "doc_id", UNLABELLED).distinct().withColumn("positive", F.lit(0)))
    got = _rows(docs, ids.withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id"), 12))).sort_values(["place", "f0"])
    x = got[[c for c in got.columns if c[0] == "f"]].to_numpy()
    positive = got["positive"].to_numpy() == 1
    if not positive.any() or positive.all():
        return None
    return fit_pu(x[positive], x[~positive], estimate_prior(x[positive], x[~positive]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; predicted is 1 from 0.7 on.

    Null reads as empty; empty texts get the score of an empty text. Without a model the
    score is 0. Repeated rows and null ids stay (held_out is then false).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in raw(b.column(1))]).reshape(-1, N_FEATURES)
            s = model.score(x) if model else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.7).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
