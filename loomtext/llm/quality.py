"""Quality classifier by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.columns import fields

#: Training rows: so many trusted positives and so many unlabelled texts at most, by smallest hash of their id.
POSITIVES, UNLABELLED, SEED = 4000, 8000, 11
#: Characters fall in KINDS kinds; a text's features are shares of pairs of kinds and of words' shapes.
KINDS = 24
THRESHOLD = 0.3
STEPS, RATE, DECAY = 600, 0.05, 1e-3


@cache
def _kinds() -> np.ndarray:
    """Kind of each code point: letter cases, digits, space, line end, common marks by themselves, other marks, symbols, controls."""
    alone = {c: 8 + i for i, c in enumerate(".,!?'\"-:;|#$%&*")}
    out = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        group = unicodedata.category(chr(c))
        out[c] = alone.get(chr(c)) or {"Lu": 1, "Lt": 1, "Nd": 3, "Zs": 4, "Cc": 7}.get(group) or {"L": 2, "N": 3, "P": 6, "S": 23, "M": 2}.get(group[0], 0)
    out[10] = out[13] = 5
    return out


WIDTH = KINDS * KINDS + 8


def features(text: str | None) -> np.ndarray:
    """Roots of the shares of neighbouring kinds over a whole text, and shares of its words and lines."""
    out = np.zeros(WIDTH, dtype=np.float32)
    if not text:
        return out
    kinds = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    edged = np.concatenate([[5], kinds, [5]])
    pairs = np.bincount(edged[:-1] * KINDS + edged[1:], minlength=KINDS * KINDS)
    out[: KINDS * KINDS] = np.sqrt(pairs / pairs.sum())
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    letters = np.isin(kinds, (1, 2)).sum()
    out[KINDS * KINDS :] = (
        math.log1p(len(words)) / 10, len(set(words)) / n, len(set(lines)) / max(1, len(lines)), letters / len(kinds),
        (kinds == 1).sum() / max(1, letters), min(1.0, len(text) / n / 20), min(1.0, n / max(1, len(lines)) / 100), 1.0 if words else 0.0,
    )
    return out


@dataclass
class Model:
    """A linear score over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the positive class."""
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(x: np.ndarray, slope, start: float) -> tuple[np.ndarray, float]:
    """Adam on the gradient that ``slope`` gives for the scores of the rows of ``x``."""
    w = np.zeros(x.shape[1] + 1)
    w[-1] = start
    ones = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        g = slope(ones @ w) @ ones + DECAY * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio, over score thresholds, of both sides' upper tails.

    Where only positives score high the ratio is the share; the bound's slack shrinks with the rows.
    """
    n, m = len(positive), len(unlabelled)
    slack = math.sqrt(math.log(20) / (2 * n)) + math.sqrt(math.log(20) / (2 * m))
    best, share = math.inf, 1.0
    for t in np.unique(np.quantile(positive, np.linspace(0, 0.98, 99))):
        p, u = float((positive >= t).mean()), float((unlabelled >= t).mean())
        if p and (u + slack) / p < best:
            best, share = (u + slack) / p, u / p
    return min(0.99, max(0.01, share))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Minimises the non-negative unbiased risk with the logistic loss.

    risk = prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]); where the second part
    is below zero its gradient is turned round. The prior is estimated from a first fit of positives
    against unlabelled. Without positives or unlabelled rows every score is one half.
    """
    width = positive.shape[1] if positive.ndim == 2 else WIDTH
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, prior or 0.5)
    x = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = (x - mean) / scale
    n, m = len(positive), len(unlabelled)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    if prior is None:
        w, b = _descend(x, lambda z: np.r_[-sigma(-z[:n]) / (2 * n), sigma(z[n:]) / (2 * m)], 0.0)
        z = x @ w + b
        prior = estimate_prior(z[:n], z[n:])

    def slope(z: np.ndarray) -> np.ndarray:
        loss = lambda y: np.logaddexp(0, y)
        negative = loss(z[n:]).mean() - prior * loss(z[:n]).mean()
        on_p, on_u = -prior * sigma(z[:n]) / n, sigma(z[n:]) / m
        if negative < 0:
            return np.r_[-on_p, -on_u]
        return np.r_[-prior * sigma(-z[:n]) / n + on_p, on_u]

    w, b = _descend(x, slope, math.log(prior / (1 - prior)))
    return Model(mean, scale, w, b, prior)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels teach nothing: 5 divides the CRC-32 of the id as text. A null id is not held out; it has no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = [features(t).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["positive", "x"])


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on bounded samples: texts whose label is 1, and texts without one, of the rows that are not held out.

    A document that has any label 1 is positive. Both samples are those with the smallest hash of
    their id, so they are the same on every run; documents of other labels are in neither. Of rows
    that repeat an id, the one whose text hashes least teaches; null ids teach nothing.
    """
    docs, labels = fields(docs, id_col, text_col), fields(labels, id_col, label_col)
    ids = docs.where(F.col("f0").isNotNull() & ~held_out("f0")).select(F.col("f0").cast("long").alias("id")).distinct()
    known = labels.where(F.col("f0").isNotNull()).groupBy(F.col("f0").cast("long").alias("id")).agg(F.max("f1").alias("label"))
    draw = F.xxhash64("id", F.lit(SEED))
    chosen = None
    for positive, rows, limit in ((True, ids.join(known.where("label = 1"), "id", "left_semi"), positives), (False, ids.join(known, "id", "left_anti"), unlabelled)):
        part = rows.orderBy(draw, "id").limit(limit).withColumn("positive", F.lit(positive))
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most positives + unlabelled ids, and of each one row alone: a proven bound for the broadcast and for the driver.
    text = docs.select(F.col("f0").cast("long").alias("id"), F.col("f1").cast("string").alias("text"))
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    rows = text.join(F.broadcast(chosen), "id").groupBy("id", "positive").agg(least).select("positive", "least.text")
    rows = rows.mapInArrow(_features, "positive boolean, x binary").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), dtype=np.float32).reshape(-1, WIDTH)
    is_positive = np.array(rows["positive"].to_pylist(), dtype=bool)
    return fit(_sorted(x[is_positive]), _sorted(x[~is_positive]))


def _sorted(x: np.ndarray) -> np.ndarray:
    """Rows in an order of their own, so that sums do not hang on the order of arrival."""
    return x[sorted(range(len(x)), key=lambda i: x[i].tobytes())]


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, from its whole text alone.

    Null text is empty and is scored like any; rows and ids may repeat or be null; an empty table
    gives no rows, and without labels every score is one half.
    """
    model = learn(docs, labels, id_col=id_col, text_col=text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(np.array([features(t) for t in batch.column(2).slice(at, 500).to_pylist()])) for at in range(0, batch.num_rows, 500)]
            s = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = fields(docs, id_col, text_col).select(F.col("f0").cast("long").alias("doc_id"), held_out("f0").alias("held_out"), F.col("f1").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
