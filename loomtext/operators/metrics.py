"""Corpus translation metrics and resampling, as sums over one table of per-row statistics."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from loomtext.functions import text as T
from loomtext.functions.mt_stats import BETA, BLEU_ORDER, STATS, WIDTHS
from loomtext.plans.config import require_columns
from loomtext.plans.runtime import materialise, numbered

METRICS = ("chrf_plus_plus", "sacrebleu", "ter")
DESCRIPTORS = {
    "sacrebleu": "BLEU|orders:4|tok:13a|effective order|smooth:exp",
    "chrf_plus_plus": "chrF|chars:6|words:2|beta:2|case:mixed|space:no",
    "ter": "TER|case:lower|shifts:greedy 10 words 50 places",
}


def row_stats(predictions: DataFrame, metrics: Sequence[str] = METRICS, keep: Sequence[str] = ("id", "direction")) -> DataFrame:
    """(keep, one array of counts a metric) of each (prediction, reference) row; null texts count as empty.

    One pass over Arrow batches without a shuffle; every score and resample is a weighted sum over it.
    """
    require_columns(predictions, (*keep, "prediction", "reference"), "predictions")
    if unknown := sorted(set(metrics) - set(METRICS)):
        raise ValueError(f"unknown metrics: {unknown}")
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("prediction", "reference")]
    rows = predictions.select(*keep, *texts)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True))
            arrays = [pa.array([STATS[m](h, r) for h, r in pairs], pa.list_(pa.int64())) for m in metrics]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *arrays], [*keep, *metrics])

    schema = rows.select(*keep).schema
    for m in metrics:
        schema = schema.add(m, ArrayType(LongType()))
    return rows.mapInArrow(stats, schema)


def _sums(metric: str, weight: Column | None = None) -> Column:
    cells = [F.get(F.col(metric), F.lit(i)) for i in range(WIDTHS[metric])]
    return F.array(*(F.sum(c if weight is None else c * weight) for c in cells))


def bleu_score(s: Column) -> Column:
    """From matches and totals by order and both lengths: orders up to the first without n-grams, zero matches smoothed by powers of two."""
    logs, orders, zeros, open_ = F.lit(0.0), F.lit(0), F.lit(0), F.lit(True)
    for n in range(BLEU_ORDER):
        match, total = s[n], s[BLEU_ORDER + n]
        open_ = open_ & (total > 0)
        zeros = zeros + F.when(open_ & (match == 0), 1).otherwise(0)
        share = F.when(match > 0, 100.0 * match / F.greatest(total, F.lit(1))).otherwise(100.0 / (F.pow(F.lit(2.0), zeros) * F.greatest(total, F.lit(1))))
        logs = logs + F.when(open_, F.log(share)).otherwise(0.0)
        orders = orders + F.when(open_, 1).otherwise(0)
    hyp, ref = s[2 * BLEU_ORDER], s[2 * BLEU_ORDER + 1]
    brevity = F.when(hyp >= ref, 1.0).when(hyp > 0, F.exp(1 - ref / F.greatest(hyp, F.lit(1)))).otherwise(0.0)
    found = s[0] + s[1] + s[2] + s[3] > 0
    return F.when(found, brevity * F.exp(logs / F.greatest(orders, F.lit(1)))).otherwise(0.0)


def chrf_score(s: Column) -> Column:
    """From counts (hypothesis, reference, match) by order: mean precision and recall over orders that both sides have."""
    precision, recall, orders = F.lit(0.0), F.lit(0.0), F.lit(0)
    for i in range(0, WIDTHS["chrf_plus_plus"], 3):
        both = (s[i] > 0) & (s[i + 1] > 0)
        precision = precision + F.when(both, s[i + 2] / F.greatest(s[i], F.lit(1))).otherwise(0.0)
        recall = recall + F.when(both, s[i + 2] / F.greatest(s[i + 1], F.lit(1))).otherwise(0.0)
        orders = orders + F.when(both, 1).otherwise(0)
    p, r = precision / F.greatest(orders, F.lit(1)), recall / F.greatest(orders, F.lit(1))
    b = float(BETA**2)
    return F.when(p + r > 0, 100.0 * (1 + b) * p * r / F.greatest(b * p + r, F.lit(1e-300))).otherwise(0.0)


def ter_score(s: Column) -> Column:
    return F.when(s[1] > 0, 100.0 * s[0] / F.greatest(s[1], F.lit(1))).when(s[0] > 0, 100.0).otherwise(0.0)


SCORES = {"sacrebleu": bleu_score, "chrf_plus_plus": chrf_score, "ter": ter_score}


def score_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (prediction, reference[, source]) with exact_match, length_ratio and source_copy."""
    prediction, reference = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("prediction", "reference"))
    at_least_one = lambda x: F.greatest(T.word_count(x), F.lit(1))
    key = T.normalize_key(prediction)
    out = {"exact_match": key == T.normalize_key(reference), "length_ratio": at_least_one(prediction) / at_least_one(reference)}
    if "source" in rows.columns:
        out["source_copy"] = key == T.normalize_key(F.coalesce(F.col("source").cast("string"), F.lit("")))
    return rows.withColumns(out)


def corpus_metrics(predictions: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row a direction: count, scores, exact match and source copies in percent, mean length ratio."""
    stats = row_stats(predictions, metrics).groupBy("direction").agg(F.count("*").alias("count"), *(_sums(m).alias(m) for m in metrics))
    stats = stats.select("direction", "count", *(SCORES[m](F.col(m)).alias(m) for m in metrics))
    rows = score_rows(predictions)
    more = [F.avg(F.col("exact_match").cast("double") * 100).alias("exact_match_percent"), F.avg("length_ratio").alias("mean_output_reference_word_ratio")]
    if "source_copy" in rows.columns:
        more.append(F.avg(F.col("source_copy").cast("double") * 100).alias("source_copy_percent"))
    return stats.join(rows.groupBy("direction").agg(*more), "direction")


def _check(metric: str, samples: int, rows: DataFrame) -> None:
    if samples < 20:
        raise ValueError("a bootstrap takes 20 samples or more")
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if rows.isEmpty():
        raise ValueError("a bootstrap takes at least one row")


def _replayed(samples: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(direction, sample, row, weight) of directions (direction, n), as ``random`` draws them one after another."""
    for batch in batches:
        for direction, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rng = random.Random(seed)
            for s in range(samples):
                counts = np.bincount(np.fromiter((rng.randrange(n) for _ in range(n)), dtype=np.int64, count=n), minlength=n)
                row = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([direction] * len(row)), pa.array(np.full(len(row), s, dtype=np.int32)), pa.array(row), pa.array(counts[row])], ["direction", "sample", "row", "weight"])


def _draws(stats: DataFrame, samples: int, seed: int, exact: bool) -> DataFrame:
    """``stats`` (direction, id, ...) with ``sample`` and ``weight``: how often a resample draws the row.

    Draw k of sample s is a hash of seed, s and k, and rows are numbered by id within their
    direction. ``exact`` replays the generator of Python's ``random`` instead, in one task a
    direction, a sample at a time, and numbers rows in the order in which they were read.
    """
    order = "read" if exact else "id"
    rows = numbered(stats, "direction", order, name="row")
    sizes = rows.groupBy("direction").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    rows = materialise(rows.join(F.broadcast(sizes.select("direction", "first")), "direction").withColumn("row", F.col("row") - F.col("first")), "bootstrap-rows")
    sizes = sizes.drop("first")  # one row a direction
    if exact:
        drawn = sizes.repartition("direction").mapInArrow(lambda it: _replayed(samples, seed, it), "direction string, sample int, row long, weight long")
    else:
        grid = sizes.select("direction", "n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
        grid = grid.repartition("direction", "sample").select("direction", "sample", "n", F.explode(F.expr("sequence(0L, n - 1)")).alias("k"))
        h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("sample").cast("string"), F.col("k").cast("string")), 256), 1, 15), 16, 10).cast("long")
        drawn = grid.select("direction", "sample", (h % F.col("n")).alias("row")).groupBy("direction", "sample", "row").agg(F.count("*").alias("weight"))
    return drawn.join(rows, ["direction", "row"])


def _interval(scores: DataFrame, value: str, samples: int, confidence: float) -> DataFrame:
    """(direction, lower, upper, ...): order statistics of the samples' values; a direction has ``samples`` of them."""
    alpha = (1 - confidence) / 2
    low, high = max(0, math.floor(alpha * (samples - 1))), min(samples - 1, math.ceil((1 - alpha) * (samples - 1)))
    v = F.col(value)
    aggs = [F.array_sort(F.collect_list(v)).alias("all"), F.avg((v <= 0).cast("double")).alias("below"), F.avg((v >= 0).cast("double")).alias("above")]
    return scores.groupBy("direction").agg(*aggs).select("direction", F.col("all")[low].alias("lower"), F.col("all")[high].alias("upper"), "below", "above")


def bootstrap_interval(predictions: DataFrame, metric: str = "chrf_plus_plus", samples: int = 1000, seed: int = 42, confidence: float = 0.95, exact: bool = False) -> DataFrame:
    """One row a direction: estimate, lower, upper, confidence, samples."""
    _check(metric, samples, predictions)
    stats = materialise(row_stats(predictions.withColumn("read", F.monotonically_increasing_id()), [metric], ("read", "id", "direction")), "bootstrap-stats")
    point = stats.groupBy("direction").agg(SCORES[metric](_sums(metric)).alias("estimate"))
    drawn = _draws(stats, samples, seed, exact).groupBy("direction", "sample").agg(_sums(metric, F.col("weight")).alias("s"))
    scores = drawn.select("direction", SCORES[metric](F.col("s")).alias("score"))
    out = point.join(_interval(scores, "score", samples, confidence), "direction")
    return out.select("direction", "estimate", "lower", "upper", F.lit(confidence).alias("confidence"), F.lit(samples).alias("samples"))


def aligned_systems(a: DataFrame, b: DataFrame, numbered_rows: bool = False) -> DataFrame:
    """Both systems' predictions joined one to one on id and direction; ``read`` numbers them as A's were read, if asked for.

    Raises if a side repeats a row, if the sides hold different rows, or if their references differ.
    """
    needed = ("id", "direction", "reference", "prediction")
    for name, side in (("system A", a), ("system B", b)):
        require_columns(side, needed, name)
        if not side.groupBy("id", "direction").count().where("count > 1").isEmpty():
            raise ValueError(f"{name} repeats an id and direction")
    left = a.select("id", "direction", F.monotonically_increasing_id().alias("read"), F.col("reference").alias("reference_a"), F.col("prediction").alias("prediction_a"), F.lit(1).alias("in_a"))
    right = b.select("id", "direction", F.col("reference").alias("reference_b"), F.col("prediction").alias("prediction_b"), F.lit(1).alias("in_b"))
    both = materialise(left.join(right, ["id", "direction"], "full"), "aligned")
    if not both.where("in_a is null or in_b is null").isEmpty():
        raise ValueError("the systems do not hold the same ids and directions")
    if not both.where("not (cast(reference_a as string) <=> cast(reference_b as string))").isEmpty():
        raise ValueError("the systems' references differ")
    return both.select("id", "direction", F.col("reference_a").alias("reference"), "prediction_a", "prediction_b", *(["read"] if numbered_rows else []))


def paired_bootstrap(a: DataFrame, b: DataFrame, metric: str = "chrf_plus_plus", samples: int = 1000, seed: int = 42, confidence: float = 0.95, exact: bool = False) -> DataFrame:
    """One row a direction: both scores, their difference with its interval and two-sided p, from the same resamples."""
    both = aligned_systems(a, b, numbered_rows=True)
    _check(metric, samples, both)
    sides = [row_stats(both.withColumnRenamed(f"prediction_{x}", "prediction"), [metric], ("read", "id", "direction")).withColumnRenamed(metric, f"s{x}") for x in "ab"]
    stats = materialise(sides[0].join(sides[1].drop("read"), ["id", "direction"]), "paired-stats")
    score = lambda x, w=None: SCORES[metric](F.array(*(F.sum(F.get(F.col(f"s{x}"), F.lit(i)) * (1 if w is None else F.col(w))) for i in range(WIDTHS[metric]))))
    point = stats.groupBy("direction").agg(F.count("*").alias("count"), score("a").alias("score_a"), score("b").alias("score_b"))
    drawn = _draws(stats, samples, seed, exact).groupBy("direction", "sample").agg(score("a", "weight").alias("x"), score("b", "weight").alias("y"))
    interval = _interval(drawn.withColumn("d", F.col("x") - F.col("y")), "d", samples, confidence)
    p = F.least(F.lit(1.0), 2 * F.least("below", "above"))
    meaning = "lower_is_better" if metric == "ter" else "higher_is_better"
    return point.join(interval, "direction").select(
        "direction", F.lit(metric).alias("metric"), "count", "score_a", "score_b", (F.col("score_a") - F.col("score_b")).alias("difference_a_minus_b"),
        "lower", "upper", F.lit(confidence).alias("confidence"), F.round(p, 6).alias("two_sided_p_approx"), F.lit(samples).alias("samples"), F.lit(meaning).alias("interpretation"),
    )


def rounded(row: dict, places: int = 4) -> dict:
    """A report's row with its floats rounded as the reports show them."""
    return {k: round(v, places) if isinstance(v, float) else v for k, v in row.items()}
