"""Whole jobs: curation of a corpus, evaluation of a benchmark, comparison of two systems."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators import benchmarks, curate, metrics
from loomtext.plans.config import CleaningConfig, require_known_directions
from loomtext.plans.runtime import materialise


def audit_report(pairs: DataFrame) -> dict[str, Any]:
    """All audit figures, rounded as reports show them."""
    counts = curate.audit_counts(pairs).first().asDict()
    rows = counts["rows"]
    for name in ("religious_marker", "english_space_before_punctuation"):
        counts[f"{name}_percent"] = round(100 * counts[f"{name}_rows"] / rows, 2) if rows else 0.0
    for r in curate.audit_summary(pairs).collect():
        counts[r["measure"]] = {k: None if r[k] is None else round(r[k], 3) for k in ("mean", "p01", "p50", "p95", "p99", "max")}
    sides = {r["side"]: r["groups"] for r in curate.conflict_groups(pairs).collect()}
    counts |= {"english_conflicting_target_groups": sides["eng"], "wes_conflicting_source_groups": sides["wes"]}
    return counts | {"fingerprint_sha256": curate.fingerprint(pairs).first()[0]}


def curate_corpus(pairs: DataFrame, config: Mapping[str, Any] | CleaningConfig | None = None, validation_ratio: float = 0.05, test_ratio: float = 0.05, seed: int = 42) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """(split pairs, rejected pairs, cleaning report); raises if nothing stays or a split is empty or leaks."""
    config = CleaningConfig.of(config)
    clean = materialise(curate.clean_pairs(pairs, config), "clean")
    accepted = clean.count()
    if not accepted:
        raise ValueError("no pairs remain after cleaning")
    rejected = materialise(curate.rejected_pairs(pairs, config), "rejected")
    counts = {r["rejection_reason"]: r["count"] for r in rejected.groupBy("rejection_reason").count().orderBy("rejection_reason").collect()}
    bad = sum(counts.values())
    report = {"config": config.as_dict(), "input_rows": accepted + bad, "accepted_rows": accepted, "rejected_rows": bad, "rejection_counts": counts, "clean_fingerprint_sha256": curate.fingerprint(clean).first()[0]}
    split = materialise(curate.split_pairs(clean, validation_ratio, test_ratio, seed), "split")
    curate.verify_split(split)
    return split, rejected, report


def evaluate(benchmark: DataFrame, model: Callable[[list[str]], list[str]] | None = None, directions: Iterable[str] | None = None, samples: int = 1000, seed: int = 42, name: str = "model") -> tuple[DataFrame, dict[str, Any]]:
    """(scored rows, metrics by direction); ``directions`` are those a checkpoint was trained for."""
    rows = benchmarks.completed_rows(benchmark)
    if directions is not None:
        require_known_directions(rows, directions, "the checkpoint")
    scored = materialise(benchmarks.translate(rows, model).withColumn("model", F.lit(name)), "scored")
    out = {r["direction"]: metrics.rounded(r.asDict()) for r in metrics.corpus_metrics(scored).orderBy("direction").collect()}
    for r in metrics.bootstrap_interval(scored, samples=samples, seed=seed, exact=True).collect():
        out[r["direction"]]["chrf_95_ci"] = metrics.rounded(r.asDict())
    return scored, out


def compare(a: DataFrame, b: DataFrame, metric: str = "chrf_plus_plus", samples: int = 1000, seed: int = 42) -> dict[str, Any]:
    """Paired comparison by direction."""
    rows = metrics.paired_bootstrap(a, b, metric, samples, seed, exact=True).orderBy("direction").collect()
    return {r["direction"]: metrics.rounded({k: v for k, v in r.asDict().items() if k != "direction"}) for r in rows}
