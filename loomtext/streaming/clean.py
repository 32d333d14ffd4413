"""An extension: the row-wise cleaning rules over a stream of pairs."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.curate import judged_pairs
from loomtext.plans.config import CleaningConfig


def judged_stream(pairs: DataFrame, config: Mapping[str, Any] | CleaningConfig | None = None) -> DataFrame:
    """Judged pairs of a stream (source_index, eng, wes); copies are for a batch job to find."""
    return judged_pairs(pairs, config)


def rejection_windows(pairs: DataFrame, time: str, width: str = "10 minutes", late: str = "10 minutes", config: Mapping[str, Any] | CleaningConfig | None = None) -> DataFrame:
    """Rows by rejection reason in windows of event time; later rows than ``late`` are dropped by the watermark."""
    times = pairs.withWatermark(time, late)
    judged = judged_pairs(times.withColumnRenamed(time, "at"), config, keep=("at",))
    return judged.groupBy(F.window("at", width), F.coalesce("rejection_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("rows"))
