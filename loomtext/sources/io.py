"""Scans and sinks of the curation and evaluation jobs."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import curate
from loomtext.plans.config import check_run_config


def read_pairs(spark: SparkSession, path: str, source_index: str | None = None) -> DataFrame:
    """Raw pairs of a Parquet table; ``source_index`` names a column that orders them, else one numbers them as the files do."""
    rows = spark.read.parquet(path)
    index = F.col(source_index).cast("long") if source_index else F.monotonically_increasing_id()
    return rows.select(index.alias("source_index"), "eng", "wes")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header, quoted line breaks and doubled quotes; all strings without a schema.

    A quoted nothing is an empty text, an unquoted one null.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    reader = reader.option("nullValue", "\0")  # unequal to the empty text, so that the two stay apart
    reader = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; white space at the ends and empty texts stay as they are, null is an unquoted nothing."""
    writer = rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_run_config(path: str) -> dict[str, Any]:
    import yaml

    return check_run_config(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def write_run_config(config: Mapping[str, Any], path: str) -> None:
    import yaml

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(dict(config), sort_keys=False, allow_unicode=True), encoding="utf-8")


def write_json(report: Mapping[str, Any], path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False), encoding="utf-8")


def read_json(path: str) -> dict[str, Any]:
    if not Path(path).exists():
        raise FileNotFoundError(path)
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_runtime_metadata(path: str, backend: str, base_model: str, directions: list[str], extra: Mapping[str, Any] | None = None) -> None:
    fixed = {"backend": backend, "base_model": base_model, "directions": directions, "source_language": "eng_Latn", "target_language": "wes_Latn"}
    write_json(fixed | dict(extra or {}), path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_lines(rows: DataFrame, path: str) -> None:
    """One text a line."""
    rows.select("value").write.mode("overwrite").text(path)


def write_public_split(split: DataFrame, path: str) -> None:
    curate.public_split(split).write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One split of a written table of splits: a partition filter, so that the other splits' files are not read."""
    return spark.read.parquet(path).where(F.col("split") == name)


def save_artifacts(folder: str, audit: Mapping[str, Any], report: Mapping[str, Any], split: DataFrame, rejected: DataFrame) -> dict[str, Any]:
    """Writes splits and rejected rows as Parquet, audit, report and manifest as JSON; returns the manifest."""
    split.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/clean_splits")
    rejected.write.mode("overwrite").parquet(f"{folder}/rejected_rows")
    counts = curate.split_manifest(split).collect()
    manifest = {
        "rows_by_split": {r["split"]: r["rows"] for r in counts},
        "groups_by_split": {r["split"]: r["groups"] for r in counts},
        "fingerprint_sha256": curate.fingerprint(split).first()[0],
    }
    for name, content in (("data_audit", audit), ("cleaning_report", report), ("split_manifest", manifest)):
        write_json(content, f"{folder}/{name}.json")
    return manifest
