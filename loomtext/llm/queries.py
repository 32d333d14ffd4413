"""Thin queries over the operators of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import importlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import license as licenses
from loomtext.llm import decontaminate, langid, mixing, pii, quality, simhash, sstable, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file, from its package or from /opt/tokenizers; every machine has it."""
    try:
        return importlib.import_module("public_tokenizers").path(name)
    except ImportError:
        return str(Path("/opt/tokenizers") / name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(table(spark, sf_dir, "documents"), pii.DEMO_KEY)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_mix": op4_mix,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_shards": op6_shards,
    "op7_language": op7_language,
    "op8_license": op8_license,
    "op9_quality": op9_quality,
    "op10_topk": op10_topk,
}

ORACLE_SQL = {"op3_warc": warc.ORACLE_SQL, "op4_mix": mixing.ORACLE_SQL, "op10_topk": topk.ORACLE_SQL}
