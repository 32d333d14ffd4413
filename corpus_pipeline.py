"""A training corpus from ``documents``: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import decontaminate, langid, mixing, simhash, sstable
from loomtext.llm.queries import table, tokenizer_path
from loomtext.plans.runtime import bound_batches, materialise

#: Texts less like every learned language than this are no language's, unless too short to tell.
LEAST_COSINE = 0.08


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages.

    Null and empty texts and those without letters go; ids may be null or repeat, each row being
    decided by its own text; other columns stay; an empty table stays empty.
    """
    bound_batches(spark)
    return langid.reject_unidentified(docs, LEAST_COSINE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    The smallest id of a class stays, null ids last, and of rows that repeat it one; null and empty
    texts are one class; other columns stay; an empty table stays empty.
    """
    bound_batches(spark)
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark text.

    Null and empty texts and all rows stay as they are where nothing overlaps, repeated ones stay or
    go together; an empty table stays empty.
    """
    bound_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them.

    Texts without words are never taken; a null source is one source; rows that repeat id and text
    are taken equally often; other columns stay; an empty table stays empty.
    """
    return mixing.repeat_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID shards of the mix: what reads back of each document.

    Null text is empty, null ids come first, each of repeated rows has an entry; an empty table
    writes no shard and gives no rows.
    """
    bound_batches(spark)
    return sstable.token_shards(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token output", write_tokens),
]

#: Profiles, seeds and tokens are not SQL's; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
