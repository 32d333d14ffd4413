"""Relations of parallel text derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of ``documents``; a table of fewer parts than cores is dealt out first."""
    docs, cores = table(spark, sf_dir, "documents").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


# Pairs of neighbouring non-blank lines, with noise by document so that every text rule has work.
ENG = """CASE WHEN doc_id % 3 = 0 THEN replace(replace(e, ',', ' ,'), '.', ' .')
     WHEN doc_id % 5 = 1 THEN concat(e, ' don '' t go') WHEN doc_id % 5 = 2 THEN concat('well - known ', e)
     WHEN doc_id % 11 = 3 THEN concat(e, ' Preachers') ELSE e END"""
WES = """CASE WHEN doc_id % 50 = 0 AND pos % 2 = 0 THEN '' WHEN doc_id % 7 = 0 THEN concat('(Ab 3:16) (Cd 1 : 2) ', w)
     WHEN doc_id % 13 = 5 THEN concat('( ', w, ' )') ELSE w END"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_index, doc_id, pos, eng, wes)."""
    lines = texts(spark, sf_dir).where("text is not null").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("l"))
    at = lines.where(F.size("l") > 1).select("doc_id", F.posexplode(F.expr("transform(sequence(1, size(l) - 1), i -> struct(l[i - 1] as e, l[i] as w))")).alias("pos", "p"))
    at = at.select("doc_id", (F.col("pos") + 1).alias("pos"), "p.e", "p.w")
    return at.select((F.col("doc_id") * 100000 + F.col("pos")).alias("source_index"), "doc_id", "pos", F.expr(ENG).alias("eng"), F.expr(WES).alias("wes"))


PAIRS_SQL = f"""lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents WHERE text IS NOT NULL),
nums AS (SELECT doc_id, l, unnest(range(1, len(l))) AS pos FROM lines),
raw AS (SELECT doc_id, CAST(pos AS INT) AS pos, l[pos] AS e, l[pos + 1] AS w FROM nums),
pairs AS MATERIALIZED (SELECT CAST(doc_id * 100000 + pos AS BIGINT) AS source_index, doc_id, pos, {ENG} AS eng, {WES} AS wes FROM raw)"""


def predictions(spark: SparkSession, sf_dir: str, system: str = "a") -> DataFrame:
    """(id, direction, source, reference, prediction): benchmark texts, spoilt by two made-up systems."""
    rows = table(spark, sf_dir, "benchmark").where("text is not null").withColumn("w", F.split("text", r"\s+"))
    a = F.array_join(F.filter("w", lambda x, i: (i + 1) % 7 != 0), " ")
    b = F.array_join(F.expr("transform(w, (x, i) -> case when i % 2 = 0 and i + 1 < size(w) then w[i + 1] when i % 2 = 1 then w[i - 1] else x end)"), " ")
    rows = rows.withColumns({"a": a, "b": F.when(F.col("item_id") % 5 == 0, F.col("text")).otherwise(b)})
    direction = F.when(F.col("item_id") % 2 == 0, "en-wes").otherwise("wes-en")
    source = F.when(F.col("item_id") % 4 == 0, F.col("a")).otherwise(F.concat(F.lit("src "), "text"))
    return rows.select(F.col("item_id").cast("string").alias("id"), direction.alias("direction"), source.alias("source"), F.col("text").alias("reference"), F.col(system).alias("prediction"))


PREDICTIONS_SQL = r"""bw AS (SELECT *, regexp_split_to_array(text, '\s+') AS w FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT *, array_to_string(list_filter(w, lambda x, i: i % 7 <> 0), ' ') AS a,
  CASE WHEN item_id % 5 = 0 THEN text ELSE array_to_string(list_transform(w, lambda x, i: CASE WHEN i % 2 = 1 AND i < len(w) THEN w[i + 1] WHEN i % 2 = 0 THEN w[i - 1] ELSE x END), ' ') END AS b FROM bw),
preds AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 2 = 0 THEN 'en-wes' ELSE 'wes-en' END AS direction,
  CASE WHEN item_id % 4 = 0 THEN a ELSE 'src ' || text END AS source, text AS reference, a, b FROM bs)"""


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worksheet of the benchmark's texts, filled in and approved but for some rows' people and statuses."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(
        F.concat(F.lit("b-"), F.col("item_id").cast("string")).alias("id"), F.lit("en-wes").alias("direction"), F.col("text").alias("source"), F.concat(F.lit("ref "), "text").alias("reference"),
        F.lit("").alias("reference_2"), F.lit("news").alias("domain"), F.when(F.col("item_id") % 9 == 0, "  ").otherwise("t1").alias("translator_id"),
        F.lit("r1").alias("reviewer_id"), F.when(F.col("item_id") % 4 == 0, "Approved").when(F.col("item_id") % 4 == 1, "approved").otherwise("pending").alias("adjudication_status"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a rating sheet: two reviewers, a score of 1 to 5, two flags."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    each = F.explode(F.array(F.lit(1), F.lit(2))).alias("r")
    rows = rows.select("doc_id", "lang", "quality", "toxic", each).where("r = 1 or doc_id % 3 <> 0")
    score = F.when(F.col("r") == 1, 1 + F.col("quality") * 3 + F.col("doc_id") % 2).otherwise(1 + F.col("quality") * 3 + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(F.col("doc_id") % 2))
    return rows.select("doc_id", "lang", F.concat(F.lit("r"), F.col("r").cast("string")).alias("reviewer_id"), score.cast("int").alias("adequacy"), "quality", "toxic")


RATINGS_SQL = """rated AS (SELECT l.doc_id, d.lang, l.quality, l.toxic, r.r FROM labels l JOIN documents d ON l.doc_id = d.doc_id CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2) r WHERE r.r = 1 OR l.doc_id % 3 <> 0),
ratings AS (SELECT doc_id, lang, 'r' || r AS reviewer_id, CAST(1 + quality * 3 + CASE WHEN r = 2 AND doc_id % 7 = 0 THEN 1 ELSE doc_id % 2 END AS INT) AS adequacy, quality, toxic FROM rated)"""
