"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.columns import fields, numbered, place_of
from loomtext.plans.runtime import materialise

WORDS = r"[^\\x20\\x09-\\x0D]+"
WEIGHTS, CAP, SEED = (1, 2, 3), 3, 42
#: A rank's scale is cut in BUCKETS parts, and the part where the target is met in as many again.
BUCKETS = 4096


def _crossing(rows: DataFrame, bucket: str, before: Column) -> DataFrame:
    """(key, at, ahead): the bucket in which a source's words reach ``rest``, and the words before it."""
    sums = rows.groupBy("key", bucket).agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max(before).alias("base"))
    order = Window.partitionBy("key").orderBy(bucket)
    cum = sums.withColumn("upto", F.col("base") + F.sum("words").over(order)).withColumn("ahead", F.col("upto") - F.col("words"))
    return cum.where("ahead < rest and upto >= rest").select("key", F.col(bucket).alias("at"), "ahead")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: one row a source, few enough for one task.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; no
    target is above ``cap`` times its source's size, and the excess goes to the others by weight.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    whole = Window.partitionBy()
    # The level is the highest that any set of capped sources gives; sets are prefixes by size to weight.
    before = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
    w = w.withColumn("share", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    level = F.max(F.col("left") / F.col("share")).over(whole)
    return w.withColumn("target", F.least(F.col("source_size") * F.lit(float(cap)), level * F.col("w"))).select("source", "source_size", "target")


def _random(doc_id: str, text: str, seed: int) -> Column:
    """32 hex digits that hang on seed, id and text alone."""
    whole = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), whole))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, h) of every row of ``docs``.

    Every document gets the whole copies that its source's target has room for. The rest of the
    target is met by one further copy of a Pareto sample: inclusion odds come from probabilities
    that grow with the square root of a document's words, 1 at most and scaled to the rest; the
    documents with the smallest random odds over inclusion odds are taken until their words come
    nearest to the rest. Random numbers are MD5 of seed, id and text, so reruns agree. Null text
    has size 0, null sources are one source, ids may repeat or be null, an empty table gives none.
    """
    sized = fields(docs, id_col, text_col, source_col)
    sized = sized.select(F.col("f0").alias("doc_id"), F.col("f2").alias("source"), F.expr(f"cast(coalesce(regexp_count(cast(f1 as string), '{WORDS}'), 0) as bigint)").alias("size"), _random("f0", "f1", seed).alias("h"))
    sized = materialise(sized.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mix-sizes")
    sources = source_targets(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")).drop("key"), weights, cap)
    sources = sources.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = materialise(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")
    # The scale of the probabilities: the largest that any set of certain documents gives; sets are prefixes by size.
    counts = sized.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")).join(sources.select("key", "rest"), "key")
    larger = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("size")
    mass = F.sum(F.col("n") * F.floor(F.col("size") * F.sqrt("size") * 1024).cast("long")).over(upto) / 1024.0
    scale = counts.select("key", ((F.col("rest") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger), F.lit(0))) / mass).alias("scale"))
    sources = materialise(sources.join(scale.groupBy("key").agg(F.max("scale").alias("scale")), "key", "left"), "mix-scale")

    u = (F.conv(F.substring("h", 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    p = F.least(F.lit(1.0), F.col("scale") * F.sqrt("size"))
    ranked = sized.join(sources, "key").withColumn("u", u).withColumn("p", p)
    drawn = (F.col("size") > 0) & (F.col("rest") > 0)
    q = F.when(drawn, F.col("u") * (1 - F.col("p")) / ((1 - F.col("u")) * F.col("p")))
    ranked = ranked.withColumn("q", q).withColumn("t", F.col("q") / (1 + F.col("q")) * BUCKETS)
    ranked = ranked.withColumn("b1", F.least(F.floor("t"), F.lit(BUCKETS - 1))).withColumn("b2", F.floor((F.col("t") - F.col("b1")) * BUCKETS))
    ranked = materialise(ranked.drop("u", "p", "t", "scale"), "mix-ranked")
    one = materialise(_crossing(ranked.where("q is not null"), "b1", F.lit(0)).withColumnRenamed("at", "c1").withColumnRenamed("ahead", "a1"), "mix-one")
    inside = ranked.where("q is not null").join(one, "key").where("b1 = c1")
    two = materialise(_crossing(inside, "b2", F.col("a1")).withColumnRenamed("at", "c2").withColumnRenamed("ahead", "a2"), "mix-two")
    placed = ranked.join(one, "key", "left").join(two, "key", "left")
    last = "b1 = c1 and b2 = c2"
    order = Window.partitionBy("key").orderBy("q", "doc_id", "h")
    edge = placed.where(last).withColumn("upto", F.col("a2") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("more", F.expr("upto <= rest or (upto - size < rest and upto - rest < rest - (upto - size))"))
    plain = placed.where(f"not coalesce({last}, false)").withColumn("upto", F.lit(0).cast("long"))
    plain = plain.withColumn("more", F.expr("q is not null and (c1 is null or b1 < c1 or (b1 = c1 and (c2 is null or b2 < c2)))"))
    copies = F.col("whole") + F.col("more").cast("long")
    out = plain.unionByName(edge.select(*plain.columns)).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "h")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows that repeat id and text get the same number.

    Texts without words are never taken. Null sources are one source, null ids and repeated rows
    count each, columns keep their names whatever they are, and an empty table gives an empty one.
    """
    mixed = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    number = mixed.groupBy("h").agg(F.max("copies").alias("copies")).where("copies > 0")
    plain = numbered(docs)
    h = _random(f"c{place_of(docs, id_col)}", f"c{place_of(docs, text_col)}", seed)
    joined = plain.withColumn("h", h).join(number, "h")
    taken = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*plain.columns).toDF(*docs.columns)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [1, 2, 3][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM w),
t AS (SELECT source, source_size, least(3.0 * source_size, max(level) OVER () * w)::DOUBLE AS target FROM l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM k),
c AS (SELECT z.source, z.size, count(*) AS n, any_value(r.rest) AS rest FROM sized z JOIN r ON z.source IS NOT DISTINCT FROM r.source WHERE z.size > 0 GROUP BY z.source, z.size),
g AS (SELECT source, (rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(n * CAST(floor(size * sqrt(size) * 1024) AS BIGINT)) OVER (PARTITION BY source ORDER BY size) / 1024.0::DOUBLE) AS scale FROM c),
m AS (SELECT source, max(scale) AS scale FROM g GROUP BY source),
u AS (SELECT z.*, r.source_size, r.target, r.whole, r.rest, (CAST(('0x' || z.h[1:13]) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u, least(1.0::DOUBLE, m.scale * sqrt(z.size)) AS p
      FROM sized z JOIN r ON z.source IS NOT DISTINCT FROM r.source LEFT JOIN m ON z.source IS NOT DISTINCT FROM m.source),
q AS (SELECT *, u * (1 - p) / ((1 - u) * p) AS q FROM u WHERE size > 0 AND rest > 0),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, h ROWS UNBOUNDED PRECEDING) AS upto FROM q),
e AS (SELECT doc_id, h, (upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size))) AS more FROM o)
SELECT u.doc_id, u.size, u.source_size, u.target, CAST(u.size * (u.whole + CASE WHEN e.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM u LEFT JOIN e ON u.doc_id IS NOT DISTINCT FROM e.doc_id AND u.h = e.h
"""
