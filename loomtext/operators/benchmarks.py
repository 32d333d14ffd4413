"""Benchmark files: loading, worksheets, release checks, contamination and human ratings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.plans.config import require_columns, require_known_directions
from loomtext.plans.runtime import materialise

# Where a worksheet's text may stand, statuses, ratings, files and words of a release.
TEXT_COLUMNS = ("sentence", "text", "eng_Latn")
STATUSES = ("", "pending", "approved", "rejected")
RATINGS = ("adequacy", "fluency", "dialect_fidelity")
RELEASE_FILES = ("config.json", "generation_config.json", "runtime_config.json", "sentencepiece.bpe.model", "tokenizer_config.json")
PLACEHOLDERS = ("Pending", "REPLACE", "[HASH]", "[N]")


def completed_rows(benchmark: DataFrame) -> DataFrame:
    """Rows to evaluate: known directions, source and reference there; ``reference_1`` stands in for ``reference``."""
    if "reference" not in benchmark.columns and "reference_1" in benchmark.columns:
        benchmark = benchmark.withColumnRenamed("reference_1", "reference")
    require_columns(benchmark, ("id", "direction", "source", "reference"), "benchmark")
    require_known_directions(benchmark, what="benchmark")
    out = benchmark.dropna(subset=["source", "reference", "direction"])
    if out.isEmpty():
        raise ValueError("the benchmark has no completed rows")
    return out


def worksheet(rows: DataFrame, order: str, origin: str, limit: int | None = None, prefix: str = "bench-v1", text_column: str | None = None) -> DataFrame:
    """A sheet to translate: numbered ids in the order of ``order``, the source text and blank columns.

    Numbers need one order over all rows; a worksheet is a hand-sized table.
    """
    text_column = text_column or next((c for c in TEXT_COLUMNS if c in rows.columns), None)
    if text_column is None:
        raise ValueError(f"no text column among {rows.columns}")
    if limit:
        rows = rows.orderBy(order).limit(limit)
    number = F.row_number().over(Window.orderBy(order))
    blank = lambda name: F.lit("").alias(name)
    domain = F.col("domain").cast("string").alias("domain") if "domain" in rows.columns else blank("domain")
    return rows.select(
        F.format_string(f"{prefix}-%04d", number).alias("id"), F.lit("en-wes").alias("direction"), F.col(text_column).cast("string").alias("source"),
        blank("reference"), blank("reference_2"), domain, F.lit(origin).alias("source_origin"), *map(blank, ("translator_id", "reviewer_id", "adjudication_status", "notes")),
    )


def release_faults(sheet: DataFrame) -> DataFrame:
    """One row of counts: repeated ids, blank sources, references and people, rows not approved."""
    require_columns(sheet, ("id", "source", "reference", "translator_id", "reviewer_id", "adjudication_status"), "worksheet")
    filled = sheet.fillna("")
    blank = lambda c: T.strip(F.col(c).cast("string")) == ""
    ids = filled.groupBy("id").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("repeated_ids"))
    counts = filled.agg(
        F.count("*").alias("rows"), F.count_if(blank("source")).alias("blank_sources"), F.count_if(blank("reference")).alias("blank_references"),
        F.count_if(F.lower(F.col("adjudication_status").cast("string")) != "approved").alias("not_approved"),
        F.count_if(blank("translator_id") | blank("reviewer_id")).alias("without_people"),
    )
    return counts.join(F.broadcast(ids))


def finalized(sheet: DataFrame) -> DataFrame:
    """Both directions of an approved sheet; raises on the first fault."""
    faults = release_faults(sheet).first().asDict()
    for name in ("repeated_ids", "blank_sources", "blank_references", "not_approved", "without_people"):
        if faults[name]:
            raise ValueError(f"the worksheet has {name.replace('_', ' ')}: {faults[name]}")
    return both_directions(sheet.fillna(""))


def both_directions(sheet: DataFrame) -> DataFrame:
    """Each row in both directions, source and reference swapped in the second; one scan."""
    rest = [c for c in sheet.columns if c not in ("id", "direction", "source", "reference", "reference_2")]
    way = lambda d, s, r: F.struct(F.lit(d).alias("direction"), F.col(s).alias("source"), F.col(r).alias("reference"))
    rows = sheet.withColumn("way", F.explode(F.array(way("en-wes", "source", "reference"), way("wes-en", "reference", "source"))))
    return rows.select(F.concat(F.col("id").cast("string"), F.lit("-"), F.col("way.direction")).alias("id"), "way.direction", "way.source", "way.reference", *rest)


def direction_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("direction").agg(F.count("*").alias("rows"))


def rule_violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows): how many rows break each rule; null counts as broken."""
    counts = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("rows")) for k in rules))))


def rating_rules(ratings: Sequence[str] = RATINGS, flags: Iterable[str] = (), status: str | None = None) -> dict[str, Column]:
    """Ratings are 1 to 5, flags 0 or 1, statuses one of the known."""
    rules = {c: F.col(c).between(1, 5) for c in ratings} | {c: F.col(c).isin(0, 1) for c in flags}
    return rules | ({status: F.coalesce(F.col(status), F.lit("")).isin(*STATUSES)} if status else {})


def rating_summary(rows: DataFrame, by: Sequence[str], ratings: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Means of ratings and shares of flags by group."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *(F.avg(c).alias(f"mean_{c}") for c in ratings), *(F.avg(F.col(c).cast("double")).alias(f"share_{c}") for c in flags))


def agreement(rows: DataFrame, item: str, reviewer: str, value: str, level: str = "ordinal") -> DataFrame:
    """Krippendorff's alpha: (alpha, items, ratings, share_double).

    ``level`` interval takes squared differences of values, ordinal those of their middle ranks among
    all ratings of items that have two or more, which is the ordinal difference. Sums of values and squares by item carry the whole coincidence matrix: an item with m ratings
    holds m * sum(v^2) - sum(v)^2 squared difference over m - 1. Items with one rating do not count.
    """
    if level not in ("ordinal", "interval"):
        raise ValueError(f"unknown level: {level}")
    v = F.col(value).cast("double")
    if level == "ordinal":
        rated = rows.where(v.isNotNull())
        double = rated.groupBy(item).count().where("count > 1").select(item)
        counts = rated.join(double, item, "left_semi").groupBy(v.alias("rating")).agg(F.count("*").alias("n"))
        # A scale has a few values: few enough for one task.
        upto = F.sum("n").over(Window.orderBy("rating"))
        ranks = counts.select("rating", (upto - F.col("n") / 2).alias("rank"))
        rows = rows.withColumn("rating", v).join(F.broadcast(ranks), "rating", "left")
        v = F.when(F.col("rating").isNotNull(), F.coalesce("rank", F.lit(0.0)))
    items = rows.where(v.isNotNull()).groupBy(item).agg(F.countDistinct(reviewer).alias("m"), F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    two = F.col("n") > 1
    n, s, q = (F.sum(F.when(two, F.col(c))) for c in "nsq")
    inside = F.sum(F.when(two, 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / F.greatest(F.col("n") - 1, F.lit(1))))
    sums = items.agg(F.count("*").alias("all"), F.count_if(two).alias("items"), n.alias("n"), s.alias("s"), q.alias("q"), inside.alias("inside"))
    observed = F.col("inside") / F.col("n")
    expected = 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * F.greatest(F.col("n") - 1, F.lit(1)))
    alpha = F.when(expected > 0, 1 - observed / F.when(expected > 0, expected)).when(F.col("items") > 0, 1.0)
    return sums.select(alpha.alias("alpha"), "items", F.coalesce("n", F.lit(0)).alias("ratings"), F.when(F.col("all") > 0, F.col("items") / F.greatest("all", F.lit(1))).alias("share_double"))


def contamination_exact(train: DataFrame, benchmark: DataFrame, train_text: str = "text", bench_text: str = "text") -> DataFrame:
    """(rows, normalized): training rows equal to a benchmark text, as they are and by key; counts even where 0."""
    key = lambda df, c: T.with_key(df.select(F.col(c).alias("t")), k="t")
    left, right = key(train.where(F.col(train_text).isNotNull()), train_text), key(benchmark.where(F.col(bench_text).isNotNull()), bench_text)
    raw = left.join(right.select("t").distinct(), "t", "left_semi").agg(F.count("*").alias("exact_rows"))
    folded = left.join(right.select("k").distinct(), "k", "left_semi").agg(F.count("*").alias("normalized_rows"))
    return raw.join(F.broadcast(folded))


def contamination_contains(train: DataFrame, benchmark: DataFrame, train_id: str = "doc_id", train_text: str = "text", item_id: str = "item_id", bench_text: str = "text", words: int = 8) -> DataFrame:
    """(train id, item id): training texts that contain a benchmark text's key as whole words.

    An equi-join on a hash of each item's first ``words`` words with all windows of so many words
    of the training texts finds candidates, which are then checked; items of fewer words join on
    windows of their own length. No pair is compared that shares no window.
    """
    items = T.with_key(benchmark.select(F.col(item_id).alias("item"), F.col(bench_text).alias("t")), item_key="t").where("item_key <> ''")
    items = items.withColumn("w", F.split("item_key", " ")).withColumn("len", F.least(F.size("w"), F.lit(words)))
    items = items.select("item", "item_key", "len", F.xxhash64(F.array_join(F.expr("slice(w, 1, len)"), " ")).alias("h"))
    items = materialise(items, "contains-items")  # its size is known then, so that few items are broadcast and windows not shuffled
    lengths = [r[0] for r in items.select("len").distinct().collect()]  # at most ``words`` numbers
    keys = T.with_key(train.select(F.col(train_id).alias("train"), F.col(train_text).alias("t")), text_key="t")
    keys = materialise(keys.where("text_key <> ''").select("train", "text_key"), "contains-keys")
    texts = keys.select("train", F.split("text_key", " ").alias("w"))
    # Windows carry ids alone: a text beside each of its windows would be the square of its length.
    found = None
    for n in sorted(lengths):
        grams = F.expr(f"transform(sequence(1, size(w) - {n} + 1), i -> xxhash64(array_join(slice(w, i, {n}), ' ')))")
        windows = texts.where(F.size("w") >= n).select("train", F.explode(F.array_distinct(grams)).alias("h"))
        part = windows.join(items.where(F.col("len") == n).select("item", "item_key", "h"), "h").select("train", "item", "item_key")
        found = part if found is None else found.unionByName(part)
    if found is None:
        out = keys.select("train", F.lit(None).cast("long").alias("item")).limit(0)
    else:
        found = found.distinct().withColumnRenamed("train", "at")
        spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
        out = keys.join(found, F.col("train").eqNullSafe(F.col("at"))).where(F.contains(spaced("text_key"), spaced("item_key"))).select("train", "item")
    return out.distinct().withColumnsRenamed({"train": train_id, "item": item_id})


def release_check(files: DataFrame, card: str | None) -> dict[str, list[str]]:
    """Faults of a release from its ``files`` (name) and the text of its card: missing names, placeholders left."""
    spark = files.sparkSession
    wanted = spark.createDataFrame([(n,) for n in RELEASE_FILES], "name string")
    missing = [r[0] for r in wanted.join(files.select("name"), "name", "left_anti").orderBy("name").collect()]
    if files.where(F.col("name").endswith(".safetensors")).isEmpty():
        missing.append("*.safetensors")
    return {"missing": missing, "placeholders": ["card"] if card is None else [w for w in PLACEHOLDERS if w in card]}


def translate(rows: DataFrame, model: Callable[..., list[str]] | None = None, text_col: str = "source", out_col: str = "prediction", batch_size: int = 16, by_direction: bool = False, **generation) -> DataFrame:
    """``rows`` with a model's stripped output: batches of ``batch_size`` texts in order; without a model, a copy.

    ``generation`` (beams, lengths and the like) goes to each call. With ``by_direction`` a batch
    holds texts of one direction, which the call gets as ``direction``. Null texts are empty.
    """
    if model is None:
        return rows.withColumn(out_col, T.strip(text_col))
    schema = rows.withColumn(out_col, F.lit("")).schema

    def run(frames):
        for frame in frames:
            texts = ["" if t is None else str(t) for t in frame[text_col]]
            ways = frame["direction"].tolist() if by_direction else [None] * len(texts)
            out: list[str] = [""] * len(texts)
            for way in dict.fromkeys(ways):
                places = [i for i, x in enumerate(ways) if x == way]
                for at in range(0, len(places), batch_size):
                    some = places[at : at + batch_size]
                    found = model([texts[i] for i in some], **generation, **({"direction": way} if by_direction else {}))
                    for i, x in zip(some, found, strict=True):
                        out[i] = x.strip()
            yield frame.assign(**{out_col: out})

    return rows.mapInPandas(run, schema)
