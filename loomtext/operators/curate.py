"""Audit, cleaning with a trail of rejected rows, deduplication, fingerprints and leakage-free splits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators.components import connected_components
from loomtext.plans.config import CleaningConfig, require_columns
from loomtext.plans.runtime import fresh_path, materialise, numbered, parquet_batches

REASONS = ("empty", "ratio_too_high", "ratio_too_low", "too_long", "too_short")


def _filled(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("eng", "wes")})


def with_keys(pairs: DataFrame) -> DataFrame:
    """``pairs`` with eng_norm and wes_norm where they are missing."""
    need = {f"{c}_norm": c for c in ("eng", "wes") if f"{c}_norm" not in pairs.columns}
    return T.with_key(pairs, **need) if need else pairs


def audit_rows(pairs: DataFrame) -> DataFrame:
    """Per-row facts that the audits aggregate; null texts count as empty after the null counts."""
    require_columns(pairs, ("eng", "wes"), "dataset")
    rows = pairs.select("eng", "wes", F.col("eng").isNull().alias("null_eng"), F.col("wes").isNull().alias("null_wes"))
    rows = with_keys(_filled(rows))
    rows = rows.withColumns({"eng_words": F.greatest(T.word_count("eng"), F.lit(1)), "wes_words": F.greatest(T.word_count("wes"), F.lit(1))})
    return rows.withColumn("ratio", F.col("wes_words") / F.col("eng_words"))


def audit_counts(pairs: DataFrame) -> DataFrame:
    """One row of counts over all pairs."""
    rows = audit_rows(pairs)
    flags = {
        "null_eng": F.col("null_eng"), "null_wes": F.col("null_wes"), "blank_eng": T.strip("eng") == "", "blank_wes": T.strip("wes") == "",
        "word_ratio_below_0_4": F.col("ratio") < 0.4, "word_ratio_above_2_5": F.col("ratio") > 2.5, "religious_marker_rows": T.domain_marker("eng"),
        "english_space_before_punctuation_rows": T.spaced_punctuation("eng"),
        "target_only_leading_parenthetical_rows": ~T.leading_parenthesis("eng") & T.leading_parenthesis("wes"),
    }
    # Five aggregates read the keys, so they are made once.
    rows = materialise(rows.select("eng", "wes", "eng_norm", "wes_norm", *(c.alias(k) for k, c in flags.items())), "audit")
    plain = rows.agg(F.count("*").alias("rows"), *(F.count_if(k).alias(k) for k in flags))

    # Distinct counts as grouped counts: each is a partial aggregate on its own key.
    def copies(name: str, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias(name))

    parts = (
        copies("exact_duplicate_pairs", "eng", "wes"),
        copies("normalized_duplicate_pairs", "eng_norm", "wes_norm"),
        copies("duplicate_english_rows", "eng_norm"),
        copies("duplicate_wes_rows", "wes_norm"),
    )
    for part in parts:  # one row each
        plain = plain.join(F.broadcast(part))
    return plain


def audit_summary(pairs: DataFrame) -> DataFrame:
    """Mean, exact percentiles and maximum of words and ratio: one row a measure."""
    rows = audit_rows(pairs)
    parts = []
    for name, c in (("english_word_counts", "eng_words"), ("wes_word_counts", "wes_words"), ("wes_to_english_word_ratio", "ratio")):
        x = F.col(c).cast("double")
        p = F.percentile(x, F.array(*map(F.lit, (0.01, 0.5, 0.95, 0.99))))
        parts.append(F.struct(F.lit(name).alias("measure"), F.avg(x).alias("mean"), *(p[i].alias(k) for i, k in enumerate(("p01", "p50", "p95", "p99"))), F.max(x).alias("max")))
    return rows.agg(*(p.alias(f"s{i}") for i, p in enumerate(parts))).select(F.inline(F.array("s0", "s1", "s2")))


def conflict_groups(pairs: DataFrame) -> DataFrame:
    """(side, groups): keys with more than one distinct counterpart."""
    rows = audit_rows(pairs).select("eng_norm", "wes_norm").distinct()
    out = None
    for side in ("eng", "wes"):
        part = rows.groupBy(f"{side}_norm").count().agg(F.count_if(F.col("count") > 1).alias("groups")).select(F.lit(side).alias("side"), "groups")
        out = part if out is None else out.unionByName(part)
    return out


def _sha_stream(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the sorted runs of a folder, one after another."""
    for _ in batches:
        digest, first = hashlib.sha256(), True
        for batch in parquet_batches(folder, ["pair"]):
            for s in batch.column(0).to_pylist():
                digest.update(s.encode("utf-8") if first else b"\n" + s.encode("utf-8"))
                first = False
        yield pa.RecordBatch.from_pydict({"fingerprint_sha256": [digest.hexdigest()]})


def fingerprint(pairs: DataFrame) -> DataFrame:
    """SHA-256 of all key pairs in order, whatever the order of rows.

    The pairs are sorted in parallel and written as runs; a hash is a chain, so one task reads these
    one after another, sorts nothing and holds no more than a batch. A null text counts as the word
    ``none``.
    """
    filled = pairs.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("eng", "wes")})
    rows = with_keys(filled.select("eng", "wes")).select(F.concat("eng_norm", F.char(F.lit(0)), "wes_norm").alias("pair"))
    folder = fresh_path(pairs.sparkSession, "sorted-pairs")
    rows.orderBy("pair").write.parquet(folder)
    return pairs.sparkSession.range(1, numPartitions=1).mapInArrow(lambda it: _sha_stream(folder, it), "fingerprint_sha256 string")


def corpus_digest(pairs: DataFrame) -> DataFrame:
    """An order-free digest that combines in any grouping, for corpora too large for one hash chain: (rows, xor, sum of low halves)."""
    h = F.xxhash64("eng_norm", "wes_norm")
    return with_keys(_filled(pairs)).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low_sum"))


def judged_pairs(pairs: DataFrame, config: Mapping[str, Any] | CleaningConfig | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Every pair cleaned, with its keys, words, ratio, ``reasons``, ``rejection_reason`` (null if it is fine) and the columns of ``keep``."""
    config = CleaningConfig.of(config)
    require_columns(pairs, ("source_index", "eng", "wes"), "dataset")
    rows = _filled(pairs.select("source_index", "eng", "wes", *keep)).withColumnsRenamed({"eng": "eng_raw", "wes": "wes_raw"})

    def cleaned(c: str) -> Column:
        x = T.detokenize(c) if config.detokenize else T.strip(c)
        return T.strip_citations(x) if config.strip_reference_noise else x

    rows = rows.withColumns({c: T.carried(cleaned(f"{c}_raw")) for c in ("eng", "wes")})
    rows = rows.withColumns({f"{c}_norm": T.fold_key(T.attach(F.col(f"{c}.nfkc"))) for c in ("eng", "wes")})
    rows = rows.withColumns({c: F.col(f"{c}.text") for c in ("eng", "wes")})
    rows = rows.withColumns({"eng_words": T.word_count("eng"), "wes_words": T.word_count("wes")})
    ratio = F.col("wes_words") / F.greatest("eng_words", F.lit(1))
    fails = {
        "empty": (F.col("eng") == "") | (F.col("wes") == ""),
        "ratio_too_high": ratio > config.max_word_ratio,
        "ratio_too_low": ratio < config.min_word_ratio,
        "too_long": F.greatest("eng_words", "wes_words") > config.max_words,
        "too_short": F.least("eng_words", "wes_words") < config.min_words,
    }  # in order of name, as labels are
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in fails.items())))
    rows = rows.withColumns({"word_ratio": F.round(ratio, 6), "reasons": reasons})
    return rows.withColumn("rejection_reason", F.when(F.size("reasons") > 0, F.array_join("reasons", ",")))


def _ranked(pairs: DataFrame, config: Mapping[str, Any] | CleaningConfig | None) -> DataFrame:
    """Judged pairs in which later copies of an accepted key pair are marked too.

    One row of each key pair stays: that of the smallest source_index, null ones last; of rows that
    repeat it, the first read.
    """
    rows = materialise(judged_pairs(pairs, config).withColumn("row", F.monotonically_increasing_id()), "judged")
    fine = F.col("rejection_reason").isNull()
    # The first accepted row of each key pair, by a partial minimum: a hot pair is no window's partition.
    keyed = rows.where(fine).select("eng_norm", "wes_norm", F.struct(F.col("source_index").isNull().alias("late"), "source_index", "row").alias("at"))
    first = keyed.groupBy("eng_norm", "wes_norm").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Whole rows meet the later copies' numbers alone.
    later = keyed.join(first, ["eng_norm", "wes_norm"]).where("at.row <> first.row").select("at.row", F.lit(True).alias("later"))
    joined = rows.join(materialise(later, "later-copies"), "row", "left")
    reason = F.when(F.col("later"), "normalized_duplicate").otherwise(F.col("rejection_reason"))
    return joined.withColumn("rejection_reason", reason).drop("row", "later")


def clean_pairs(pairs: DataFrame, config: Mapping[str, Any] | CleaningConfig | None = None) -> DataFrame:
    """Accepted pairs, the first of each key pair, with example_id and the domain flag."""
    rows = _ranked(pairs, config).where("rejection_reason is null").drop("reasons", "rejection_reason")
    return rows.withColumns({"example_id": T.example_id("eng_norm", "wes_norm"), "religious_domain_marker": T.domain_marker("eng")})


def rejected_pairs(pairs: DataFrame, config: Mapping[str, Any] | CleaningConfig | None = None) -> DataFrame:
    """Rejected pairs with the reason: rules broken, in order of name, or ``normalized_duplicate``."""
    return _ranked(pairs, config).where("rejection_reason is not null").drop("reasons")


def rejection_counts(pairs: DataFrame, config: Mapping[str, Any] | CleaningConfig | None = None) -> DataFrame:
    return rejected_pairs(pairs, config).groupBy("rejection_reason").agg(F.count("*").alias("rows")).orderBy("rejection_reason")


def reason_counts(pairs: DataFrame, config: Mapping[str, Any] | CleaningConfig | None = None) -> DataFrame:
    """Rows that break each single rule, other rules aside."""
    return judged_pairs(pairs, config).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def valid_pairs(pairs: DataFrame, config: Mapping[str, Any] | CleaningConfig | None = None) -> DataFrame:
    """The variant without a trail: one predicate, then the first of each key pair."""
    return clean_pairs(pairs, config).select("source_index", "eng", "wes")


def pair_components(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``component``: the smallest source_index linked through equal keys of either side.

    Each row links to its key's first row, so a key of n rows gives n links. Keys of one side never
    meet the other's; an empty key links like any other.
    """
    rows = with_keys(pairs)
    edges = None
    for side in ("eng_norm", "wes_norm"):
        first = rows.groupBy(side).agg(F.min("source_index").alias("u"))
        part = rows.select(side, F.col("source_index").alias("v")).join(first, side).select("u", "v").where("u <> v")
        edges = part if edges is None else edges.unionByName(part)
    found = connected_components(edges).withColumnRenamed("node", "source_index")
    return rows.join(found, "source_index", "left").withColumn("component", F.coalesce("component", "source_index"))


def _group_scores(seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of seed and sorted ids of each component, rows coming sorted by both; holds one hash at a time."""
    component, digest, done = None, None, []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done])], ["component", "digest"])

    for batch in batches:
        for c, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest is None or c != component:
                if digest is not None:
                    done.append((component, digest.hexdigest()))
                component, digest = c, hashlib.sha256(f"{seed}:{e}".encode())
            else:
                digest.update(f"|{e}".encode())
        if len(done) > 10_000:
            yield flush()
            done.clear()
    if digest is not None:
        done.append((component, digest.hexdigest()))
    if done:
        yield flush()


def split_pairs(clean: DataFrame, validation_ratio: float = 0.05, test_ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """``clean`` with group_id and split; rows that share a key on either side are in one group and split.

    A group's split is a hash of the seed and its sorted example ids, so the order of rows has no
    part in it. group_id names the group by its smallest source_index.
    """
    if validation_ratio <= 0 or test_ratio <= 0 or validation_ratio + test_ratio >= 1:
        raise ValueError("validation_ratio and test_ratio are above 0 and their sum below 1")
    rows = pair_components(clean)
    if "example_id" not in rows.columns:
        rows = rows.withColumn("example_id", T.example_id("eng_norm", "wes_norm"))
    rows = materialise(rows, "components")
    ids = rows.select("component", "example_id").repartition("component").sortWithinPartitions("component", "example_id")
    digests = ids.mapInArrow(lambda it: _group_scores(seed, it), "component long, digest string")
    score = F.conv(F.substring("digest", 1, 16), 16, 10).cast("double") / F.lit(float(2**64 - 1))
    groups = digests.select("component", T.split_name(score, validation_ratio, test_ratio).alias("split"))
    out = rows.join(groups, "component")
    return out.withColumn("group_id", F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("component").cast("string")), 256), 1, 12)).drop("component")


def split_manifest(split: DataFrame) -> DataFrame:
    """(split, rows, groups), counted in two steps so that a hot split is pre-aggregated by group."""
    return split.groupBy("split", "group_id").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("rows"), F.count("*").alias("groups"))


def split_leaks(split: DataFrame) -> DataFrame:
    """(side, key, splits): keys that stand in more than one split; none if the split is sound."""
    out = None
    for side in ("eng_norm", "wes_norm"):
        part = split.where(F.col(side).isNotNull()).groupBy(F.col(side).alias("key")).agg(F.countDistinct("split").alias("splits")).where("splits > 1").withColumn("side", F.lit(side))
        out = part if out is None else out.unionByName(part)
    return out


def verify_split(split: DataFrame) -> None:
    """Raises unless all three splits hold rows and no key stands in two."""
    present = {r[0] for r in split.select("split").distinct().collect()}
    if present != {"train", "validation", "test"}:
        raise RuntimeError(f"splits that hold rows: {sorted(present)}")
    if leaks := split_leaks(split).limit(5).collect():
        raise AssertionError(f"keys stand in several splits, such as {leaks}")


def quick_subset(split: DataFrame, train: int = 2000, others: int = 300, seed: int = 42) -> DataFrame:
    """A small run's rows: a hash sample of the train split, the first rows of the others."""
    rows = split.where("split = 'train'").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "example_id")), "example_id").limit(train)
    for name in ("validation", "test"):
        rows = rows.unionByName(split.where(F.col("split") == name).orderBy("source_index").limit(others))
    return rows


def _random_order(seed: int, key: str) -> tuple[Column, str]:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256), key


def shuffled(rows: DataFrame, seed: int = 42, key: str = "example_id") -> DataFrame:
    """Rows in a fixed random order of their ids."""
    return rows.orderBy(*_random_order(seed, key))


def shuffled_places(rows: DataFrame, seed: int = 42, key: str = "example_id") -> DataFrame:
    """``rows`` with ``place``: their number in that order, from 1."""
    return numbered(rows, *_random_order(seed, key)).withColumn("place", F.col("place") + 1)


def public_split(split: DataFrame) -> DataFrame:
    """Rows to publish: id, the pair as a struct and its texts, by split."""
    return split.select(F.col("example_id").alias("id"), F.struct("eng", "wes").alias("translation"), "eng", "wes", "split")
