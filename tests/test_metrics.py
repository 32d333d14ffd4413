import pytest

from loomtext.functions.mt_stats import ter_stats, tokens_13a
from loomtext.operators import metrics
from loomtext.operators.benchmarks import agreement, finalized, release_check
from loomtext.operators.vocabulary import formatted, padded, shifted_right
from pyspark.sql import functions as F

REFS = ["the cat sat on the mat today", "a dog ran over the hill", "no one knows what time it is"]


def rows(spark, predictions, references=REFS):
    return spark.createDataFrame([(str(i), "en-wes", r, p, r) for i, (p, r) in enumerate(zip(predictions, references, strict=True))], "id string, direction string, source string, prediction string, reference string")


def test_identity(spark):
    r = metrics.corpus_metrics(rows(spark, REFS)).first()
    assert [round(r[k], 4) for k in ("sacrebleu", "chrf_plus_plus", "ter", "exact_match_percent", "source_copy_percent")] == [100, 100, 0, 100, 100]


def test_hand_cases():
    assert tokens_13a("Hello, world! 3.5 it's") == ["Hello", ",", "world", "!", "3.5", "it's"]
    assert ter_stats("b c d a", "a b c d") == [1, 4] and ter_stats("", "a b") == [2, 2] and ter_stats("a x", "a b") == [1, 2]


def test_bootstrap_repeats_and_pairs(spark):
    weak = ["the cat", "dog ran over a hill", "no one knows"]
    one = [metrics.bootstrap_interval(rows(spark, weak), samples=20, seed=9, exact=True).first() for _ in range(2)]
    assert one[0] == one[1] and one[0].lower <= one[0].upper
    r = metrics.paired_bootstrap(rows(spark, REFS), rows(spark, weak), samples=20, seed=3, exact=True).first()
    assert r.difference_a_minus_b > 0 and r.lower >= 0


def test_misaligned(spark):
    a = rows(spark, REFS)
    with pytest.raises(ValueError):
        metrics.aligned_systems(a, a.where("id <> '1'"))
    with pytest.raises(ValueError):
        metrics.aligned_systems(a, a.withColumn("reference", F.lit("other")))
    with pytest.raises(ValueError):
        metrics.bootstrap_interval(a, samples=5)


def test_formatting_and_arrays(spark):
    df = spark.createDataFrame([("hi", [5, -100, 7])], "t string, ids array<int>")
    r = df.select(formatted(F.col("t"), "marian", "en-wes").alias("m"), shifted_right(F.col("ids"), 2, 1).alias("s"), padded(F.col("ids"), 0).alias("p")).first()
    assert (r.m, r.s, r.p) == (">>wes<< hi", [2, 5, 1], [5, -100, 7, 0, 0, 0, 0, 0])
    with pytest.raises(ValueError):
        formatted(F.col("t"), "other", "en-wes")


def test_agreement_and_gates(spark):
    same = spark.createDataFrame([(1, "a", 3), (1, "b", 3), (2, "a", 5), (2, "b", 5), (3, "a", 1)], "item int, who string, v int")
    assert agreement(same, "item", "who", "v").first().alpha == 1.0
    sheet = spark.createDataFrame([("1", "s", "r", "t", "v", "Approved")], "id string, source string, reference string, translator_id string, reviewer_id string, adjudication_status string")
    assert sorted(r.id for r in finalized(sheet).collect()) == ["1-en-wes", "1-wes-en"]
    with pytest.raises(ValueError):
        finalized(sheet.withColumn("reviewer_id", F.lit(" ")))
    assert release_check(spark.createDataFrame([("config.json",)], "name string"), "Pending")["placeholders"] == ["Pending"]
