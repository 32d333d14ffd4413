import pytest
from pyspark.sql import functions as F

from loomtext.operators import components, curate
from loomtext.operators.components import connected_components
from loomtext.plans.jobs import audit_report, curate_corpus
from loomtext.plans.runtime import checkpoint


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "source_index long, eng string, wes string")


def motif(spark):
    rows = []
    for i in range(160):
        k = i // 4
        rows.append([(f"source {k} one", f"target {k} one"), (f"source {k} one", f"target {k} two"), (f"source {k} two", f"target {k} two"), (f"source {k} three", f"target {k} three")][i % 4])
    return frame(spark, rows)


def test_cleaner_keeps_a_trail(spark):
    rows = frame(spark, [("Hello there .", "How you dey"), ("hello there", "how you dey"), (None, "x y"), ("one two three", "a b c"), ("one two", "a b c d e f g")])
    clean, bad = curate.clean_pairs(rows), curate.rejected_pairs(rows)
    assert sorted(r.source_index for r in clean.collect()) == [0, 3]
    assert {r.source_index: r.rejection_reason for r in bad.collect()} == {1: "normalized_duplicate", 2: "empty,too_short", 4: "ratio_too_high"}
    assert clean.where("source_index = 0").first().eng_norm == "hello there"


def test_split_leaks_nothing_and_ignores_order(spark):
    rows = motif(spark)
    split, rejected, report = curate_corpus(rows, seed=17, validation_ratio=0.2, test_ratio=0.2)
    assert report["accepted_rows"] == 160 and curate.split_leaks(split).isEmpty()
    again = curate.split_pairs(curate.clean_pairs(rows.orderBy(F.desc("source_index"))), 0.2, 0.2, 17)
    key = lambda df: sorted((r.source_index, r.split) for r in df.collect())
    assert key(split) == key(again)


def test_split_guards(spark):
    with pytest.raises(ValueError):
        curate.split_pairs(motif(spark), 0.6, 0.5)
    with pytest.raises(ValueError):
        curate.judged_pairs(spark.range(1))


def test_audit(spark):
    report = audit_report(frame(spark, [("a b", "c d"), ("A b!", "c d"), (None, " "), ("a b", "x")]))
    assert (report["rows"], report["null_eng"], report["blank_wes"], report["normalized_duplicate_pairs"]) == (4, 1, 1, 1)
    assert report["english_conflicting_target_groups"] == 1 and len(report["fingerprint_sha256"]) == 64


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, k) for k in range(1001, 1100)] + [(None, 3), (7, 7), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(51)} | {k: 1000 for k in range(1000, 1100)} | {2000: 2000, 2001: 2000}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_take_few_rounds_on_long_chains(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "checkpoint", lambda df: rounds.append(1) or checkpoint(df))
    n = 400
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")).collect()}
    assert got == dict.fromkeys(range(n + 1), 0)
    assert len(rounds) <= 20
