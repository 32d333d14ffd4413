import hashlib
import random

import pytest

from loomtext.operators import benchmarks, curate, metrics
from loomtext.plans import config, jobs
from loomtext.plans.runtime import numbered
from loomtext.sources import io

PAIRS = "source_index long, eng string, wes string"
ROWS = [(0, ' a "quoted", b', "x\ny"), (1, "", None), (2, None, "  \\ é "), (3, "plain", "text")]


def test_tables_read_back_as_written(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, PAIRS)
    io.write_csv(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "c"), PAIRS).collect())) == ROWS
    rows.write.parquet(str(tmp_path / "p"))
    assert sorted(map(tuple, io.read_pairs(spark, str(tmp_path / "p"), "source_index").collect())) == ROWS
    numbers = [r.source_index for r in io.read_pairs(spark, str(tmp_path / "p")).collect()]
    assert len(set(numbers)) == len(ROWS)
    io.write_lines(spark.createDataFrame([("a",), ("b c",)], "value string"), str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ["a", "b c"]


def test_settings_reports_and_metadata(tmp_path):
    run = {"run_name": "r", "backend": "nllb", "base_model": "m", "dataset_id": "d", "output_dir": "o", "data": {"seed": 1}, "text": "é"}
    io.write_run_config(run, str(tmp_path / "x" / "run.yaml"))
    assert io.read_run_config(str(tmp_path / "x" / "run.yaml")) == run
    io.write_run_config({"backend": "nllb"}, str(tmp_path / "bad.yaml"))
    with pytest.raises(ValueError):
        io.read_run_config(str(tmp_path / "bad.yaml"))
    io.write_runtime_metadata(str(tmp_path / "m" / "runtime.json"), "nllb", "m", ["en-wes"], {"note": "é"})
    found = io.read_json(str(tmp_path / "m" / "runtime.json"))
    assert found["directions"] == ["en-wes"] and found["note"] == "é" and found["source_language"] == "eng_Latn"
    with pytest.raises(FileNotFoundError):
        io.read_json(str(tmp_path / "none.json"))
    assert config.CleaningConfig.of({"min_words": 3}).min_words == 3
    with pytest.warns(UserWarning, match="other"):
        config.CleaningConfig.of({"other": 1})
    with pytest.raises(TypeError):
        config.CleaningConfig.of({"detokenize": 1})


def test_digests(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc" * 1000)
    (row,) = io.file_digests(spark, str(tmp_path / "f")).collect()
    assert row.bytes == 3000 and row.sha256 == hashlib.sha256(b"abc" * 1000).hexdigest()


def test_a_split_is_read_alone(spark, tmp_path):
    rows = [(f"i{i}", f"e{i}", f"w{i}", ("train", "validation", "test")[i % 3]) for i in range(9)]
    split = spark.createDataFrame(rows, "example_id string, eng string, wes string, split string")
    io.write_public_split(split, str(tmp_path / "s"))
    read = io.read_split(spark, str(tmp_path / "s"), "test")
    assert sorted(r.id for r in read.collect()) == ["i2", "i5", "i8"]
    assert "PartitionFilters: [isnotnull(split" in read._jdf.queryExecution().toString()


def test_artifacts(spark, tmp_path):
    rows = [(i, f"hello number {i}", f"hala nomba {i}") for i in range(400)]
    split, rejected, report = jobs.curate_corpus(spark.createDataFrame(rows, PAIRS), validation_ratio=0.2, test_ratio=0.2)
    manifest = io.save_artifacts(str(tmp_path), {"rows": 400}, report, split, rejected)
    assert sum(manifest["rows_by_split"].values()) == 400 == report["accepted_rows"] and report["rejected_rows"] == 0
    assert io.read_json(str(tmp_path / "split_manifest.json")) == manifest
    pairs = sorted("\0".join(r) for r in curate.with_keys(spark.createDataFrame(rows, PAIRS)).select("eng_norm", "wes_norm").collect())
    assert manifest["fingerprint_sha256"] == hashlib.sha256("\n".join(pairs).encode()).hexdigest()


def test_every_key_pair_keeps_one_row(spark):
    rows = [(7, "a b c", "d e f"), (7, "A b c", "d e f"), (None, "a b c", "d e f"), (None, "x y", "z w"), (None, "x y", "z w"), (None, "x y", "z w"), (3, "x y z", "z w v"), (2, "x y z", "Z w v")]
    df = spark.createDataFrame(rows, PAIRS)
    kept = curate.clean_pairs(df).collect()
    assert sorted((str(r.source_index), r.eng_norm) for r in kept) == [("2", "x y z"), ("7", "a b c"), ("None", "x y")]
    assert curate.rejected_pairs(df).where("rejection_reason = 'normalized_duplicate'").count() == 5


def test_numbers_follow_one_order(spark):
    r = random.Random(2)
    values = [r.randrange(50) for _ in range(500)]
    got = numbered(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7), "v", "i").collect()
    assert [(x.v, x.i) for x in sorted(got, key=lambda x: x.place)] == sorted((v, i) for i, v in enumerate(values))
    assert sorted(x.place for x in got) == list(range(500))


def test_exact_bootstrap_replays_the_generator_in_order_of_rows(spark):
    r = random.Random(5)
    words = ["a", "b", "c", "d", "e"]
    rows = [(f"{9 - i}", "en-wes", " ".join(r.choices(words, k=6)), " ".join(r.choices(words, k=6))) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, direction string, reference string, prediction string").coalesce(1)
    got = metrics.bootstrap_interval(df, "sacrebleu", samples=20, seed=9, exact=True).first()
    rng, scores = random.Random(9), []
    for _ in range(20):
        drawn = [rows[rng.randrange(9)] for _ in range(9)]
        some = spark.createDataFrame([(f"{k}", *x[1:]) for k, x in enumerate(drawn)], df.schema).coalesce(1)
        scores.append(metrics.corpus_metrics(some, ["sacrebleu"]).first().sacrebleu)
    scores.sort()
    assert [round(x, 6) for x in (got.lower, got.upper)] == [round(scores[0], 6), round(scores[19], 6)]


def test_batches_in_order_and_by_direction(spark):
    rows = spark.createDataFrame([(i, f" t{i} ", ("en-wes", "wes-en")[i % 2]) for i in range(10)], "i int, source string, direction string").coalesce(1)
    model = lambda texts, beams, direction: [f" {t.strip()}/{len(texts)}/{beams}/{direction} " for t in texts]
    got = {r.i: r.prediction for r in benchmarks.translate(rows, model, batch_size=4, by_direction=True, beams=5).collect()}
    assert got[0] == "t0/4/5/en-wes" and got[9] == "t9/1/5/wes-en" and got[8] == "t8/1/5/en-wes"
    plain = {r.i: r.prediction for r in benchmarks.translate(rows, lambda texts: [t + str(len(texts)) for t in texts], batch_size=4).collect()}
    assert plain[0] == "t0 4" and plain[9] == "t9 2"


def test_checkpoints_of_other_directions_raise(spark):
    rows = spark.createDataFrame([("1", "wes-en", "a", "b")], "id string, direction string, source string, reference string")
    with pytest.raises(ValueError):
        jobs.evaluate(rows, directions=["en-wes"], samples=20)


def test_ordinal_agreement_against_all_pairs(spark):
    r = random.Random(3)
    rows = [(i, f"r{k}", min(5, max(1, i % 5 + 1 + r.randrange(-1, 2)))) for i in range(60) for k in range(r.choice([1, 2, 3]))]
    got = benchmarks.agreement(spark.createDataFrame(rows, "item int, who string, v int"), "item", "who", "v").first()
    items = [[v for i, _, v in rows if i == k] for k in range(60)]
    items = [x for x in items if len(x) > 1]
    every = [v for x in items for v in x]
    count = {c: every.count(c) for c in range(1, 6)}
    far = lambda a, b: (sum(count[g] for g in range(min(a, b), max(a, b) + 1)) - (count[a] + count[b]) / 2) ** 2 if a != b else 0
    inside = sum(far(a, b) / (len(x) - 1) for x in items for i, a in enumerate(x) for j, b in enumerate(x) if i != j) / len(every)
    across = sum(far(a, b) for i, a in enumerate(every) for j, b in enumerate(every) if i != j) / (len(every) * (len(every) - 1))
    assert round(got.alpha, 9) == round(1 - inside / across, 9)
