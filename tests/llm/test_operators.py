import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import decontaminate, langid, license, mixing, pii, quality, sstable, topk, warc
from loomtext.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, score double"
ODD = [(1, None), (1, ""), (None, "x y"), (5, "one  two   three \n four"), (5, "one  two   three \n four"), (9, "<|endoftext|> a\n <|endoftext|>"), (-3, "word " * 40_000)]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(d, t, "en", None if i % 3 == 0 else f"s{i % 3}", 0.0) for i, (d, t) in enumerate(rows)], DOCS)


def test_warc_round_trip_and_roles(spark):
    rows = [(3, "u", "same"), (1, "v", "same"), (1, "w", "same"), (2, None, None), (None, "x\r\ny", "é<b>"), (8, "z", "")]
    got = warc.archived(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int")).collect()
    assert len(got) == len(rows)
    roles = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got if r.payload_bytes == 4 and r.page_id)
    assert roles == [("1", "response", "None"), ("1", "revisit", "1"), ("3", "revisit", "1")]
    assert {r.page_id: (r.record_type, r.refers_to) for r in got if r.payload_bytes == 0} == {2: ("response", None), 8: ("revisit", 2)}
    assert {r.payload_digest for r in got if r.payload_bytes == 0} == {warc.payload_digest(b"")}
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_warc_reader_rejects_damage():
    r = random.Random(0)
    records = [warc.make_record(i, "http://a/", (" ".join(r.choices(["alpha", "beta", "gamma", str(i)], k=200))).encode(), None, False, "") for i in range(60)]
    out = io.BytesIO()
    dictionary = warc.train_dictionary(records)
    writer = warc.ArchiveWriter(out, dictionary)
    for x in records:
        writer.add(x)
    data = out.getvalue()
    assert dictionary and data[:4] == b"\x5d\x2a\x4d\x18"
    assert [x.headers["x-page-id"] for x in warc.read_archive(io.BytesIO(data))] == [str(i) for i in range(60)]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-5])))
    for spoil in (records[0].replace(b"Content-Length: ", b"Content-Length: 9", 1), records[0] + b"x", records[0].replace(b"alpha", b"alphb", 1)):
        with pytest.raises(ValueError):
            warc.parse_record(spoil)


def test_shards_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    got = sstable.token_shards(docs(spark), tokenizer_path()).orderBy("start").collect()
    want = []
    for d, t in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted([d for d, _ in ODD], key=lambda x: (x is not None, x or 0))


def test_shard_lookup(tmp_path):
    path = str(tmp_path / "a.sst")
    with open(path, "wb") as f:
        w = sstable.ShardWriter(f, 2, block=500)
        for i in range(0, 2000, 2):
            w.add(sstable.key_of(i), np.arange(i % 7, dtype="<u2").tobytes())
        w.close()
    shard = sstable.Shard(path)
    assert shard.docs == 1000 and len(shard.blocks) > 5
    assert all(len(shard.get(sstable.key_of(i))) == i % 7 for i in range(0, 2000, 2))
    assert all(shard.get(sstable.key_of(i)) is None for i in range(-5, 2010, 2) if i % 2)


def test_mix_is_near_targets_and_repeats(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randrange(1, 80)) for i in range(600)] + ODD
    out = [mixing.mix_sources(docs(spark, rows)).collect() for _ in range(2)]
    assert sorted(map(str, out[0])) == sorted(map(str, out[1])) and len(out[0]) == len(rows)
    for source in {x.source for x in out[0]}:
        part = [x for x in out[0] if x.source == source]
        assert abs(sum(x.taken for x in part) - part[0].target) <= max(x.size for x in part)
        assert all(x.taken <= 3 * x.size for x in part) and part[0].target <= 3 * part[0].source_size + 1e-6
    assert mixing.mix_sources(docs(spark).limit(0)).collect() == []


def test_language_holds_out_and_defaults(spark):
    words = {"aa": ["bana", "kolo", "mira", "tavo"], "bb": ["schtz", "grmpf", "zwelk", "krust"]}
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(words[k], k=30)), k, "s", 0.0) for i in range(80) for k in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(rows + [(900, None, "aa", "s", 0.0), (901, "12 !", "bb", "s", 0.0)], DOCS)
    got = {x.doc_id: x for x in langid.identify_languages(df).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang, _, _ in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[5].held_out == (zlib.crc32(b"5") % 4 == 2)
    kept = langid.reject_unidentified(df, 0.08)
    assert kept.columns == df.columns and kept.count() == 80


def test_license_base_against_brute_force():
    r = random.Random(3)
    vocabulary = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "x", "é"]
    for _ in range(200):
        words = r.choices(vocabulary, k=r.randrange(40))
        text = "".join(w.upper() + r.choice([" ", "-", "\n", ". "]) for w in words)
        low = [w.replace("é", "É") for w in words]
        starts = [(i, label) for phrase, label in license.BASE.items() for p in [phrase.split()] for i in range(len(low)) if low[i : i + len(p)] == p]
        n, base, first, last, labels, every, _, score = license.scan(text)
        assert (n, base, first, last) == (len(words), len(starts), min((i for i, _ in starts), default=None), max((i for i, _ in starts), default=None))
        assert labels == ",".join(sorted({x for _, x in starts})) and set(filter(None, labels.split(","))) <= set(every.split(",")) and 0 <= score <= 1


@pytest.mark.parametrize("text,names,free", [("MIT", {"mit"}, True), ("GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0", {"gpl-2.0-only-with-classpath-exception-2.0", "apache-2.0"}, True), ("(MIT OR GPL-3.0) AND LGPL-2.1", {"mit", "gpl-3.0", "lgpl-2.1"}, False), ("MIT */ more", {"mit"}, True)])
def test_expressions(text, names, free):
    assert license.evaluate(license.parse_expression(text)) == (names, free)


def test_expressions_that_are_none():
    assert license.parse_expression("AND MIT") is None and license.parse_expression("(") is None


def test_quality_separates(spark):
    r = random.Random(1)
    good = [" ".join(r.choices(["alpha", "beta", "gamma,", "Delta."], k=60)) for _ in range(150)]
    bad = [" ".join(x + "%%%" for x in r.choices(["ALPHA", "QX|", "$$"], k=60)) for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(999, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 150, 2)] + [(None, 1)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.score_quality(docs(spark, rows), labels).collect()}
    assert sum(got[i].predicted for i in range(150)) >= 147 and sum(got[i].predicted for i in range(150, 200)) <= 2 and 0 <= got[999].score <= 1


@pytest.mark.parametrize("chunk", [topk.QUERIES, 2])
def test_top_k_against_brute_force(spark, chunk):
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(700)] + [(20, [0.5, 0.5, 0.5, 0.5])] * 2 + [(None, [1.0] * 4), (40, None), (60, [float("nan")] * 4), (81, [0.25, 0.5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5, chunk=chunk).collect()
    f = lambda v: [int(np.floor(64 * float(np.float32(x)))) for x in v] + [0] * (4 - len(v))
    use = [(i, f(v)) for i, v in rows if v is not None and not np.isnan(v).any()]
    want = []
    for a, (i, v) in enumerate(use):
        if i is not None and i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0) for b, (j, w) in enumerate(use) if a != b)[:5]
            want += [(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(best, 1)]
    assert any(x[2] is None for x in want)
    assert sorted(map(str, want)) == sorted(str((x.query_id, x.rank, x.vec_id, x.score)) for x in got)


def test_top_k_skips_blocks_of_clusters():
    r = np.random.default_rng(0)
    centres = r.integers(-40, 40, (30, 16))
    vectors = np.concatenate([c + r.integers(-3, 4, (50, 16)) for c in centres])
    blocks = []
    for at in range(0, len(vectors), 50):
        m = vectors[at : at + 50].astype(np.int64)
        parts = {"ids": np.arange(at, at + 50), "none": np.zeros(50, dtype=bool), "counts": np.ones(50, dtype=np.int64), "vectors": m, "low": m.min(axis=0), "high": m.max(axis=0)}
        blocks.append({"width": 16} | {k: x.tobytes() for k, x in parts.items()})
    q = np.arange(0, len(vectors), 20)
    search = topk.Search(q, vectors[q].astype(np.int64), np.ones(len(q), dtype=np.int64), 20)
    search.blocks(blocks)
    assert search.scored < len(q) * len(vectors) / 4
    score = vectors[q] @ vectors.T
    for i, a in enumerate(q.tolist()):
        want = sorted((-s, j) for j, s in enumerate(score[i].tolist()) if j != a)[:20]
        assert [(-s, j) for s, j in zip(search.score[search.q == i].tolist(), search.id[search.q == i].tolist())] == want


def test_top_k_of_an_empty_table_and_clashing_columns(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    rows = [(i, [float(i)], i, "x") for i in range(0, 60, 20)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, `q.n` string"), k=1).collect()
    assert sorted((x.query_id, x.vec_id) for x in got) == [(0, 20), (20, 40), (40, 20)]


def test_decontamination_tolerates_substitutions(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    item = r.choices(words, k=30)
    near = list(item)
    near[7], near[19] = "zz", "yy"
    texts = [" ".join(r.choices(words, k=50) + x + r.choices(words, k=50)) for x in (item, near, item[:16], item[:9], [])]
    rows = [*enumerate(texts), (50, None), (51, "")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "a b"), (3, None), (4, " ".join(item))], "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, rows), bench)
    assert sorted((x.doc_id, x.item_id) for x in got.collect()) == [(d, i) for d in (0, 1, 2) for i in (1, 4)]
    kept = decontaminate.decontaminate(docs(spark, rows), bench, chunk=10)
    assert sorted(x.doc_id for x in kept.collect()) == [3, 4, 50, 51]


def test_feistel_permutes_and_formats_hold(spark):
    assert all(sorted(pii.feistel(b"k", "t", x, n) for x in range(n)) == list(range(n)) for n in (1, 2, 10, 97, 1000))
    text = "card 4539 1488 0343 6467, again 4539148803436467; ip 10.0.0.1, day 2024-02-29, +1 (988) 555-2485, bad 1234567890123456 and 2024-02-30"
    found = pii.find_values(text, b"k")
    assert [x[2] for x in found] == ["card", "card", "ip", "date", "phone"]
    cards = [x[3].replace(" ", "") for x in found[:2]]
    assert cards[0] == cards[1] and pii.luhn_digit(cards[0][:-1]) == cards[0][-1]
    assert pii.pseudonymise(text, b"k") != text and len(pii.find_values(pii.pseudonymise(text, b"k"), b"k")) >= 4
    assert pii.pseudonymise(None, b"k") is None and pii.find_values("plain words", b"k") == []
    got = pii.pseudonyms(docs(spark, [(1, text), (2, None), (3, "x 4539148803436467")]), b"k").collect()
    assert {x.doc_id for x in got} == {1, 3}
    assert [x.pseudonym for x in got if x.doc_id == 3] == [found[1][3]]


def test_empty_tables(spark):
    none = docs(spark).where(F.lit(False))
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (langid.identify_languages(none), license.scan_licenses(none), quality.score_quality(none, labels), decontaminate.contaminated(none, bench), sstable.token_shards(none, tokenizer_path()), pii.pseudonyms(none, b"k"), mixing.mix_sources(none)):
        assert out.collect() == []
