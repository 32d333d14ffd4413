"""The whole pipeline against a plain version of every stage."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_overlaps import brute
from test_shingles import grams

import corpus_pipeline
from loomtext.llm import langid, mixing
from loomtext.llm.queries import tokenizer_path
from loomtext.llm.words import words
from loomtext.plans.runtime import BATCH

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed):
    r = random.Random(seed)
    speech = {k: ["".join(r.choices(letters, k=r.randrange(2, 7))) for _ in range(80)] for k, letters in (("aa", "abcdeklmo"), ("bb", "pqrstuvwz"))}
    items = [" ".join(r.choices(speech["aa"], k=20)), " ".join(r.choices(speech["bb"], k=8)), None, ""]
    rows = [(1000, None, "aa", "s1", 1), (1001, "", None, None, 2), (1002, "12 34 !", "bb", "s2", 3), (None, "kolo mira tavo kolo mira", "aa", None, 4), (None, "kolo mira tavo kolo mira", "aa", None, 5)]
    for i in range(60):
        k = r.choice(["aa", "bb"])
        base = r.choices(speech[k], k=r.choice([1, 6, 30, 60]))
        if i % 9 == 0:
            base = base + items[i % 2].split() + base
        source = r.choice(["s1", "s1", "s1", "s2", "s3", None])
        rows.append((i * 10, " ".join(base), k, source, i))
        if i % 3 == 0:
            copy = list(base)
            copy[r.randrange(len(copy))] = r.choice(speech[k])
            rows.append((i * 10 + r.choice([0, 5]), " ".join(copy).upper() if i % 2 else " ".join(base), k, source, i))
    r.shuffle(rows)
    return rows, [(i, t) for i, t in enumerate(items)]


def known(rows):
    """Rows whose text has letters and is near a learned language, with trigrams bound and bundled one by one."""
    space, sums = langid.space(), {}
    a, b, c = space.places

    def vector(text):
        out = np.zeros(langid.DIMENSIONS)
        for g in langid.ngrams(text).tolist():
            out += a[g // langid.LETTERS**2] * b[g // langid.LETTERS % langid.LETTERS] * c[g % langid.LETTERS]
        return out

    for d, text, lang, *_ in rows:
        if lang is not None and d is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + vector(text)
    out = []
    for row in rows:
        v = vector(row[1])
        best = max((float(v @ s) / max(1e-12, float(np.linalg.norm(v) * np.linalg.norm(s))) for s in sums.values()), default=0)
        n = len(langid.ngrams(row[1]))
        if n and (n < langid.TELLING or best >= corpus_pipeline.LEAST_COSINE):
            out.append(row)
    return out


def one_of_each(spark, rows):
    """Classes by all pairs of texts; the hash of a text decides between rows of one id."""
    sets, root = [grams(x[1]) for x in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    texts = list({x[1] for x in rows})
    place = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    kept = {}
    for k, row in zip(root, rows, strict=True):
        key = (row[0] is None, row[0] or 0, place[row[1]])
        if k not in kept or key < kept[k][0]:
            kept[k] = key, row
    return [row for _, row in kept.values()]


def test_run_equals_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = corpus(3)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = one_of_each(spark, known(rows))
    plain = [b" ".join(words(t)).decode() for _, t in items]
    clean = [x for x in kept if not brute(plain, b" ".join(words(x[1])).decode())]
    assert len(rows) > len(known(rows)) > len(kept) > len(clean) > 10
    copies = {}
    for x in mixing.mix_sources(spark.createDataFrame(clean, DOCS)).collect():
        copies[str((x.doc_id, x.size))] = x.copies
    mixed = [x for x in clean for _ in range(copies[str((x[0], len(x[1].split())))])]
    for source in {x[3] for x in clean}:  # the mix itself is near its targets
        words_of = lambda part: sum(len(x[1].split()) for x in part if x[3] == source)
        assert words_of(mixed) <= 3 * words_of(clean)
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), []
    for x in mixed:
        ids = np.array([*tokenizer.encode(x[1], add_special_tokens=False).ids, 2], dtype="<u4")
        want.append(str((x[0], len(ids), zlib.crc32(ids.tobytes()))))
    assert sorted(want) == sorted(str((x.doc_id, x.n_tokens, x.ids_crc32)) for x in got)
    starts = sorted((x.start, x.n_tokens) for x in got)
    assert [s for s, _ in starts] == np.cumsum([0] + [n for _, n in starts])[:-1].tolist()


def test_run_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame([], DOCS)
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_long_texts_reach_workers_in_small_batches(spark, tmp_path):
    """A batch of long texts is held by the JVM and by the worker; 400 texts of 50 KB were one batch of 20 MB."""
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    long = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("lorem "), 8_500).alias("text"))
    docs = spark.createDataFrame([(1, "kolo mira tavo", "aa", "s1", 1)], DOCS)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name == "mixing":  # has no Python
                continue
            spark.conf.unset(ARROW_BYTES)
            stage(spark, docs, str(tmp_path))
            found = long.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(x.rows for x in found) == 400, name
            assert max(x.bytes for x in found) < BATCH + 2 * 51_000, name
    finally:
        spark.conf.unset(ARROW_BYTES)


def test_run_is_the_same_by_any_batches(spark, tmp_path):
    rows, items = corpus(5)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    try:
        got = []
        for most in ("64m", "1k"):
            spark.conf.set(ARROW_BYTES, most)
            got.append(sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())))
            assert spark.conf.get(ARROW_BYTES) == ("1k" if most == "1k" else str(BATCH))  # a smaller limit stays
        assert got[0] == got[1] and len(got[0]) > 10
    finally:
        spark.conf.unset(ARROW_BYTES)
