import random

import pytest

from loomtext.llm import shingles, simhash

SCHEMA = "doc_id long, text string"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def least_ids(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                root = [root[j] if x == root[i] else x for x in root]
    return sorted((d, min(e for (e, _), r in zip(rows, root, strict=True) if r == root[i])) for i, (d, _) in enumerate(rows))


def texts(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = r.choices(words, k=9)
    rows = [None, "", "one", "ONE", "a b c", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(30):
        base = r.choices(words, k=r.choice([6, 20, 60, 300])) + (line if r.random() < 0.5 else [])
        rows.append(" ".join(base))
        for _ in range(r.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(r.randrange(1, 2 + len(base) // 25)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(" ".join(copy[r.randrange(3) :]))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("common", [shingles.COMMON, 10**9])
def test_classes_equal_brute_force(spark, common, monkeypatch):
    monkeypatch.setattr(shingles, "COMMON", common)
    rows = texts(common % 7)
    got = shingles.similar_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    want = least_ids(rows)
    assert sorted((x.doc_id, x.component_id) for x in got) == want
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(x.doc_id for x in kept) == sorted({c for _, c in want})


def test_drops_a_similar_text_of_a_far_fingerprint(spark):
    r = random.Random(3)
    a = [f"w{r.randrange(5000)}" for _ in range(269)]
    b = a[:-1]
    b[60], b[180] = "xx", "yy"
    x, y = " ".join(a), " ".join(b)
    assert (simhash.fingerprint(x) ^ simhash.fingerprint(y)).bit_count() > 4 and len(grams(x) & grams(y)) >= 0.8 * len(grams(x) | grams(y))
    assert [k.doc_id for k in simhash.drop_near_duplicates(spark.createDataFrame([(1, x), (2, y)], SCHEMA)).collect()] == [1]


def test_rows_outside_the_map_are_not_marked(spark, monkeypatch):
    rows = spark.createDataFrame([(i if i % 7 else None, i % 50) for i in range(400)], "c0 long, c1 long")
    marked = rows.where("c1 < 9").distinct().toDF("mark_id", "mark_place")
    for bits in (1 << 26, 64):
        monkeypatch.setattr(shingles, "BITS", bits)
        got = shingles._seen(rows, rows.c0, rows.c1, marked).collect()
        assert len(got) == 400 and all(r.may for r in got if r.c1 < 9)
        assert bits == 64 or sum(r.may for r in got) == sum(r.c1 < 9 for r in got)
    assert not any(r.may for r in shingles._seen(rows, rows.c0, rows.c1, marked.limit(0)).collect())


def near_texts(seed):
    """Texts of 60 words, each with a copy within 4 bits: half of these have a changed word and are similar, half the words in another order."""
    r = random.Random(seed)
    rows = []
    for i in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(60)]
        copy = list(base)
        copy[r.randrange(60)] = "xx"
        copy = copy if i % 2 else base[::-1]
        a, b = (shingles.fingerprint(shingles.word_hashes(" ".join(t))) for t in (base, copy))
        if (a ^ b).bit_count() <= 4:
            rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(copy))]
    return rows


def test_fingerprints_find_pairs_that_shingles_decide(spark, monkeypatch):
    rows = near_texts(5)
    assert len(rows) > 60 and len(rows) // 2 < len({c for _, c in least_ids(rows)}) < len(rows)
    monkeypatch.setattr(shingles, "_shared", lambda batches: iter(()))  # no prefix key has two rows
    got = shingles.similar_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == least_ids(rows)


def test_pairs_of_fingerprints_are_decided_by_shingles(spark, monkeypatch):
    every = lambda prints: prints.crossJoin(prints.select(prints.node.alias("b"))).where("node < b").selectExpr("node a", "b")
    monkeypatch.setattr(shingles, "near_fingerprints", lambda prints: shingles.materialise(every(prints), "every"))
    rows = texts(2)[:40]
    got = shingles.similar_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == least_ids(rows)


def test_near_fingerprints_equal_brute_force(spark):
    r = random.Random(8)
    prints = []
    for _ in range(60):
        base = r.getrandbits(64)
        prints += [base ^ sum(1 << b for b in r.sample(range(64), k)) for k in r.sample(range(7), 3)] + [base]
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    rows = [(i, x) for i, x in enumerate(signed)]
    pairs = [(p.a, p.b) for p in shingles.near_fingerprints(spark.createDataFrame(rows, "node long, fp long")).collect()]
    assert all(a < b and (prints[a] ^ prints[b]).bit_count() <= 4 for a, b in pairs) and len(pairs) == len(set(pairs))

    def classes(links):
        root = list(range(len(rows)))
        for a, b in links:
            root = [root[b] if x == root[a] else x for x in root]
        return [root.index(x) for x in root]

    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert classes(pairs) == classes(near) and len(near) > 60
