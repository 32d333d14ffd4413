import random
import re

import numpy as np
import pytest
import xxhash

from loomtext.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp string, component string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows):
    prints = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(x for x in (best.get(find(i)), d) if x is not None) if (d, best.get(find(i))) != (None, None) else None
    return sorted((str(d), f"{prints[i]:016x}", str(best[find(i)])) for i, (d, _) in enumerate(rows))


def texts(seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["Été", "ÀB", "x y"]
    rows = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (1005, "a b c"), (1006, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "z"), (8, "word " * 30000)]
    for k in range(25):
        base = [r.choice(words) for _ in range(r.choice([5, 60, 300]))]
        for c in range(r.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(c % 3):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((k * 20 + c, " ".join(copy)))
    return rows


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_classes_equal_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash.hamming_links, "__defaults__", (bucket,))
    rows = texts(5)
    df = spark.createDataFrame([(d, t, "en", "x", "y") for d, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicate_classes(df).collect())
    assert got == classes(rows)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 50])
def test_links_of_dense_clusters_connect_what_all_pairs_connect(spark, bucket):
    r = random.Random(1)
    fps = set()
    for _ in range(6):
        c = r.getrandbits(64)
        for _ in range(150):
            x = c
            for _ in range(r.randrange(7)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    a = np.array(fps, dtype=np.uint64)
    signed = a.view(np.int64).tolist()
    links = {tuple(sorted(x)) for x in simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket).collect()}

    def parts(pairs):
        parent = {x: x for x in signed}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for x, y in pairs:
            parent[find(x)] = find(y)
        out = {}
        for x in signed:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    near = [(signed[i], signed[j]) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 4).tolist()]
    assert set(links) <= {tuple(sorted(x)) for x in near}
    assert parts(links) == parts(near)


def test_keeps_one_row_of_each_class(spark):
    rows = [(3, "a b c d e"), (1, "A b c d e"), (1, "zz"), (5, "zz"), (None, None), (None, ""), (None, "solo text"), (None, "solo text"), (9, "other words are here"), (9, "other words are here"), (None, "a b c d e")]
    df = spark.createDataFrame([(*r, "en", "", "") for r in rows], "doc_id long, text string, `again` string, `mark.id` string, c0 string")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted((str(r[0]), r[1]) for r in kept.collect())
    assert [x for x in got if x[1]] == [("1", "A b c d e"), ("1", "zz"), ("9", "other words are here"), ("None", "solo text")]
    assert len(got) == 5  # one of null and empty


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicate_classes(df).collect() == [] == simhash.drop_near_duplicates(df).collect()
