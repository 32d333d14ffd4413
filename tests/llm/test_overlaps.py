import random
import time
from itertools import combinations

import numpy as np
import pytest

from loomtext.llm import decontaminate


def plain(same):
    """(matches, -length, -start) of the best segment of 80 % and as many matches as 80 % of the item, 12 at most, by trying all."""
    fits = [(sum(same[i:j]), i - j, -i) for i in range(len(same)) for j in range(i + 1, len(same) + 1)]
    return max((x for x in fits if x[0] >= min(12, -(-4 * len(same) // 5)) and 5 * x[0] >= -4 * x[1]), default=None)


def verified(same):
    item = [f"a{i}" for i in range(len(same))]
    seeds = decontaminate.Seeds([" ".join(item)])
    text = ["x", "y"] + [w if s else "zz" for w, s in zip(item, same, strict=True)]
    ids = decontaminate.np.array([seeds.vocabulary.get(w.encode(), 0) for w in text])
    found = decontaminate.verify(seeds.items[0], ids, 2)
    return [(m, -n, -at) for m, n, _, at in ([found] if found else [])], " ".join(text), seeds


@pytest.mark.parametrize("changed", [[2, 13], [*range(12, 17), *range(29, 34)]])
def test_overlaps_of_the_rule_that_a_heaviest_segment_loses(changed):
    n = 16 if len(changed) == 2 else 46
    _, text, seeds = verified([i not in changed for i in range(n)])
    assert 0 in seeds.overlaps(text)


def test_each_diagonal_equals_brute_force():
    r = random.Random(11)
    for _ in range(1500):
        share = r.choice([0.05, 0.15, 0.25, 0.5])
        same = [r.random() > share for _ in range(r.choice([5, 10, 14, 15, 16, 20, 59]))]
        best = plain(same)
        assert verified(same)[0] == ([best] if best else [])


def test_masks_lose_no_overlap():
    for n in range(12, 30):
        k = n - max(12, -(-4 * n // 5))
        fine = np.ones((1 if k <= 0 else len(list(combinations(range(n - 2), k))), n), dtype=bool)
        for row, changed in zip(fine, combinations(range(1, n - 1), max(0, k)), strict=True):
            row[list(changed)] = False
        hit = np.zeros(len(fine), dtype=bool)
        for mask in decontaminate.MASKS:
            kept = [i for i, b in enumerate(mask) if b == "1"]
            for at in range(n - len(mask) + 1):
                hit |= fine[:, [at + i for i in kept]].all(axis=1)
        assert hit.all()


def brute(items, text):
    """Best overlap of each item by every diagonal and every segment of it."""
    w, out = text.split(), {}
    for k, item in enumerate(items):
        v = item.split()
        if len(v) < 5:
            if v and v == w:
                out[k] = (len(v), len(v), 0, 0)
            continue
        best = None
        for shift in range(-len(v) + 1, len(w)):
            first, end = max(0, -shift), min(len(v), len(w) - shift)
            same = [v[i] == w[i + shift] for i in range(first, end)]
            for i in range(len(same)):
                m = 0
                for j in range(i, len(same)):
                    m += same[j]
                    if same[i] and same[j] and m >= min(12, -(-4 * len(v) // 5)) and 5 * m >= 4 * (j - i + 1):
                        x = (m, -(j - i + 1), -(first + i + shift), -(first + i))
                        best = x if best is None or x > best else best
        if best:
            out[k] = (best[0], -best[1], -best[2], -best[3])
    return out


def planted(seed, number):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(r.choices(words, k=k)) for k in (1, 2, 4, 5, 6, 8, 9, 10, 12, 14, 15, 16, 18, 20, 24, 31)] + ["a " * 20, ""]
    texts = ["", items[1], items[2], items[2] + " w1", "a " * 60]
    for _ in range(number):
        v = r.choice(items).split()
        for _ in range(r.randrange(0, 1 + len(v) // 4)):
            v[r.randrange(len(v))] = r.choice(words + ["zz"])
        texts.append(" ".join(r.choices(words, k=r.randrange(12)) + v[r.choice([0, 0, 1]) :] + r.choices(words, k=r.randrange(12))))
    return items, texts


def test_overlaps_equal_brute_force_over_all_diagonals():
    items, texts = planted(5, 220)
    seeds = decontaminate.Seeds(items)
    want = [brute(items, t) for t in texts]
    assert sum(map(len, want)) > 100
    assert [seeds.overlaps(t) for t in texts] == want


def test_a_shuffled_join_gives_the_same_rows(spark):
    items, texts = planted(6, 60)
    docs = [(i, t, "x") for i, t in enumerate([*texts, None, texts[7], *texts[:3]])] + [(None, items[12], "y"), (3, items[13], "y")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, `place.h` string")
    bench = spark.createDataFrame([*enumerate(items), (90, items[12]), (None, items[13]), (91, None)], "item_id long, text string")
    out = [sorted(map(str, decontaminate.contaminated(docs, bench, chunk=c).collect())) for c in (decontaminate.CHUNK, 10)]
    assert out[0] == out[1] and len(out[0]) > 30
    kept = [decontaminate.decontaminate(docs, bench, chunk=c) for c in (decontaminate.CHUNK, 10)]
    assert kept[0].columns == kept[1].columns == docs.columns
    assert sorted(map(str, kept[0].collect())) == sorted(map(str, kept[1].collect()))
    none = bench.where("item_id > 1000")
    for c in (decontaminate.CHUNK, -1):
        assert decontaminate.contaminated(docs, none, chunk=c).collect() == [] and decontaminate.decontaminate(docs, none, chunk=c).count() == docs.count()
        assert decontaminate.contaminated(docs.where("doc_id > 1000"), bench, chunk=c).collect() == []


def test_repeated_words_take_little_time():
    seeds, start = decontaminate.Seeds(["a " * 300]), time.monotonic()
    assert seeds.overlaps("a " * 20_000)[0][:2] == (300, 300)
    assert time.monotonic() - start < 20
