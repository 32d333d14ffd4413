"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.columns import fields, numbered, place_of
from loomtext.llm.words import words
from loomtext.plans.runtime import materialise

#: Words that must match in an overlap at most, and of its words the share that must.
MATCHES, SHARE = 12, 0.8
#: Fixed masks for items of LONG words or more: a window's words at 1 are hashed, those at 0 ignored. Found by a
#: search, so that every overlap of 12 matches and 80 % has a window whose hashed words all match (a test tries all).
MASKS = ("1111011", "1110100011", "11000011011", "1110111")
LONG = 15
#: An item of fewer words than this matches only a text of these very words.
SHORT = 5
#: Solid runs that the masks of shorter items keep.
RUNS = range(2, 6)
#: Characters of distinct benchmark texts that go to the executors; more are joined by a shuffle.
CHUNK = 4 << 20
#: Hits are told apart so many at a time.
STEP = 1 << 20
#: Bits of the map of all masked hashes, by which a shuffled join leaves windows out early; 16 MB.
BITS = 1 << 27


def enough(n: int) -> int:
    """Matches that an overlap with an item of n words needs: 80 % of the item, 12 at most."""
    return min(MATCHES, -(-round(SHARE * 100) * n // 100))


def _masks() -> list[tuple[int, list[int]]]:
    """(number, hashed places) of the masks of long items and of the runs of shorter ones."""
    long = [[i for i, b in enumerate(m) if b == "1"] for m in MASKS]
    return list(enumerate([*long, *(list(range(n)) for n in RUNS)], 1))


def _hash(ids: np.ndarray, at: np.ndarray, offsets: list[int], number: int) -> np.ndarray:
    h = np.full(len(at), number, dtype=np.uint64)
    for o in offsets:
        h = (h ^ ids[at + o].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _item_places(n: int) -> dict[int, np.ndarray]:
    """Where an item of n words is hashed, by number of mask.

    Long items are at every place. A shorter one, of which k words may differ, falls in k + 1 runs:
    one of them has no differing word.
    """
    if n >= LONG:
        return {number: np.arange(n - offsets[-1]) for number, offsets in _masks()[: len(MASKS)]}
    out: dict[int, np.ndarray] = {}
    if n >= SHORT:
        edges = np.linspace(0, n, n - enough(n) + 2).astype(int)
        for number, offsets in _masks()[len(MASKS) :]:
            out[number] = edges[:-1][np.diff(edges) == len(offsets)]
    return out


def verify(want: np.ndarray, ids: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """The overlap of most matches on a diagonal, of those of enough matches and SHARE; the shortest, then the first, of equals.

    (matches, words, start in the text, start in the item), or None; the item's word i meets the
    text's word i + shift.
    """
    first, end = max(0, -shift), min(len(want), len(ids) - shift)
    same = want[first:end] == ids[first + shift : end + shift]
    at = np.flatnonzero(same)  # an overlap that is best starts and ends with a match
    if len(at) < enough(len(want)):
        return None
    # Matches i to j have SHARE of their words if above[j] >= below[i]: the first such i has the most matches.
    order = np.arange(len(at))
    above, below = (order + 1) * 100 - round(SHARE * 100) * (at + 1), order * 100 - round(SHARE * 100) * at
    i = np.searchsorted(-np.minimum.accumulate(below), -above, "left")
    matches, length = order - i + 1, at - at[i] + 1
    j = int(np.lexsort((length, -matches))[0])
    place = first + int(at[i[j]])
    return (int(matches[j]), int(length[j]), place + shift, place) if matches[j] >= enough(len(want)) else None


def _better(x: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    return x[0], -x[1], -x[2], -x[3]


class Seeds:
    """The masked windows of a set of texts, sorted by hash, and the texts' words to verify with."""

    def __init__(self, texts: list[str]):
        found = [words(t) for t in texts]
        self.vocabulary: dict[bytes, int] = {}
        for w in found:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.items = [np.array([self.vocabulary[x] for x in w], dtype=np.int64) for w in found]
        self.whole: dict[tuple[bytes, ...], list[int]] = {}
        for k, w in enumerate(found):
            if 0 < len(w) < SHORT:
                self.whole.setdefault(tuple(w), []).append(k)
        places = [_item_places(len(w)) for w in found]
        self.tables = []
        for number, offsets in _masks():
            parts = [(_hash(ids, at[number], offsets, number), np.full(len(at[number]), k), at[number]) for k, (ids, at) in enumerate(zip(self.items, places, strict=True)) if len(at.get(number, ()))]
            if parts:
                h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(h, kind="stable")
                self.tables.append((number, offsets, h[order], item[order], at[order]))

    def _diagonals(self, ids: np.ndarray) -> np.ndarray:
        """Distinct (item, shift) of all hits."""
        known, found = ids > 0, []
        span = len(ids) + max(map(len, self.items), default=0) + 1
        for number, offsets, hashes, items, starts in self.tables:
            n = len(ids) - offsets[-1]
            if n <= 0:
                continue
            full = known[:n].copy()
            for o in offsets[1:]:
                full &= known[o : o + n]
            at = np.flatnonzero(full)
            if not len(at):
                continue
            h = _hash(ids, at, offsets, number)
            low = np.searchsorted(hashes, h, "left")
            hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == h)
            if not len(hit):
                continue
            at, low = at[hit], low[hit]
            size = np.searchsorted(hashes, h[hit], "right") - low
            upto = np.cumsum(size)
            codes, begin = np.empty(0, dtype=np.int64), 0
            while begin < len(at):  # a window at least, and about STEP hits
                end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - size[begin] + STEP, "right")))
                some = size[begin:end]
                j = np.repeat(low[begin:end] - np.cumsum(some) + some, some) + np.arange(some.sum())
                codes = np.unique(np.concatenate([codes, items[j] * (2 * span) + np.repeat(at[begin:end], some) - starts[j] + span]))
                begin = end
            found.append(codes)
        if not found:
            return np.empty((0, 2), dtype=np.int64)
        codes = np.unique(np.concatenate(found))
        return np.stack([codes // (2 * span), codes % (2 * span) - span], axis=1)

    def overlaps(self, text: str | None) -> dict[int, tuple[int, int, int, int]]:
        """For each text that overlaps: matching words, words, start in ``text`` and in the item, of its best overlap."""
        w = words(text)
        best = {k: (len(w), len(w), 0, 0) for k in self.whole.get(tuple(w), ())} if 0 < len(w) < SHORT else {}
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(0)), dtype=np.int64, count=len(w))
        for item, shift in self._diagonals(ids).tolist():
            if (found := verify(self.items[item], ids, shift)) is not None:
                best[item] = max(best.get(item, found), found, key=_better)
        return best


_HELD: dict[int, tuple[list[str], Seeds]] = {}


def _seeds(texts: list[str]) -> Seeds:
    """The seeds of a broadcast value, made once in each worker."""
    if id(texts) not in _HELD:
        _HELD.clear()
        _HELD[id(texts)] = texts, Seeds(texts)
    return _HELD[id(texts)][1]


def _word_ids(text: str | None) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _whole_hash(ids: np.ndarray) -> np.ndarray:
    return _hash(ids, np.zeros(1, dtype=np.int64), list(range(len(ids))), 0)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, item, start) of every masked window of benchmark texts (item, t)."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = _word_ids(text)
            at = _item_places(len(ids))
            parts = [(_hash(ids, at[number], offsets, number), at[number]) for number, offsets in _masks() if len(at.get(number, ()))]
            if 0 < len(ids) < SHORT:
                parts = [(_whole_hash(ids), np.zeros(1, dtype=np.int64))]
            if parts:
                h, start = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(np.full(len(h), item)), pa.array(start)], ["h", "item", "start"])


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(place, item, matches, length, doc_start, item_start) of the texts of ``docs`` (place, text) that overlap ``items`` (item, t).

    Masked hashes of both sides are joined by a shuffle. A map of all the benchmark's hashes, of a
    fixed size, leaves out most other windows before; it changes no result.
    """
    spark = docs.sparkSession
    seeds = materialise(items.mapInArrow(_item_windows, "h long, item long, start long"), "benchmark-seeds")
    bit = F.pmod("h", F.lit(BITS)) + 1  # buckets and positions count from 1
    parts = seeds.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    known = np.zeros(BITS // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():  # 4,096 rows of 4 KB at most
        start = (r["at"] - 1) * 4096
        known[start : start + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    sent = spark.sparkContext.broadcast(known)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = _word_ids(text)
                parts = [(_whole_hash(ids), np.zeros(1, dtype=np.int64))] if 0 < len(ids) < SHORT else []
                for number, offsets in _masks():
                    at = np.arange(max(0, len(ids) - offsets[-1]))
                    parts.append((_hash(ids, at, offsets, number), at))
                h, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                low = (_signed(h) % BITS).astype(np.int64)
                there = (known[low >> 3] >> (low & 7) & 1).astype(bool)
                if there.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(there.sum()), place)), pa.array(_signed(h[there])), pa.array(at[there])], ["place", "h", "at"])

    hits = docs.mapInArrow(windows, "place long, h long, at long").join(seeds, "h").select("place", "item", (F.col("at") - F.col("start")).alias("shift")).distinct()
    # The diagonals of one text and one item: no more than the words of both.
    pairs = materialise(hits.groupBy("place", "item").agg(F.collect_list("shift").alias("shifts")), "benchmark-hits")
    texts = docs.join(pairs.select("place").distinct(), "place", "left_semi").dropDuplicates(["place"])
    rows = pairs.join(texts, "place").join(items, "item").select("place", "item", "shifts", "text", "t")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, item, shifts, text, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, want = _word_ids(text), _word_ids(t)
                if len(want) < SHORT:
                    found = [(len(want), len(want), 0, 0)] if np.array_equal(ids, want) else []
                else:
                    found = [x for x in (verify(want, ids, s) for s in shifts) if x is not None]
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(["place", "item", "matches", "length", "doc_start", "item_start"], (place, item, *max(found, key=_better)), strict=True))])

    return rows.mapInArrow(check, "place long, item long, matches long, length long, doc_start long, item_start long")


def _benchmark(benchmark: DataFrame, text_col: str, chunk: int) -> tuple[DataFrame, list[str] | None]:
    """The distinct benchmark texts (item, t), and their list if they hold ``chunk`` characters at most."""
    texts = fields(benchmark, text_col).select(F.col("f0").cast("string").alias("t")).where("t is not null").distinct()
    texts = materialise(texts.select(F.xxhash64("t").alias("item"), "t"), "benchmark-texts")
    small = (texts.agg(F.sum(F.length("t"))).first()[0] or 0) <= chunk
    return texts, sorted(r["t"] for r in texts.collect()) if small else None


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, item_id, matches, length, doc_start, item_start): one row for each document and item that overlap.

    An overlap lies on one diagonal and may have substituted words: 80 % of its words match, and so
    many as 80 % of the item's words, 12 at most. An item of under 5 words overlaps a text of these
    very words alone. Every diagonal of the item's whole text and the document's whole text that
    holds such an overlap is found. Places count words from 0.

    Benchmark texts of ``chunk`` characters together go to the executors; more are joined by their
    hashes, with equal results. Items of equal text each get a row. Null and empty texts and items
    overlap nothing; ids may repeat or be null, each row having its own; other columns are ignored;
    empty tables give no rows.
    """
    rows = fields(docs, id_col, text_col).select(F.col("f0").cast("long").alias("doc_id"), F.col("f1").cast("string").alias("text"))
    items = fields(benchmark, item_col, text_col).select(F.col("f0").alias("item_id"), F.col("f1").cast("string").alias("t")).where("t is not null")
    texts, small = _benchmark(benchmark, text_col, chunk)
    figures = ["matches", "length", "doc_start", "item_start"]
    if small is None:
        placed = rows.where("text is not null").withColumn("place", F.xxhash64("text"))
        found = _hits(placed.select("place", "text"), texts)
        out = placed.select("doc_id", "place").join(found, "place").join(texts, "item")
        return out.join(items, "t").select("doc_id", "item_id", *figures)
    sent = docs.sparkSession.sparkContext.broadcast(small)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sent.value
        for batch in batches:
            seeds = _seeds(texts)
            found = [(d, texts[i], *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, x in seeds.overlaps(t).items()]
            if found:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", *figures])

    out = rows.mapInArrow(find, "doc_id long, t string, matches long, length long, doc_start long, item_start long")
    return out.join(items, "t").select("doc_id", "item_id", *figures)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark text, as ``contaminated`` tells.

    Null and empty texts stay, repeated rows stay or go together, other columns stay whatever their
    names. An empty benchmark keeps every row, an empty table gives an empty one.
    """
    texts, small = _benchmark(benchmark, text_col, chunk)
    plain = numbered(docs)
    text = F.col(f"c{place_of(docs, text_col)}").cast("string")
    if small is None:
        found = _hits(plain.select(F.xxhash64(text).alias("place"), text.alias("text")).where("text is not null"), texts)
        marked = materialise(found.select("place").distinct(), "contaminated")
        return plain.join(marked, F.xxhash64(text) == F.col("place"), "left_anti").toDF(*docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(small)

    @F.udf("boolean", useArrow=True)
    def clean(t: str | None) -> bool:
        return not _seeds(sent.value).overlaps(t)

    return plain.where(clean(text)).toDF(*docs.columns)
