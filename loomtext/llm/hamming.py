"""Pigeonring-filtered Hamming search over 64-bit SimHash fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.files import give_back
from loomtext.plans.runtime import checkpoint, shuffle_partitions

#: 16 segments of 4 bits round the ring; at distance 4 a segment's share of the budget is 1/4.
SEGMENTS, WIDTH, DISTANCE = 16, 4, 4
#: Segments of the indexed chain: its cumulative budgets are 0 0 0 1 1 1 1.
CHAIN = 7
#: Shingles counted at a time, so that a very long text needs no more memory than its own.
STEP = 1 << 18
#: A bucket of more fingerprints than this is dealt out in pairs of blocks.
BUCKET = 20_000


def ones_of(h: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit hashes have each bit, the highest first; STEP hashes at most."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The 64 bits that more than half of ``n`` hashes have."""
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def set_fingerprint(h: np.ndarray) -> int:
    """SimHash of a set of 64-bit hashes, unsigned; 0 for none."""
    return majority(sum((ones_of(h[at : at + STEP].view(np.uint64)) for at in range(0, len(h), STEP)), np.zeros(64, dtype=np.int64)), len(h))


def _chain_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): the ring's chain from each start, less one of its last four segments.

    Within 4 bits, some start has every prefix of its chain within the proportional budget (the
    pigeonring principle). There the first three segments agree and the next four differ in one
    bit at most, so that at least three of these agree as well.
    """
    bits, tail = SEGMENTS * WIDTH, CHAIN - 3
    at = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * tail - 1))).alias("slot"))
    at = at.withColumn("i", F.expr(f"cast(slot div {tail} as int) * {WIDTH}")).withColumn("below", F.expr(f"cast({tail} - 1 - slot % {tail} as int) * {WIDTH}"))
    at = at.withColumn("chain", F.expr(f"shiftrightunsigned(shiftleft(fp, i) | shiftrightunsigned(fp, {bits} - i), {bits - CHAIN * WIDTH})"))
    value = f"shiftleft(shiftrightunsigned(chain, below + {WIDTH}), below) | (chain & (shiftleft(1L, below) - 1))"
    return at.select(F.expr(f"shiftleft(cast(slot as bigint), {(CHAIN - 1) * WIDTH}) | {value}").alias("key"), "fp")


def _within(slot: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of the xors ``x`` keep the cumulative budgets of every chain from their slot's start, the whole ring included."""
    two = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    nib = (two & np.uint64(0x3333333333333333)) + ((two >> np.uint64(2)) & np.uint64(0x3333333333333333))
    start = slot // (CHAIN - 3)
    alive, total = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for length in range(1, SEGMENTS + 1):
        at = (start[alive] + length - 1) % SEGMENTS
        shift = ((SEGMENTS - 1 - at) * WIDTH).astype(np.uint64)
        total = total + ((nib[alive] >> shift) & np.uint64(15)).astype(np.int64)
        keep = total * SEGMENTS <= DISTANCE * length
        alive, total = alive[keep], total[keep]
    return alive


def _forest(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each run of equal keys, what is within the distance; at most one fewer than fingerprints."""
    n, left, right = len(key), [], []
    root = np.arange(n)
    slot = key >> ((CHAIN - 1) * WIDTH)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, n])
    open_runs, place = size >= 2, np.repeat(np.arange(len(start)), size)
    d = 1
    while open_runs.any():
        p = np.flatnonzero(open_runs[place] & (np.arange(n) - start[place] + d < size[place]))
        p = p[root[p] != root[p + d]]
        p = p[_within(slot[p], fp[p] ^ fp[p + d])]
        p = p[np.bitwise_count(fp[p] ^ fp[p + d]) <= DISTANCE]
        merged = False
        for a in p.tolist():
            b = a + d
            ra, rb = a, b
            while root[ra] != ra:
                ra = root[ra]
            while root[rb] != rb:
                rb = root[rb]
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                left.append(a)
                right.append(b)
                merged = True
        if merged:
            while (jump := root[root]).tobytes() != root.tobytes():
                root = jump
        d += 1
        open_runs &= size > d
        if merged and open_runs.any():
            parts = np.zeros(len(start), dtype=np.int64)
            np.add.at(parts, place[np.flatnonzero(root == np.arange(n))], 1)
            open_runs &= parts > 1
    return fp[left].view(np.int64), fp[right].view(np.int64)


def _links(limit: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by group and key; rows (null, null, key) name keys of more than ``limit`` fingerprints."""

    def out(a: np.ndarray, b: np.ndarray, late: list[int]) -> pa.RecordBatch:
        null = [None] * len(late)
        return pa.RecordBatch.from_arrays([pa.array(a.tolist() + null, pa.int64()), pa.array(b.tolist() + null, pa.int64()), pa.array([None] * len(a) + late, pa.int64())], ["a", "b", "late"])

    group, key, fp = (np.empty(0, dtype=np.int64) for _ in range(3))
    skip: tuple[int, int] | None = None
    for batch in batches:
        g, k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if skip is not None:
            stay = ~((g == skip[0]) & (k == skip[1]))
            g, k, f = g[stay], k[stay], f[stay]
        if not len(k):
            continue
        group, key, fp = np.concatenate([group, g]), np.concatenate([key, k]), np.concatenate([fp, f])
        cut = int(np.argmax((group == group[-1]) & (key == key[-1])))
        if cut:
            yield _linked(group[:cut], key[:cut], fp[:cut], out)
            group, key, fp = group[cut:], key[cut:], fp[cut:]
        if limit is not None and len(key) > limit:
            skip = (int(group[0]), int(key[0]))
            yield out(np.empty(0, np.int64), np.empty(0, np.int64), [skip[1]])
            group, key, fp = (np.empty(0, dtype=np.int64) for _ in range(3))
    if len(key):
        yield _linked(group, key, fp, out)
    give_back()


def _linked(group, key, fp, out) -> pa.RecordBatch:
    edge = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
    run = np.cumsum(edge) - 1
    size = np.bincount(run)
    many = size[run] >= 2
    key, fp, group = key[many], fp[many], group[many]
    if not len(key):
        return out(np.empty(0, np.int64), np.empty(0, np.int64), [])
    if len(group) and group.any():  # blocks of one key: told apart by the group
        parts = [_forest(key[group == g], fp[group == g].view(np.uint64)) for g in np.unique(group)]
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        a, b = _forest(key, fp.view(np.uint64))
    return out(a, b, [])


def hamming_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs within 4 bits of the distinct ``fp``.

    Buckets of one chain key give spanning links, never all pairs. A key of more than ``bucket``
    fingerprints is dealt out again in pairs of blocks, each a task's group of bounded size.
    """
    spark = fps.sparkSession
    n = shuffle_partitions(spark)
    keyed = _chain_keys(fps.repartition(n, "fp"))

    def linked(rows: DataFrame, limit: int | None, *by: str) -> DataFrame:
        dealt = rows.select("group", "key", "fp").repartition(n, *by).sortWithinPartitions("group", "key", "fp")
        return dealt.mapInArrow(lambda it: _links(limit, it), "a long, b long, late long")

    first = checkpoint(linked(keyed.withColumn("group", F.lit(0).cast("long")), bucket, "key"))
    links = first.where("a is not null").select("a", "b")
    late = first.where("late is not null").select(F.col("late").alias("key")).distinct()
    if not late.isEmpty():
        rows = checkpoint(keyed.join(late, "key", "left_semi"))
        blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(bucket / 2)).cast("long").alias("blocks"))
        rows = rows.join(blocks, "key").withColumn("own", F.expr("pmod(xxhash64(fp), blocks)"))
        rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        rows = rows.withColumn("group", F.expr("least(own, other) * blocks + greatest(own, other) + 1"))
        links = links.unionByName(checkpoint(linked(rows, None, "key", "group")).select("a", "b"))
    return links.distinct()
