"""Near-duplicates: all pairs of texts with a Jaccard similarity of 0.8 or more of their shingles, exactly.

SimHash fingerprints find pairs by pigeonring first; prefix keys give the pairs that fingerprints
leave in different components. All shingles decide both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.columns import fields, numbered, place_of
from loomtext.llm.files import give_back
from loomtext.llm.hamming import hamming_links, set_fingerprint
from loomtext.operators.components import connected_components
from loomtext.plans.runtime import materialise, release, shuffle_partitions

WORDS = 5
#: Similar: the shingles in common are LEAST / OF or more of all shingles of both.
LEAST, OF = 4, 5
#: About so many texts tell which shingles are common; those in COMMON or more of them go last in the order, KEPT at most.
SAMPLE, COMMON, KEPT = 5_000, 3, 100_000
#: Texts are made sets so many at a time.
STEP = 256
#: Pairs of a run are tried about so many at a time, and given out once there are as many.
TRIED = 1 << 18
#: Longs of a set's parity map beside each of its keys, and the least and most of the wide one that pairs
#: are held against, which has a bit a shingle or more between: differing bits of two maps are at most the
#: shingles that only one set has.
MAP, WIDE, WIDEST = 4, 16, 1 << 14
MAPS = [f"m{i}" for i in range(MAP)]
LONGS = ", ".join(f"{m} long" for m in MAPS)
#: A key of more rows than this is dealt out in pairs of blocks.
BUCKET = 20_000
#: Rows of a key after each that are tried as its neighbours.
NEAR = 8
#: Bits of the map of marked rows, 2 MB: rows that it does not have stay without a shuffle.
BITS = 1 << 24


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a whole text's words in order: A-Z are lower-cased, words are runs of anything but ASCII white space."""
    words = (text or "").encode("utf-8").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def fingerprint(h: np.ndarray) -> int:
    """SimHash of the distinct words of hashes ``h``, unsigned; texts of equal shingles have equal ones.

    A changed word is one of these features but five of the shingles: of 48 similar pairs in sf0.1
    32 are within 4 bits, and 3 by the shingles' own fingerprints.
    """
    return set_fingerprint(np.unique(h))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles of 5 words; fewer words make one shingle, none no shingle."""
    return _shingled(word_hashes(text))


def _shingled(h: np.ndarray) -> np.ndarray:
    wide = min(WORDS, len(h))
    n = len(h) - wide + 1 if wide else 0
    out = np.full(n, wide, dtype=np.uint64)
    for i in range(wide):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found]))], ["key"])


def common_shingles(docs: DataFrame, text_col: str) -> np.ndarray:
    """Sorted hashes of shingles that many texts of a sample have; they steer the order alone, not the result."""
    rows = docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null")
    parts = max(1, -(-rows.count() // SAMPLE))
    texts = rows.where(F.expr(f"pmod(xxhash64(t), {parts}) = 0")).distinct()
    counted = texts.mapInArrow(_sampled, "key long").groupBy("key").count().where(F.col("count") >= COMMON)
    return np.array(sorted(r["key"] for r in counted.orderBy(F.desc("count"), "key").limit(KEPT).collect()), dtype=np.int64)


def parity_map(s: np.ndarray) -> np.ndarray:
    """WIDE longs, doubled until there is a bit a shingle or WIDEST is reached; each shingle turns one bit.

    A map of half the length is its halves' exclusive or.
    """
    longs = WIDE
    while 64 * longs < len(s) and longs < WIDEST:
        longs *= 2
    odd = np.bincount((s.view(np.uint64) % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *values])))


def shingle_sets(docs: DataFrame, common: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(row, id, place, node, n, fp, m0..., wide, prefix) of every row: ``node`` names the set, 0 the empty one, ``place`` the text, ``fp`` is its SimHash, m0... are its parity map, ``wide`` the wide one.

    In one order of all shingles, similar sets have a shingle in common among their prefixes.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, STEP) for at in range(0, batch.num_rows, STEP)):
                node, n, fp, maps, prefix = [], [], [], [], []
                for text in part.column(3).to_pylist():
                    h = word_hashes(text)
                    s = _shingled(h)
                    node.append(xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0)
                    n.append(len(s))
                    fp.append(fingerprint(h))
                    maps.append(parity_map(s))
                    late = common[np.searchsorted(common, s) % len(common)] == s if len(common) else np.zeros(len(s), dtype=bool)
                    s = np.concatenate([s[~late], s[late]])
                    cut = len(s) - -(-LEAST * len(s) // OF) + 1 if len(s) else 0
                    prefix.append(s[:cut])
                nodes, prints = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (node, fp))
                # The narrow map is the wide one folded.
                narrow = np.array([np.bitwise_xor.reduce(m.reshape(-1, MAP), axis=0) for m in maps], dtype=np.int64).reshape(-1, MAP)
                columns = [*(pa.array(c.copy()) for c in narrow.T), _lists(maps), _lists(prefix)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], nodes, pa.array(n, pa.int32()), prints, *columns], ["row", "id", "place", "node", "n", "fp", *MAPS, "wide", "prefix"])
        give_back()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), *_placed(text_col))
    return rows.mapInArrow(sets, f"row long, id long, place long, node long, n int, fp long, {LONGS}, wide array<long>, prefix array<long>")


def _placed(text_col: str) -> list:
    text = F.col(text_col).cast("string")
    return [F.xxhash64(text).alias("place"), text.alias("text")]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(at, STEP) for at in range(0, batch.num_rows, STEP)):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingles(t) for t in part.column(1).to_pylist()])], ["place", "s"])
    give_back()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Columns of whole runs of equal keys of two rows or more, and the length of each row's run; rows come sorted by key."""
    held: list[np.ndarray] | None = None

    def whole(columns: list[np.ndarray]):
        key = columns[0]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.repeat(np.diff(np.r_[start, len(key)]), np.diff(np.r_[start, len(key)]))
        return [c[size >= 2] for c in columns], size[size >= 2]

    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if len(held[0]) and (cut := int(np.searchsorted(held[0], held[0][-1]))):
            yield whole([c[:cut] for c in held])
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield whole(held)


def _possible(n: np.ndarray, at: np.ndarray, maps: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` and ``b`` of a key may be similar if the key is their first in common: by sizes, places and parity maps."""
    both = n[a].astype(np.int64) + n[b]
    need = -(-LEAST * both // (LEAST + OF))
    fine = (n[a] - at[a] >= need) & (n[b] - at[b] >= need)
    apart = sum(np.bitwise_count((m[a] ^ m[b]).view(np.uint64)).astype(np.int64) for m in maps)
    return fine & (both - apart >= 2 * need)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of keys that several sets have."""
    for columns, _ in _runs(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "n", "at"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a key with the next one, of the NEAR after it, that may be similar, if their roots differ; rows come sorted by key and an order."""
    for (key, node, n, at, *maps, root), _ in _runs(batches):
        open_, left, right = np.arange(len(key)), [], []
        for d in range(1, NEAR + 1):
            open_ = open_[open_ + d < len(key)]
            open_ = open_[key[open_] == key[open_ + d]]
            fine = _possible(n, at, maps, open_, open_ + d)
            apart = open_[fine & (root[open_] != root[open_ + d])]
            left.append(node[apart])
            right.append(node[apart + d])
            open_ = open_[~fine]
        pairs = np.unique(np.sort(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])
    give_back()


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a key and group whose roots differ and that may be similar; rows come sorted by key and group."""

    def distinct(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    for (key, node, n, at, *maps, root, group), _ in _runs(batches):
        found, held = [], 0
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]), True])
        for start, stop in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if (root[start:stop] == root[start]).all():
                continue
            step = max(1, TRIED // (stop - start))
            for i in range(start, stop, step):
                a, b = (x.ravel() for x in np.meshgrid(np.arange(i, min(i + step, stop)), np.arange(i + 1, stop), indexing="ij"))
                apart = (a < b) & (root[a] != root[b])
                a, b = a[apart], b[apart]
                fine = _possible(n, at, maps, a, b)
                found.append(np.stack([node[a[fine]], node[b[fine]]], axis=1))
                held += len(found[-1])
                if held >= TRIED:
                    yield distinct(found)
                    found, held = [], 0
        if held:
            yield distinct(found)
    give_back()


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Which of the pairs of nodes (a, b) are similar, by all their shingles, made anew for the texts that need them.

    Wide parity maps leave out most others before. Pairs meet their sets in passes, each of which
    moves about half as many shingles as all sets hold, so that disk stays within the input's size
    however many pairs there are.
    """
    spark, need = pairs.sparkSession, f"{LEAST} * (n_a + n_b)"
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("place").alias(f"place_{x}"), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}"))
    longs = "least(size(wide_a), size(wide_b))"
    fold = lambda x: f"if(size({x}) = {longs}, {x}, transform(sequence(0, {longs} - 1), i -> aggregate(sequence(i, size({x}) - 1, {longs}), 0L, (s, j) -> s ^ {x}[j])))"
    apart = f"aggregate(zip_with({fold('wide_a')}, {fold('wide_b')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{LEAST + OF} * (n_a + n_b - {apart}) >= 2 * {need}")
    near = materialise(near.drop("wide_a", "wide_b"), "near")
    places = materialise(near.select(F.col("place_a").alias("place")).union(near.select("place_b")).distinct(), "near-places")
    full = texts.join(places, "place", "left_semi").dropDuplicates(["place"])
    full = materialise(full.mapInArrow(_whole, "place long, s array<long>"), "near-sets")
    moved, held = near.agg(F.sum("n_a")).first()[0] or 0, nodes.agg(F.sum("n")).first()[0] or 0
    passes = max(1, -(-2 * moved // max(1, held)))
    side = lambda x: full.select(F.col("place").alias(f"place_{x}"), F.col("s").alias(f"s_{x}"))
    out = None
    for i in range(passes):
        some = near.where(F.expr(f"pmod(xxhash64(a, b), {passes}) = {i}"))
        found = some.join(side("a"), "place_a").join(side("b"), "place_b").where(f"{LEAST + OF} * size(array_intersect(s_a, s_b)) >= {need}")
        found = materialise(found.select("a", "b"), "similar")
        release(spark)
        out = found if out is None else out.unionByName(found)
    release(spark, near, places, full)
    return out


def near_fingerprints(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, that join all whose fingerprints ``fp`` are within the distance: each with the first of its own, these by pigeonring."""
    heads = materialise(prints.groupBy("fp").agg(F.min("node").alias("head")), "prints")
    side = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}"))
    across = hamming_links(heads.select("fp")).join(side("a"), "a").join(side("b"), "b").select("head_a", "head_b")
    same = prints.join(heads, "fp").where("node <> head").select("head", "node")
    pairs = across.union(same).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = materialise(pairs.distinct(), "near-prints")
    release(prints.sparkSession, heads)
    return pairs


def similar_links(prefixes: DataFrame, texts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) of similar nodes whose connected components are those of all similar pairs.

    Pairs of near fingerprints are tried first; then, of what these links leave in different
    components, neighbours under a shared prefix key; then all that is still apart under one, so
    that a large group of near copies is never all pairs. A key of more than ``bucket`` rows is
    dealt out in pairs of blocks of about half as many.
    """
    spark = prefixes.sparkSession
    n, columns = shuffle_partitions(spark), ["key", "node", "n", "at", *MAPS, "root"]
    nodes = prefixes.select("node", "place", "n", "wide", *MAPS)
    printed = near_fingerprints(prefixes.select("node", "fp"))
    close = _similar(printed, nodes, texts)
    classes = materialise(connected_components(close, "a", "b"), "print-classes")
    keyed = prefixes.select("node", "n", F.posexplode("prefix").alias("at", "key")).select("key", "node", "n", "at").repartition(n, "key")
    shared = materialise(keyed.sortWithinPartitions("key").mapInArrow(_shared, "key long, node long, n int, at int"), "shared")

    def rooted_by(classes: DataFrame) -> DataFrame:
        known = nodes.select("node", *MAPS).join(classes, "node", "left").withColumn("root", F.coalesce("component", "node"))
        return shared.join(known, "node").select(*columns)

    ordered = rooted_by(classes).repartition(n, "key").sortWithinPartitions("key", F.xxhash64("node", F.expr("key & 3")))
    pairs = materialise(ordered.mapInArrow(_neighbours, "a long, b long").distinct(), "neighbours")
    release(spark, classes)
    first = close.unionByName(_similar(pairs, nodes, texts))
    classes = materialise(connected_components(first, "a", "b"), "first-classes")
    rooted = rooted_by(classes)
    large = materialise(shared.groupBy("key").count().where(F.col("count") > bucket).select("key", F.ceil(F.col("count") / (bucket / 2)).alias("blocks")), "large-keys")
    if large.isEmpty():
        rooted = rooted.withColumn("group", F.lit(0).cast("long"))
    else:
        rooted = rooted.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        rooted = rooted.withColumn("own", F.expr("pmod(xxhash64(node), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        rooted = rooted.withColumn("group", F.expr("least(own, other) * blocks + greatest(own, other)")).drop("blocks", "own", "other")
    crossed = rooted.repartition(n, "key", "group").sortWithinPartitions("key", "group").mapInArrow(_crossed, "a long, b long")
    crossed = materialise(crossed.distinct().join(pairs.union(printed), ["a", "b"], "left_anti"), "crossed")
    release(spark, shared, printed, pairs, classes, large)
    second = _similar(crossed, nodes, texts)
    release(spark, crossed)
    return first.unionByName(second)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, place, node) of every row, and (node, root) of every set, both written; what they came from is released."""
    docs = fields(docs, id_col, text_col)
    sets = materialise(shingle_sets(docs, common_shingles(docs, "f1"), "f0", "f1"), "shingles")
    nodes = materialise(sets.groupBy("node").agg(F.min("row").alias("row")), "nodes")
    prefixes = sets.where("n > 0").drop("id").join(nodes.select("row"), "row", "left_semi")
    prefixes, rows = materialise(prefixes, "prefixes"), materialise(sets.select("id", "place", "node"), "set-rows")
    release(docs.sparkSession, sets)
    links = similar_links(prefixes, docs.select(*_placed("f1")))
    classes = connected_components(links, "a", "b")
    joined = nodes.join(classes, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    rooted = materialise(joined, "rooted")
    release(docs.sparkSession, nodes, prefixes, links)
    return rows, rooted


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row; texts of equal or similar shingles link.

    ``component_id`` is the smallest id reachable. Null and empty texts are one class. Rows with a
    null id keep a row; a class of such rows alone has a null component. Rows and ids may repeat,
    other columns are ignored, an empty table gives no rows.
    """
    rows, rooted = _classes(docs, id_col, text_col)
    least = rows.groupBy("node").agg(F.min("id").alias("least")).join(rooted, "node")
    best = least.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(best, "root").select("node", "component_id"), "node").select(F.col("id").alias("doc_id"), "component_id")


def _seen(plain: DataFrame, own_id: Column, own_place: Column, marked: DataFrame) -> DataFrame:
    """``plain`` with ``may``: false only for rows that are surely not marked, by a map of BITS bits that every task gets.

    Their texts need no shuffle. The more marks, the fuller the map and the more rows may be marked;
    what is marked is for a join to tell.
    """
    bit = lambda *of: F.pmod(F.xxhash64(*of), F.lit(BITS)) + 1  # noqa: E731  buckets and positions count from 1
    placed = marked.select(bit("mark_id", "mark_place").alias("bit")).select(F.bitmap_bucket_number("bit").alias("at"), F.bitmap_bit_position("bit").alias("pos"))
    dealt = placed.repartition(shuffle_partitions(plain.sparkSession), "at")
    maps = dealt.groupBy("at").agg(F.bitmap_construct_agg("pos").alias("bits"))
    rows = plain.withColumn("bit", bit(own_id, own_place)).withColumn("pos", F.bitmap_bit_position("bit"))
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number("bit") == F.col("at"), "left")
    may = F.expr("coalesce(shiftright(cast(conv(hex(substring(bits, cast(pos div 8 as int) + 1, 1)), 16, 10) as int), cast(pos % 8 as int)) & 1, 0) = 1")
    return met.select(*plain.columns, may.alias("may"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each class of ``similar_classes``, with all its columns.

    It is the row of the smallest id, null ids last; of rows that repeat that id, the one whose text
    hashes least; of rows that repeat both, any one. Null and empty texts are one class. Columns may
    have any names; an empty table gives an empty one.
    """
    rows, rooted = _classes(docs, id_col, text_col)
    by_node = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "place")).alias("key")).join(rooted, "node")
    best = by_node.groupBy("root").agg(F.min("key").alias("best"))
    heads = rooted.join(best, "root").select("node", F.col("best.id").alias("head_id"), F.col("best.place").alias("head_place"))
    # What goes, and which kept rows stand more than once; both by (id, hash of text) alone.
    counted = rows.groupBy("id", "place", "node").count().join(heads, "node")
    is_head = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("place") == F.col("head_place"))
    marked = counted.select(F.col("id").alias("mark_id"), F.col("place").alias("mark_place"), is_head.alias("again"), "count").where("not again or count > 1").drop("count")
    marked = materialise(marked, "similar-marks")
    release(docs.sparkSession, rows, rooted)
    plain = numbered(docs)
    own_id = F.col(f"c{place_of(docs, id_col)}").cast("long")
    own_place = F.xxhash64(F.col(f"c{place_of(docs, text_col)}").cast("string"))
    seen = _seen(plain, own_id, own_place, marked)
    joined = seen.where("may").join(marked, own_id.eqNullSafe(F.col("mark_id")) & (own_place == F.col("mark_place")), "left")
    kept = seen.where("not may").select(*plain.columns).unionByName(joined.where("again is null").select(*plain.columns))
    if not marked.where("again").isEmpty():
        repeated = joined.where("again")
        kept = kept.unionByName(repeated.dropDuplicates(["mark_id", "mark_place"]).select(*plain.columns))
    return kept.toDF(*docs.columns)
