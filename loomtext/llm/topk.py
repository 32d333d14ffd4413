"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.columns import fields
from loomtext.llm.files import files_in, new_file, open_file
from loomtext.plans.runtime import fresh_path, materialise, shuffle_partitions

#: Vectors of a block, blocks scored together, and queries of a file.
BLOCK, TOGETHER, QUERIES = 256, 256, 8192
#: Sums of products up to this are exact in doubles.
EXACT = 1 << 53
#: A task remembers the k-th scores of so many queries from one group of blocks to the next.
REMEMBERED = 8 << 20
#: Bytes of queries that a worker keeps.
KEPT = 64 << 20


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v, n): floor(scale * x) of each component, and how many rows are the same.

    Rows whose vector is null or holds null or non-finite components take no part.
    """
    rows = fields(vectors, id_col, vector_col).select(F.col("f0").cast("long").alias("vec_id"), F.transform("f1", lambda y: y.cast("double")).alias("x"))
    rows = rows.where("x is not null").where(F.forall("x", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))))
    return rows.groupBy("vec_id", F.transform("x", lambda y: F.floor(y * scale)).alias("v")).agg(F.count("*").alias("n"))


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, whether they are null, counts and vectors, ``size`` rows at a time."""
    rows: tuple[list, list, list] = [], [], []
    pack = lambda ids, v, n: (np.array([x or 0 for x in ids], dtype=np.int64), np.array([x is None for x in ids]), np.array(n, dtype=np.int64), _matrix(v, max(map(len, v))))
    for batch in batches:
        for kept, column in zip(rows, batch.columns, strict=True):
            kept += column.to_pylist()
        while len(rows[0]) >= size:
            yield pack(*(x[:size] for x in rows))
            rows = tuple(x[size:] for x in rows)
    if rows[0]:
        yield pack(*rows)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["width", "ids", "none", "counts", "vectors", "low", "high"]
    for ids, none, counts, m in _packed(batches, BLOCK):
        parts = (ids, none, counts, m, m.min(axis=0), m.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), *(pa.array([x.tobytes()]) for x in parts)], names)


def block_index(vectors: DataFrame) -> DataFrame:
    """Blocks of consecutive ids: ids, row counts, forward index and each component's least and greatest value."""
    dealt = vectors.select("vec_id", "v", "n").repartitionByRange(shuffle_partitions(vectors.sparkSession), "vec_id", F.xxhash64("v")).sortWithinPartitions("vec_id", "v")
    return materialise(dealt.mapInArrow(_blocks, "width int, ids binary, none binary, counts binary, vectors binary, low binary, high binary"), "topk-blocks")


def write_queries(queries: DataFrame, folder: str, chunk: int) -> None:
    """Files of ``chunk`` queries at most, each an array of (id, count, vector); together they hold every query once."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (ids, _, counts, m) in enumerate(_packed(batches, chunk)):
            name, content = f"queries-{part:06d}-{number:06d}.npy", io.BytesIO()
            np.save(content, np.concatenate([ids[:, None], counts[:, None], m], axis=1))
            with new_file(f"{folder}/{name}") as out:
                out.write(content.getvalue())
            yield pa.RecordBatch.from_pydict({"file": [name], "rows": [len(ids)]})

    # In order of id, so that a task that is tried again writes the same files.
    dealt = queries.repartitionByRange(shuffle_partitions(queries.sparkSession), "vec_id", F.xxhash64("v")).sortWithinPartitions("vec_id", "v")
    materialise(dealt.mapInArrow(write, "file string, rows long"), "topk-queries")


def _chunks(folder: str, chunk: int) -> Iterator[np.ndarray]:
    """The arrays of the query files, small ones put together up to ``chunk`` rows; the same ones in every task."""
    held: list[np.ndarray] = []
    join = lambda parts: np.concatenate([_fit(x, max(y.shape[1] for y in parts)) for x in parts])
    for uri in files_in(folder, ".npy"):
        with open_file(uri) as file:
            found = np.load(io.BytesIO(file.read()))
        if held and sum(map(len, held)) + len(found) > chunk:
            yield join(held)
            held = []
        held.append(found)
    if held:
        yield join(held)


class Queries:
    """All chunks of queries, one at a time; a worker keeps them if they take KEPT bytes at most, and reads them again otherwise."""

    def __init__(self, folder: str, chunk: int):
        self.folder, self.chunk = folder, chunk
        self.kept: list[np.ndarray] | None = None

    def __iter__(self) -> Iterator[np.ndarray]:
        if self.kept is not None:
            yield from self.kept
            return
        kept, size = [], 0
        for found in _chunks(self.folder, self.chunk):
            size += found.nbytes
            kept = [*kept, found] if size <= KEPT else []
            yield found
        self.kept = kept if size <= KEPT else None


@lru_cache(maxsize=1)
def _queries(folder: str, chunk: int) -> Queries:
    return Queries(folder, chunk)


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    """The matrix with ``width`` columns; what a vector lacks is zero."""
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products, within a long's range."""
    if not a.size or not b.size or a.shape[1] * float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Search:
    """The best k candidates of each query so far: ids, scores and row counts by (score down, id up, null ids last).

    ``kth`` holds each query's k-th score, or a lower bound of it from elsewhere; what is below it is left out.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, counts: np.ndarray, k: int, kth: np.ndarray | None = None):
        self.ids, self.vectors, self.counts, self.k = ids, vectors, counts, k
        self.q = self.id = self.score = self.n = np.empty(0, dtype=np.int64)
        self.none = np.empty(0, dtype=bool)
        self.kth = np.full(len(ids), -(1 << 63), dtype=np.int64) if kth is None else kth
        self.scored = 0

    def add(self, q: np.ndarray, ids: np.ndarray, none: np.ndarray, score: np.ndarray, n: np.ndarray) -> None:
        q, ids, none, score, n = (np.concatenate(x) for x in ((self.q, q), (self.id, ids), (self.none, none), (self.score, score), (self.n, n)))
        order = np.lexsort((ids, none, ~score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[place < self.k]
        last = place == self.k - 1
        self.kth[q[last]] = np.maximum(self.kth[q[last]], score[order[last]])
        self.q, self.id, self.none, self.score, self.n = q[place < self.k], ids[keep], none[keep], score[keep], n[keep]

    def blocks(self, rows: list[dict]) -> None:
        """Scores blocks, each query's by falling bound, until the bounds are below its k-th score."""
        width = max(self.vectors.shape[1], *(r["width"] for r in rows))
        queries = _fit(self.vectors, width)
        read = lambda r, name: _fit(np.frombuffer(r[name], dtype=np.int64).reshape(-1, r["width"]), width)
        low, high = (np.concatenate([read(r, name) for r in rows]) for name in ("low", "high"))
        bound = _dot(np.maximum(queries, 0), high) + _dot(np.minimum(queries, 0), low)
        order = np.argsort(-bound, axis=1, kind="stable")
        for rank in range(len(rows)):
            at = order[:, rank]
            live = np.flatnonzero(bound[np.arange(len(at)), at] >= self.kth)
            if not len(live):
                break
            found = []
            for b in np.unique(at[live]).tolist():
                some = live[at[live] == b]
                vectors = read(rows[b], "vectors")
                ids, counts = (np.frombuffer(rows[b][x], dtype=np.int64) for x in ("ids", "counts"))
                none = np.frombuffer(rows[b]["none"], dtype=bool)
                score = _dot(queries[some], vectors)
                self.scored += score.size
                i, j = np.nonzero(score >= self.kth[some][:, None])
                q, n = some[i], counts[j].copy()
                mine = (ids[j] == self.ids[q]) & ~none[j]
                if mine.any():  # a query is no candidate of itself; rows that repeat it are
                    mine[mine] = (vectors[j[mine]] == queries[q[mine]]).all(axis=1)
                    n[mine] -= 1
                keep = n > 0
                found.append((q[keep], ids[j][keep], none[j][keep], score[i, j][keep], n[keep]))
            self.add(*map(np.concatenate, zip(*found, strict=True)))


def _searched(folder: str, chunk: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query's best k of every group of TOGETHER blocks, but what an earlier group's k-th score rules out."""
    kth: dict[int, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            rows = batch.slice(at, TOGETHER).to_pylist()
            for number, found in enumerate(_queries(folder, chunk)):
                ids, counts, vectors = found[:, 0], found[:, 1], found[:, 2:]
                search = Search(ids, vectors, counts, k, kth.pop(number, None))
                search.blocks(rows)
                if sum(map(len, kth.values())) + len(ids) <= REMEMBERED:
                    kth[number] = search.kth
                for start in range(0, len(search.q), 10_000):
                    part = slice(start, start + 10_000)
                    q = search.q[part]
                    columns = [np.full(len(q), number), q, ids[q], counts[q], search.n[part], search.score[part]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(search.id[part], mask=search.none[part])], ["chunk", "q", "query_id", "copies", "n", "score", "vec_id"])


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, chunk: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to smaller ids, null ids last.

    Queries are all rows whose id ``every`` divides; candidates all rows but the query's own, those
    with a null id too. Queries are written to files of ``chunk`` at most in the shared folder, and
    each task reads them one after another against its blocks, so that the driver holds none; what
    a group of blocks keeps for a query meets in one window of k rows a group. Shorter vectors count
    as filled with zeros, scores stop at a long's limits. Rows that repeat id and vector are
    candidates of each other and give the query's rows once each. Other columns are ignored, an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialise(quantised(vectors, id_col, vector_col, scale), "topk-vectors")
    blocks, folder = block_index(rows), fresh_path(spark, "topk-query-files")
    write_queries(rows.where(F.col("vec_id") % every == 0), folder, chunk)
    out = blocks.mapInArrow(lambda it: _searched(folder, chunk, k, it), "chunk long, q long, query_id long, copies long, n long, score long, vec_id long")
    best = F.desc("score"), F.asc_nulls_last("vec_id")
    order = Window.partitionBy("chunk", "q")
    out = out.withColumn("place", F.row_number().over(order.orderBy(*best))).where(F.col("place") <= k)
    # Rows that repeat a candidate take a place each.
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))))
    out = out.withColumn("rank", F.row_number().over(order.orderBy(*best, "copy"))).where(F.col("rank") <= k)
    return out.withColumn("same", F.explode(F.expr("sequence(1L, copies)"))).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS own
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, q.own, c.vec_id,
             CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.own <> c.own),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
