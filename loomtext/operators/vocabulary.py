"""Direction formatting, token arrays, vocabularies and embedding tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loomtext.functions.text import WS
from loomtext.plans.config import require_backend, require_direction


def formatted(source: Column, backend: str, direction: str) -> Column:
    """The source as the backend wants it: a target tag, a prefix, or unchanged."""
    require_backend(backend)
    spec = require_direction(direction)
    if backend == "marian":
        return F.concat(F.lit(spec["tag"] + " "), source)
    return F.concat(F.lit(spec["prefix"]), source) if backend == "byt5" else source


def directed(pairs: DataFrame, backend: str, direction: str) -> DataFrame:
    """(source, target) of a direction."""
    spec = require_direction(direction)
    return pairs.select(formatted(F.col(spec["source_column"]), backend, direction).alias("source"), F.col(spec["target_column"]).alias("target"))


def tokenized(pairs: DataFrame, backend: str, directions: Sequence[str], encode: Callable[[list[str]], list[list[int]]], most: int = 192, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, direction, input_ids, labels): every pair in every direction, formatted, encoded and cut to ``most`` ids.

    One scan gives all directions; ``encode`` gets the texts of an Arrow batch at a time on the
    executors. Null texts have null ids.
    """
    ways = []
    for d in directions:
        spec = require_direction(d)
        ways.append(F.struct(F.lit(d).alias("direction"), formatted(F.col(spec["source_column"]), backend, d).alias("source"), F.col(spec["target_column"]).alias("target")))
    rows = pairs.select(*keep, F.explode(F.array(*ways)).alias("way")).select(*keep, "way.*")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for i in (len(keep) + 1, len(keep) + 2):
                texts = batch.column(i).to_pylist()
                found = iter(encode([t for t in texts if t is not None]))
                columns.append(pa.array([None if t is None else next(found)[:most] for t in texts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], *columns], [*keep, "direction", "input_ids", "labels"])

    schema = rows.select(*keep, "direction").schema.add("input_ids", ArrayType(IntegerType())).add("labels", ArrayType(IntegerType()))
    return rows.mapInArrow(ids, schema)


def truncated(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def shifted_right(labels: Column, start: int, pad: int) -> Column:
    """Decoder inputs: the start id, then the labels but the last, ignored places (-100) as padding."""
    body = F.when(F.size(labels) > 0, F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))))
    kept = F.transform(F.coalesce(body, F.array().cast("array<int>")), lambda x: F.when(x == -100, pad).otherwise(x))
    return F.concat(F.array(F.lit(start)), kept)


def padded(ids: Column, pad: int, multiple: int = 8) -> Column:
    more = F.pmod(-F.size(ids), F.lit(multiple))
    return F.concat(ids, F.array_repeat(F.lit(pad), more.cast("int")))


def character_counts(rows: DataFrame, text: str, least: int = 1) -> DataFrame:
    """(character, n) of all characters but white space that occur ``least`` times."""
    chars = rows.select(F.explode(F.split(F.col(text), "")).alias("character")).where("character <> ''").where(~F.col("character").rlike(f"^{WS}$"))
    return chars.groupBy("character").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def training_lines(rows: DataFrame, text: str) -> DataFrame:
    """Non-blank texts, one a line, for ``write.text``."""
    line = F.regexp_replace(F.col(text), f"^{WS}+|{WS}+$", "")
    return rows.select(line.alias("value")).where("value <> ''")


def merged_vocabulary(base: DataFrame, trained: DataFrame) -> DataFrame:
    """``base`` (piece, score, type) and the normal pieces of ``trained`` it lacks, scored below its lowest score."""
    floor = base.agg(F.min("score").alias("floor"))  # one row
    fresh = trained.where("type = 1").groupBy("piece").agg(F.max("score").alias("score")).join(base.select("piece").distinct(), "piece", "left_anti")
    added = fresh.join(F.broadcast(floor)).select("piece", (F.col("floor") + F.col("score")).alias("score"), F.lit(1).alias("type"), F.lit(True).alias("added"))
    return base.select("piece", "score", F.col("type").cast("int").alias("type"), F.lit(False).alias("added")).unionByName(added)


def remapped_ids(old: DataFrame, new: DataFrame, old_unk: int, new_unk: int) -> DataFrame:
    """(token, old_id, new_id) of tokens that both vocabularies (token, id) know."""
    left, right = old.select("token", F.col("id").alias("old_id")), new.select("token", F.col("id").alias("new_id"))
    return left.where(F.col("old_id") != old_unk).join(right.where(F.col("new_id") != new_unk), "token")


def mean_vectors(vectors: DataFrame, by: str, id_col: str, vector: str) -> DataFrame:
    """(by, vector): mean by component, summed by component on the map side and put together in order."""
    cells = vectors.where(F.col(id_col).isNotNull()).select(by, F.posexplode(vector).alias("at", "x"))
    means = cells.groupBy(by, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("cells"))
    return packed.select(by, F.transform("cells", lambda c: c["x"]).alias("vector"))


def warm_started(vectors: DataFrame, decompositions: DataFrame, unk: int) -> DataFrame:
    """(token, vector) for new tokens: the mean of their old pieces' vectors, or the unknown token's if none is known.

    ``vectors`` (id, vector) and ``decompositions`` (token, ids).
    """
    pieces = decompositions.select("token", F.explode_outer("ids").alias("id")).join(vectors.select("id", F.lit(True).alias("known")), "id", "left")
    usable = pieces.where("known").select("token", "id")
    rest = decompositions.select("token").distinct().join(usable.select("token").distinct(), "token", "left_anti").withColumn("id", F.lit(unk).cast("long"))
    return mean_vectors(usable.unionByName(rest).join(vectors, "id"), "token", "id", "vector")
