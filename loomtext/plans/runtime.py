"""Session helpers: the folder that driver and executors share, and cuts of lineage through it."""

from __future__ import annotations

import gc
import tempfile
import uuid

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only in local mode, where it is unset.

    A cluster must name a folder that all machines share, so an unset one is an error there.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


#: Bytes of an Arrow batch for Python, about; whole texts are long, so that Spark's 10,000 rows or 64 MB are too many.
BATCH = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers BATCH bytes at a time, or less if it is set so; one row at least.

    Spark reads the setting when a plan runs, so it has to hold until lazy results are written. JVM
    and workers both hold a batch, and what malloc took for a large one stays with the executor.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH:
        spark.conf.set(key, str(BATCH))


#: Paths made in the shared folder by this process, by application.
_MADE: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_intermediates(spark: SparkSession) -> int:
    """Deletes what ``fresh_path`` named for this application, once its results are written; returns how many paths there were.

    Tables and files that results still lazily read are among them, so it is for the end of a job.
    """
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing will read again, and lets Spark drop the shuffles of dead plans.

    Spark deletes a shuffle's files once the driver has collected the plan that made it.
    """
    files = {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}
    made = _MADE.get(spark.sparkContext.applicationId, [])
    for p in [p for p in made if any(f.endswith(p.rpartition("/")[2]) for f in files)]:
        _delete(spark, [p])
        made.remove(p)
    gc.collect()
    spark._jvm.java.lang.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint: it survives the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path within it."""
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


def parquet_batches(folder: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a written table's files in order of name, which is the order of its partitions."""
    system, path = filesystem(folder)
    for found in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda x: x.base_name):
        if found.base_name.startswith("part-"):
            yield from pq.ParquetFile(system.open_input_file(found.path)).iter_batches(columns=columns)


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``rows`` with their number in an order, from 0, without a window over all rows.

    Rows are sorted by ranges and written; a range's first number is the sum of the sizes before it,
    a table of one row a range.
    """
    at = materialise(rows.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = at.groupBy(F.shiftright(name, 33).alias("part")).agg(F.count("*").alias("size"))
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))
    joined = at.join(F.broadcast(parts), F.shiftright(name, 33) == F.col("part"))
    return joined.withColumn(name, F.col("ahead") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).select(*rows.columns, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
