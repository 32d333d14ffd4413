"""SimHash near-duplicates: fingerprints linked by pigeonring-filtered Hamming search."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.columns import fields
from loomtext.llm.hamming import BUCKET, STEP, hamming_links, majority, ones_of  # noqa: F401
from loomtext.llm.shingles import drop_similar
from loomtext.operators.components import connected_components
from loomtext.plans.runtime import checkpoint, materialise

SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of a whole text, unsigned; 0 for null or no words.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles of ``shingle``
    words count with repeats, and fewer words make one shingle. A bit is set if it is in more than
    half the XXH64 hashes.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    first, last = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        part = map(joined.__getitem__, map(slice, first[at : at + STEP], last[at : at + STEP]))
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), dtype=np.uint64, count=min(STEP, n - at))
        ones += ones_of(h)
    return majority(ones, n)


def _fingerprints(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[str | None, int] = {}
        out = []
        for text in batch.column(1).to_pylist():
            if text not in seen:
                seen[text] = fingerprint(text, shingle)
            out.append(seen[text])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], ["id", "fp"])


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) of every row; ``fp`` holds the 64 bits as a signed long."""
    rows = fields(docs, id_col, text_col).select(F.col("f0").cast("long").alias("id"), F.col("f1").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(shingle, it), "id long, fp long")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints link at 4 differing bits or fewer, equal ones always; ``component_id`` is the
    smallest id reachable. Null and empty texts have fingerprint 0 and link like any other. Rows
    with a null id keep a row; a class of such rows alone has a null component. Repeated rows are
    kept, an empty table gives no rows and other columns are ignored.
    """
    prints = materialise(simhash_fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    classes = connected_components(hamming_links(distinct.select("fp")), "a", "b")
    joined = distinct.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    joined = checkpoint(joined.select("fp", "least", "root"))
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    members = joined.join(best, "root").select("fp", "component_id")
    return prints.join(members, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each class of near-duplicates: that of the smallest id, null ids last.

    Classes are of texts whose five-word shingles have a Jaccard similarity of 0.8 or more. SimHash
    fingerprints within 4 bits are found by pigeonring and checked by all shingles; prefix keys then
    bring the similar pairs that are further apart (``drop_similar`` says which of rows that repeat
    an id stays, and what holds for nulls, repeats and empty tables).
    """
    return drop_similar(docs, id_col, text_col)
