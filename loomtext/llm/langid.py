"""Language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.columns import fields, numbered, place_of

#: Letters fall in LETTERS classes (0 is a word's edge): a to z have one each, others share the rest by a hash.
LETTERS, DIMENSIONS, SEED = 128, 512, 7
#: Each worker keeps the vectors of so many n-grams; others are bound anew.
KEPT = 1 << 15
#: Scores are a softmax of cosines times this.
SHARPNESS = 40.0
UNKNOWN = "und"
#: The cosine of fewer trigrams is small whatever the language, so that it rejects nothing.
TELLING = 32


@cache
def _classes() -> np.ndarray:
    """Class of each code point's lower-case letter; 0 for what is no letter."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = ord(chr(c).lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low * 40503 % 65521 % (LETTERS - 27)
    return out


class Space:
    """Random letter vectors of +1 and -1; an n-gram binds its letters' vectors, each permuted by its place."""

    def __init__(self) -> None:
        letters = np.random.default_rng(SEED).integers(0, 2, (LETTERS, DIMENSIONS), dtype=np.int8) * 2 - 1
        self.places = [np.roll(letters, shift, axis=1).astype(np.float32) for shift in (2, 1, 0)]
        self.row = np.full(LETTERS**3, -1, dtype=np.int32)
        self.kept = np.empty((KEPT, DIMENSIONS), dtype=np.float32)
        self.used = 0

    def bind(self, grams: np.ndarray) -> np.ndarray:
        a, b, c = self.places
        return a[grams // LETTERS**2] * b[grams // LETTERS % LETTERS] * c[grams % LETTERS]

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        """The sum of the vectors of n-grams, repeats included."""
        rows = self.row[grams]
        if self.used < KEPT and len(rows) and rows.min() < 0:
            new = np.unique(grams[rows < 0])[: KEPT - self.used]
            self.row[new] = np.arange(self.used, self.used + len(new))
            self.kept[self.used : self.used + len(new)] = self.bind(new)
            self.used += len(new)
            rows = self.row[grams]
        counts = np.bincount(rows[rows >= 0], minlength=1)
        known = np.flatnonzero(counts)
        out = (counts[known].astype(np.float32) @ self.kept[known]).astype(np.float64)
        if len(rest := grams[rows < 0]):
            rest, times = np.unique(rest, return_counts=True)
            for at in range(0, len(rest), 4096):
                out += times[at : at + 4096].astype(np.float32) @ self.bind(rest[at : at + 4096])
        return out


@cache
def space() -> Space:
    return Space()


def ngrams(text: str | None) -> np.ndarray:
    """The letter trigrams of a whole text; runs of other characters are one edge. Empty without letters."""
    if not text:
        return np.empty(0, np.int32)
    m = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    m = np.concatenate([[0], m, [0]]).astype(np.int32)
    m = m[np.concatenate([[True], (m[1:] | m[:-1]) > 0])]
    if len(m) < 3:
        return np.empty(0, np.int32)
    return m[:-2] * LETTERS**2 + m[1:-1] * LETTERS + m[2:]


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    waiting: dict[str, list[np.ndarray]] = {}

    def bundle() -> None:
        for lang, grams in waiting.items():
            sums[lang] = sums.get(lang, 0) + space().bundle(np.concatenate(grams))
        waiting.clear()

    for batch in batches:
        held = 0
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            grams = ngrams(text)
            if len(grams):
                waiting.setdefault(lang, []).append(grams)
                held += len(grams)
            if held > 4_000_000:  # so many n-grams are bundled at a time; a float32 holds such a sum exactly
                bundle()
                held = 0
        bundle()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "profile"])


@dataclass
class Prototypes:
    """Learned languages in order of name, and their unit vectors."""

    names: list[str]
    vectors: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1 and cosine; ``und`` with 0 for no letters or nothing learned. Ties go to the first name."""
        grams = ngrams(text)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0, 0.0
        v = space().bundle(grams)
        cosines = self.vectors @ v / max(float(np.linalg.norm(v)), 1e-12)
        best = int(np.argmax(cosines))
        return self.names[best], float(1 / np.exp(SHARPNESS * (cosines - cosines[best])).sum()), float(cosines[best])


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Prototypes:
    """Bundles every row with a language into its language's prototype.

    Each partition sums its own and the sums meet by language and dimension, so only
    languages x dimensions numbers reach the driver. Null languages and texts without letters teach nothing.
    """
    rows = fields(docs, text_col, lang_col).where("f1 is not null").select(F.col("f0").cast("string").alias("text"), F.col("f1").cast("string").alias("lang"))
    sums = rows.mapInArrow(_learn, "lang string, profile array<double>").select("lang", F.posexplode("profile").alias("at", "x"))
    found: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang", "at").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["at"]] = r["x"]
    names = sorted(found)
    vectors = np.array([found[n] / max(float(np.linalg.norm(found[n])), 1e-12) for n in names]).reshape(-1, DIMENSIONS)
    return Prototypes(names, vectors)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that teach nothing: CRC-32 of the id as text leaves 2 by 4. A null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, prototypes: Prototypes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cosine) of every row of ``docs``, from its text alone."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prototypes.predict(t) for t in batch.column(2).to_pylist()]
            columns = [pa.array(x, k) for x, k in zip(zip(*found, strict=True) if found else [[]] * 3, (pa.string(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "cosine"])

    rows = fields(docs, id_col, text_col).select(F.col("f0").cast("long").alias("doc_id"), held_out("f0").alias("held_out"), F.col("f1").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, cosine double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and identifies all rows.

    Null texts and texts without letters are ``und`` with score 0, as is everything if nothing could
    be learned. Rows and ids may repeat or be null; an empty table gives no rows.
    """
    return identify(docs, _taught(docs, id_col, text_col, lang_col), id_col, text_col)


def _taught(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Prototypes:
    """Prototypes of the rows that are not held out; rows without an id teach nothing."""
    rows = fields(docs, id_col, text_col, lang_col)
    return learn_prototypes(rows.where(F.col("f0").isNotNull() & ~held_out("f0")), "f1", "f2")


def reject_unidentified(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not ``und`` and whose best cosine is ``least`` or more, if they have TELLING trigrams.

    So null and empty texts and those without letters go, as does everything if nothing could be
    learned. Rows that repeat or have a null id are decided each by its text, other columns stay
    whatever their names, and an empty table gives an empty one.
    """
    prototypes = _taught(docs, id_col, text_col, lang_col)

    @F.udf("boolean", useArrow=True)
    def kept(text: str | None) -> bool:
        name, _, cosine = prototypes.predict(text)
        return name != UNKNOWN and (cosine >= least or len(ngrams(text)) < TELLING)

    return numbered(docs).where(kept(F.col(f"c{place_of(docs, text_col)}").cast("string"))).toDF(*docs.columns)
