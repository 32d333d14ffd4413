"""Text rules as Column expressions; Python only for NFKC and case folding, over Arrow batches."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Character classes under which Java's patterns see what Unicode-aware ones see.
WS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
# The parts of a contraction that are rejoined, and the words that mark the domain.
CONTRACTIONS = "s|t|re|ve|ll|d|m"
MARKERS = "jehovah|bible|jesus|christ|christian|god|apostle|congregation|ministry|scripture|kingdom|worship|baptis{w}*|disciple|preach{w}*|prayer|resurrection|satan"
# Which punctuation attaches to the text before or after it.
CLOSING, FLAGGED = ",.;:!?%", ",.;:!?"

# Both name their text once: a native path beside Python's for plain strings would name it three times,
# and Catalyst writes out whole chains of patterns for each, which costs far more than an Arrow batch.
_nfkc = F.udf(lambda s: None if s is None else unicodedata.normalize("NFKC", s), StringType(), useArrow=True)
_carried = F.udf(lambda s: None if s is None else (s, unicodedata.normalize("NFKC", s)), StructType([StructField("text", StringType()), StructField("nfkc", StringType())]), useArrow=True)
_fold = F.udf(lambda s: None if s is None else s.casefold(), StringType(), useArrow=True)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nfkc(x: Column | str) -> Column:
    """NFKC."""
    return _nfkc(_col(x))


def casefold(x: Column | str) -> Column:
    """Full case folding."""
    return _fold(_col(x))


def strip(x: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_col(x), f"^{WS}+|{WS}+$", "")


def collapse(x: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(x), f"{WS}+", " "))


def carried(x: Column | str) -> Column:
    """A struct of the text and its NFKC: a step in Python, so that the text's patterns are not written out for each use."""
    return _carried(_col(x))


def detokenize(x: Column | str) -> Column:
    """Undoes spacing round punctuation, brackets, contractions and hyphens, in NFKC; null stays null."""
    return attach(nfkc(x))


def attach(x: Column | str) -> Column:
    """The same for a text that is in NFKC. No step after the first leaves a run of spaces or one at an end."""
    t = collapse(x)
    t = F.regexp_replace(t, f"{WS}+([{CLOSING}])", "$1")
    t = F.regexp_replace(t, rf"([({{\[]){WS}+", "$1")
    t = F.regexp_replace(t, rf"{WS}+([)}}\]])", "$1")
    t = F.regexp_replace(t, rf"(?i)(?<!{WORD})([a-z]+){WS}+'{WS}*({CONTRACTIONS})(?!{WORD})", "$1'$2")
    return F.regexp_replace(t, rf"(?<={WORD}){WS}+-{WS}+(?={WORD})", "-")


def strip_citations(x: Column | str) -> Column:
    """Without parenthetical chapter-and-verse citations at the start; later ones stay."""
    cited = rf"\((?=[^)]{{0,100}}{DIGIT}+{WS}*:{WS}*{DIGIT}+)[^)]{{1,120}}\)"
    return strip(F.regexp_replace(_col(x), rf"^{WS}*(?:{cited}{WS}*)+", ""))


def fold_key(x: Column | str) -> Column:
    """The key of a detokenized text: folded, only word characters, spaces, ' and -."""
    return collapse(F.regexp_replace(casefold(x), rf"[^\p{{L}}\p{{N}}_\s\p{{Z}}\x0B\x1C-\x1F\x85'-]", " "))


def normalize_key(x: Column | str) -> Column:
    """The key under which texts count as equal."""
    return fold_key(detokenize(x))


def with_key(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with a key of a text under each name."""
    return df.withColumns({k: normalize_key(c) for k, c in columns.items()})


def word_count(x: Column | str) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(_col(x), f"{WS}+"), lambda t: t != ""))


def example_id(eng_key: Column | str, wes_key: Column | str) -> Column:
    """16 hex digits of the SHA-256 of both keys."""
    return F.substring(F.sha2(F.concat(_col(eng_key), F.char(F.lit(0)), _col(wes_key)), 256), 1, 16)


def domain_marker(x: Column | str) -> Column:
    """Whether one of the domain's words stands in the text."""
    return _col(x).rlike(rf"(?iu)(?<!{WORD})(?:{MARKERS.format(w=WORD)})(?!{WORD})")


def spaced_punctuation(x: Column | str) -> Column:
    return _col(x).rlike(f"{WS}[{FLAGGED}]")


def leading_parenthesis(x: Column | str) -> Column:
    return _col(x).rlike(rf"^{WS}*\(")


def bucket_score(x: Column) -> Column:
    """First 64 bits of the SHA-256 as a number from 0 to 1."""
    return F.conv(F.substring(F.sha2(x, 256), 1, 16), 16, 10).cast("double") / F.lit(float(2**64 - 1))


def split_name(score: Column, validation_ratio: float, test_ratio: float) -> Column:
    return F.when(score < test_ratio, "test").when(score < test_ratio + validation_ratio, "validation").otherwise("train")
