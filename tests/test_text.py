import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T

ODD = ["", "  ", "Hello , world !", "I don ' t know", "don ' t won ' t", "a - b - c", "( a ) [ b ]", "(Ab 3:16) (Cd 1 : 2) rest", "mid (1:2) stays", "Straße ﬁne x\x1cy", "ŉ ǰ ΐ և Σ ς İ", "ﷺ", "50 %", "x_y-z's", None]


def test_detokenize(spark):
    rows = spark.createDataFrame([(t,) for t in ["I don ' t know .", "Wait , what ?", "well - known", "( x ) %"]], "t string")
    assert [r[0] for r in rows.select(T.detokenize("t")).collect()] == ["I don't know.", "Wait, what?", "well-known", "(x)%"]


def test_citations(spark):
    rows = spark.createDataFrame([("(Matt. 5:3) Blessed",), ("Blessed (Matt. 5:3) are",), ("(a 1:2) (b 3:4) x",), ("(no digits) x",)], "t string")
    assert [r[0] for r in rows.select(T.strip_citations("t")).collect()] == ["Blessed", "Blessed (Matt. 5:3) are", "x", "(no digits) x"]


def test_normal_forms_against_python(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    got = rows.select(T.nfkc("t").alias("n"), T.casefold("t").alias("c"), T.word_count(F.coalesce("t", F.lit(""))).alias("w"), T.normalize_key("t").alias("k")).collect()
    for t, r in zip(ODD, got, strict=True):
        assert r.n == (None if t is None else unicodedata.normalize("NFKC", t))
        assert r.c == (None if t is None else t.casefold())
        assert r.w == len((t or "").split())
        assert t is None or not re.search(r"[^\w\s'-]|\s\s|^\s|\s$", r.k)


def test_key_is_stable(spark):
    rows = spark.createDataFrame([(t,) for t in ODD if t], "t string").select(T.normalize_key("t").alias("k")).withColumn("kk", T.normalize_key("k"))
    assert all(r.k == r.kk for r in rows.collect())


@pytest.mark.parametrize("text,found", [("My God !", True), ("godless", False), ("PREACHERS", True), ("baptised", True), ("égod", False)])
def test_markers(spark, text, found):
    assert spark.createDataFrame([(text,)], "t string").select(T.domain_marker("t")).first()[0] is found
