"""Inputs that once took a worker down, or past its time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomtext.llm import langid, license, mixing, pii, quality


@pytest.fixture(autouse=True)
def clock():
    start = time.monotonic()
    yield
    assert time.monotonic() - start < 60


def test_licence_names_never_multiply():
    text = " WITH ".join(f"(a{i} OR b{i})" for i in range(30))
    assert license.evaluate(license.parse_expression(text)) == ({"a0", "b0"}, False)
    assert license.parse_expression("a WITH b WITH c") == ["a", "b", "with"]
    assert license.parse_expression("a WITH (b)") == ["a"] and license.parse_expression("(a) WITH b") == ["a"]
    assert license.evaluate(license.parse_expression("(a WITH b OR MIT) AND c")) == ({"a-with-b", "mit", "c"}, False)
    many = "SPDX-License-Identifier: " + " OR ".join(f"x{i}" for i in range(50_000))
    assert len(license.scan(many)[5].split(",")) == 50_000
    assert license.scan("SPDX-License-Identifier: " + "(" * 200_000)[7] == 0.0


def test_runs_of_marks_are_linear():
    for text in ("-" * 1_000_000 + "1", "_%" * 300_000 + "@", "1-" * 30_000, "a." * 200_000 + "@", "x@" + "a." * 200_000 + "1"):
        assert pii.find_values(text, b"k" * 16) == []
    mixed = "." + "-" * 50 + "joe@example.org"
    assert [x[2] for x in pii.find_values(mixed, b"k")] == ["email"]


def test_values_before_other_groups_and_unassigned_phones():
    key = b"k"
    card = "4539 1488 0343 6467"
    for rest in ("", " 124", "-12", " 1"):
        found = pii.find_values(f"pay {card}{rest} now", key)
        assert [(x[0], x[1], x[2]) for x in found] == [(4, 4 + len(card), "card")]
    assert [x[2] for x in pii.find_values("GB29 NWBK 6016 1331 9268 19 ABC", key)] == ["iban"]
    (phone,) = pii.find_values("+1 (017) 555-7713", key)
    assert phone[2] == "phone" and phone[3] != "+1 (017) 555-7713" and pii._unassigned("".join(c for c in phone[3] if c.isdigit())[1:])
    assert pii.find_values("_%@x.com", key) == []


def test_keys(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for f in (pii.pseudonyms, pii.pseudonymise_texts):
        with pytest.raises(ValueError):
            f(df, b"")
    assert pii.feistel(b"a" * 65, "t", 5, 10**9) != pii.feistel(b"a" * 64 + b"b", "t", 5, 10**9)


def test_rows_of_one_id_teach_once(spark):
    r = random.Random(1)
    rows = [(7, " ".join(r.choices(["aa", "bb"], k=5)), "x") for _ in range(500)] + [(i, "cc dd", "x") for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    seen, whole = [], quality.fit
    quality.fit = lambda p, u: seen.append((len(p), len(u))) or whole(p, u)
    try:
        assert quality.score_quality(docs, labels).count() == len(rows)
    finally:
        quality.fit = whole
    assert seen[0][0] == 1 and seen[0][1] <= 40


def test_columns_of_any_name_stay(spark):
    names = "doc_id long, text string, lang string, source string, `a.b` string, copies string, h string, place string"
    rows = [(1, "bana kolo", "aa", "s", "p", "q", "r", "t"), (None, None, None, None, "p", "q", "r", "t"), (2, "mail joe@example.org", "aa", None, "p", "q", "r", "t")]
    df = spark.createDataFrame(rows, names)
    for out in (mixing.repeat_documents(df), pii.pseudonymise_texts(df, b"k"), langid.reject_unidentified(df, 0.0)):
        assert out.columns == df.columns
        for row in out.collect():
            assert row[4:] == ("p", "q", "r", "t")
    for f in (mixing.repeat_documents, lambda x: pii.pseudonymise_texts(x, b"k"), lambda x: langid.reject_unidentified(x, 0.0)):
        assert f(df.where(F.lit(False))).collect() == []
