"""Licence scans: Aho-Corasick over a text's words, and SPDX expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.columns import fields

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notice phrases of the method's own, each with its label and how surely it means a licence.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "gnu general public license version 2": ("gpl-2.0", 0.95),
    "gnu general public license version 3": ("gpl-3.0", 0.95),
    "apache license version 2 0": ("apache-2.0", 0.95),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd 2 clause": ("bsd-2-clause", 0.9),
    "bsd 3 clause": ("bsd-3-clause", 0.9),
    "isc license": ("isc", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0 1 0 universal": ("cc0-1.0", 0.9),
    "creative commons zero": ("cc0", 0.9),
    "released into the public domain": ("public-domain", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "all rights reserved": ("all-rights-reserved", 0.6),
}
TAG = "spdx license identifier"
# Licences that a permissive use may rely on, for the evaluation of expressions; families by prefix.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "cc0", "cc-by-1", "cc-by-2", "cc-by-3", "cc-by-4", "unlicense", "zlib", "0bsd", "public-domain")

#: Bytes that part words become spaces, A-Z become a-z; other bytes, those of non-ASCII letters included, stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_EXPRESSION = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[ \t]*(?:(\()|(\))|([A-Za-z0-9][A-Za-z0-9.+:-]*))")


def parse_expression(text: str) -> list[str] | None:
    """The expression at the start of ``text`` in postfix order, by shunting-yard; None if there is none.

    WITH binds closer than AND, AND closer than OR; operators count in any case. WITH joins one
    licence's name and one exception's, never a group. What follows the longest well-formed
    beginning (a comment's end, a word, a WITH of something else) is left out. Linear in the text.
    """
    rank = {"or": 1, "and": 2, "with": 3}
    out: list[str] = []
    ops: list[str] = []
    best: tuple[int, list[str]] | None = None
    at, open_, last = 0, 0, "operator"
    while m := _TOKEN.match(text, at):
        at = m.end()
        word = (m[3] or "").lower().rstrip(".:-")
        if m[1] and last == "operator":
            ops.append("(")
            open_ += 1
            continue
        if m[2] and last in ("name", "exception", "group") and open_:
            while (op := ops.pop()) != "(":
                out.append(op)
            open_, last = open_ - 1, "group"
        elif word and word not in rank and last in ("operator", "with"):
            out.append(word)
            last = "exception" if last == "with" else "name"
        elif word in rank and (last == "name" if word == "with" else last in ("name", "exception", "group")):
            while ops and ops[-1] != "(" and rank[ops[-1]] >= rank[word]:
                out.append(ops.pop())
            ops.append(word)
            last = "with" if word == "with" else "operator"
            continue
        else:
            break
        if not open_:
            best = len(out), ops[::-1]  # three operators at most, as each binds closer than the one below it
    return None if best is None else out[: best[0]] + best[1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """The licences that an expression names, and whether it allows a permissive choice.

    OR needs one permissive side, AND both; WITH adds an exception to the licence before it, so an
    expression never has more names than words.
    """
    stack: list[tuple[set[str], bool]] = []
    for word in postfix:
        if word in ("or", "and", "with"):
            if len(stack) < 2:
                raise ValueError("malformed expression")
            (b, free_b), (a, free_a) = stack.pop(), stack.pop()
            if word == "with":
                if len(a) != 1 or len(b) != 1:
                    raise ValueError("WITH joins a licence and an exception")
                stack.append(({f"{min(a)}-with-{min(b)}"}, free_a))
            else:
                few, many = (a, b) if len(a) < len(b) else (b, a)
                many |= few
                stack.append((many, free_a or free_b if word == "or" else free_a and free_b))
        else:
            stack.append(({word}, word.startswith(PERMISSIVE)))
    if len(stack) != 1:
        raise ValueError("malformed expression")
    return stack[0]


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, bool | None, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, permissive, score of a whole text.

    ``permissive`` tells whether all its tags' expressions allow a permissive choice; null without one.
    """
    words = (text or "").encode("utf-8").translate(_TABLE).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base: set[str] = set()
    own: set[str] = set()
    n, first, last, score, tagged = 0, None, None, 0.0, False
    at = place = 0
    for end, phrase in _automaton().iter(line):
        tagged = tagged or phrase == TAG
        if phrase in NOTICES:
            own.add(NOTICES[phrase][0])
            score = max(score, NOTICES[phrase][1])
        if phrase in BASE:
            # Its last word's number; spaces are counted once from left to right, as ends ascend.
            place += line.count(" ", at, end)
            at = end
            start = place - len(phrase.split())
            base.add(BASE[phrase])
            n += 1
            first, last = start if first is None else min(first, start), start if last is None else max(last, start)
            score = max(score, 0.7)
    permissive = None
    if tagged:
        for m in _EXPRESSION.finditer(text):
            if (postfix := parse_expression(m[1])) is not None:
                names, free = evaluate(postfix)
                own |= names
                permissive = free if permissive is None else permissive and free
                score = 1.0
    return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | own)), permissive, score


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "permissive", "score"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.bool_(), pa.float64()]
    for batch in batches:
        rows = [(d, *scan(t)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its words, places of base phrases, labels and score.

    Null text is empty: no words, null places, empty labels, score 0. Rows and ids may repeat or be
    null; other columns are ignored; an empty table gives no rows.
    """
    rows = fields(docs, id_col, text_col).select(F.col("f0").cast("long").alias("doc_id"), F.col("f1").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, permissive boolean, score double")
