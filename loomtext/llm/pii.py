"""Format-preserving pseudonyms of validated numbers and dates by a keyed Feistel permutation."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from datetime import date, timedelta
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.columns import fields, numbered, place_of

ROUNDS = 10
DAY_ONE, DAYS = date(1900, 1, 1), 73_049  # to 2099-12-31
#: For tests and the registered query; a deployment passes a key of its own.
DEMO_KEY = b"demonstration key, not a secret"


@cache
def whole_key(key: bytes) -> bytes:
    """The key as BLAKE2 takes it: longer ones are hashed, none is cut; an empty one is an error."""
    if not key:
        raise ValueError("pseudonyms take a key")
    return key if len(key) <= 64 else hashlib.blake2b(key).digest()


def feistel(key: bytes, kind: str, value: int, size: int) -> int:
    """A keyed permutation of 0..size-1, another for each kind and size: a balanced Feistel network walked until it is inside."""
    if size < 2:
        return value
    key = whole_key(key)
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    prefix = f"{kind}|{size}|".encode()
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            seed = prefix + bytes([r]) + right.to_bytes(width, "big")
            f = int.from_bytes(hashlib.blake2b(seed, digest_size=max(8, width), key=key).digest(), "big") & mask
            left, right = right, left ^ f
        value = left << half | right
        if value < size:
            return value


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in turn."""
    fresh = iter(digits)
    return "".join(next(fresh) if c.isdigit() else c for c in shape)


def luhn_digit(digits: str) -> str:
    total = sum(d if i % 2 else d // 5 * (2 * d - 9) + (1 - d // 5) * 2 * d for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _card(key: bytes, found: str) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    n = len(digits) - 1
    body = str(feistel(key, "card", int(digits[:-1]), 10**n)).zfill(n)
    return _refill(found, body + luhn_digit(body))


def _unassigned(ten: str) -> bool:
    """Whether area or exchange code begins with 0 or 1."""
    return ten[0] in "01" or ten[3] in "01"


def _phone(key: bytes, found: str) -> str | None:
    digits = re.sub(r"\D", "", found)
    if found.startswith("+") and not digits.startswith("1"):
        if not 8 <= len(digits) <= 15:
            return None
        n = len(digits) - 2
        return _refill(found, digits[:2] + str(feistel(key, "phone" + digits[:2], int(digits[2:]), 10**n)).zfill(n))
    head, ten = digits[:-10], digits[-10:]
    if len(ten) != 10 or head not in ("", "1"):
        return None
    if _unassigned(ten):  # numbers that no exchange gives out are permuted among themselves
        value = feistel(key, "phone-", int(ten), 10**10)
        while not _unassigned(f"{value:010d}"):
            value = feistel(key, "phone-", value, 10**10)
        return _refill(found, f"{head}{value:010d}")
    value = ((int(ten[:3]) - 200) * 800 + int(ten[3:6]) - 200) * 10_000 + int(ten[6:])
    value = feistel(key, "phone", value, 800 * 800 * 10_000)
    return _refill(found, head + f"{value // 8_000_000 + 200}{value // 10_000 % 800 + 200}{value % 10_000:04d}")


def _ssn(key: bytes, found: str) -> str | None:
    a, b, c = found.split("-")
    areas = [x for x in range(1, 900) if x != 666]
    if int(a) not in areas or b == "00" or c == "0000":
        return None
    value = feistel(key, "ssn", (areas.index(int(a)) * 99 + int(b) - 1) * 9999 + int(c) - 1, len(areas) * 99 * 9999)
    return f"{areas[value // (99 * 9999)]:03d}-{value // 9999 % 99 + 1:02d}-{value % 9999 + 1:04d}"


def _ip(key: bytes, found: str) -> str | None:
    try:
        value = int(ipaddress.IPv4Address(found))
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(feistel(key, "ip", value, 1 << 32)))


def _iban(key: bytes, found: str) -> str | None:
    flat = found.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    size, value = 1, 0
    for c in flat[4:]:
        base, x = (10, int(c)) if c.isdigit() else (26, ord(c) - 65)
        size, value = size * base, value * base + x
    value = feistel(key, "iban" + re.sub("[A-Z]", "A", re.sub(r"\d", "0", flat[4:])) + flat[:2], value, size)
    body = ""
    for c in reversed(flat[4:]):
        base = 10 if c.isdigit() else 26
        body, value = (str(value % 10) if c.isdigit() else chr(65 + value % 26)) + body, value // base
    flat = flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body
    fresh = iter(flat)
    return "".join(c if c == " " else next(fresh) for c in found)


def _date(key: bytes, found: str) -> str | None:
    parts = re.split(r"([-/.])", found)
    mark = parts[1]
    year_first = len(parts[0]) == 4
    try:
        # Day first, unless only month first makes a date; the order found is kept.
        y, m, d = (int(parts[i]) for i in ((0, 2, 4) if year_first else (4, 2, 0)))
        swap = not year_first and m > 12
        day = date(y, d if swap else m, m if swap else d)
    except ValueError:
        return None
    at = (day - DAY_ONE).days
    if not 0 <= at < DAYS:
        return None
    new = DAY_ONE + timedelta(feistel(key, "date", at, DAYS))
    y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    return mark.join((y, m, d) if year_first else (m, d, y) if swap else (d, m, y))


def _email(key: bytes, found: str) -> str | None:
    """The local part keeps its length, cases and marks; its letters and digits are permuted as one number. The host stays.

    A local part without a letter or digit names nobody and is no value.
    """
    local, _, host = found.rpartition("@")
    if not any(c.isalnum() for c in local):
        return None
    shape = re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", local)))
    size, value = 1, 0
    for c in local:
        base, x = (26, ord(c) - 97) if "a" <= c <= "z" else (26, ord(c) - 65) if "A" <= c <= "Z" else (10, ord(c) - 48) if c.isdigit() else (1, 0)
        size, value = size * base, value * base + x
    value = feistel(key, "email" + shape, value, size)
    out = ""
    for c in reversed(local):
        base, first = (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (10, "0") if c.isdigit() else (1, c)
        out, value = chr(ord(first) + value % base) + out, value // base
    return f"{out}@{host}"


def _hex(key: bytes, found: str) -> str | None:
    if found.isdigit() or found.isalpha():
        return None
    value = f"{feistel(key, 'hex', int(found, 16), 16 ** len(found)):0{len(found)}x}"
    return value.upper() if found.upper() == found else value


# Fixed patterns; the first kind that validates takes the text it covers.
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    ("hex", r"(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})(?![0-9A-Za-z])", _hex),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ip", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])", _ip),
    ("date", r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9])", _date),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])", _ssn),
    ("card", r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", _card),
    ("phone", r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{8,15}(?![0-9])", _phone),
)
_START = re.compile("|".join(f"(?P<{k}>(?<![A-Za-z0-9._%+@-]){p})" if k == "email" else f"(?P<{k}>(?<![A-Za-z0-9]){p})" for k, p, _ in KINDS))
_PATTERNS = [(k, re.compile(p), f) for k, p, f in KINDS]
_MAYBE = re.compile(r"[0-9@]")


#: Kinds written in groups, and their least letters and digits.
LEAST = {"card": 13, "iban": 15}


def _shorter(kind: str, found: str) -> Iterator[str]:
    """The text found and, for groups of digits, its beginnings that end before a separator, longest first."""
    yield found
    if kind in LEAST:
        left = sum(c.isalnum() for c in found)
        for i in range(len(found) - 1, 0, -1):
            if found[i] not in " -":
                left -= 1
            elif left < LEAST[kind]:
                return
            else:
                yield found[:i]


def find_values(text: str | None, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of each validated value in a whole text, in order and apart from each other.

    Where a pattern covers a value and more groups after it, the longest beginning that validates
    counts. Every pattern but an e-mail's local part and host is of bounded length, and these start
    at one place of a run alone, so that the time is linear in the text.
    """
    if not text or not _MAYBE.search(text):
        return []
    out, at = [], 0
    while m := _START.search(text, at):
        at = m.start() + 1
        before = text[m.start() - 1] if m.start() else " "
        for kind, pattern, change in _PATTERNS:
            if before.isalnum() or kind == "email" and before in "._%+@-" or not (hit := pattern.match(text, m.start())):
                continue
            if new := next(((len(x), y) for x in _shorter(kind, hit[0]) if (y := change(key, x)) is not None), None):
                out.append((m.start(), m.start() + new[0], kind, new[1]))
                at = m.start() + new[0]
                break
    return out


def pseudonymise(text: str | None, key: bytes) -> str | None:
    """The text with each validated value replaced; null stays null."""
    out, at = [], 0
    for start, end, _, new in find_values(text, key):
        out += [text[at:start], new]
        at = end
    return text if not out else "".join(out) + text[at:]


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, kind, pseudonym) of every value found in the whole texts of ``docs``.

    The same value gets the same pseudonym in every document, whatever separators it is written
    with, and no two values of one format share one. Places count code points. Rows repeat with
    their document; null and empty texts have none; ids may be null; an empty table gives no rows.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in find_values(t, key)]
            if found:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], ["doc_id", "start", "end", "kind", "pseudonym"])

    whole_key(key)
    rows = fields(docs, id_col, text_col).select(F.col("f0").cast("long").alias("doc_id"), F.col("f1").cast("string").alias("text"))
    return rows.mapInArrow(find, "doc_id long, start long, end long, kind string, pseudonym string")


def pseudonymise_texts(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with every validated value of its texts replaced.

    Every row stays, repeated ones alike; null and empty texts stay as they are, and so do all other
    columns, whatever their names. An empty table gives an empty one.
    """
    whole_key(key)
    change = F.udf(lambda t: pseudonymise(t, key), "string", useArrow=True)
    plain, text = numbered(docs), f"c{place_of(docs, text_col)}"
    return plain.withColumn(text, change(F.col(text).cast("string"))).toDF(*docs.columns)
