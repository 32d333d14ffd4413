"""Additive per-row statistics of BLEU, chrF++ and TER, from their published definitions."""

from __future__ import annotations

import re
import string
from collections import Counter

# Orders, weight of recall, and the bounds of the shift search.
BLEU_ORDER, CHAR_ORDER, WORD_ORDER, BETA = 4, 6, 2, 2
SHIFT_WORDS, SHIFT_DISTANCE = 10, 50
#: Widths of the statistics: matches and totals by order and both lengths; counts by order; edits and length.
WIDTHS = {"sacrebleu": 2 * BLEU_ORDER + 2, "chrf_plus_plus": 3 * (CHAR_ORDER + WORD_ORDER), "ter": 2}

# Fixed patterns of the 13a tokenization, in their order.
_STEPS = (
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
)
_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_EDGES = frozenset(string.punctuation)


def tokens_13a(text: str) -> list[str]:
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in text:
        for entity, char in _ENTITIES:
            text = text.replace(entity, char)
    text = f" {text} "
    for pattern, put in _STEPS:
        text = pattern.sub(put, text)
    return text.split()


def _grams(items, n: int) -> Counter:
    return Counter(items[i : i + n] for i in range(len(items) - n + 1))


def bleu_stats(hypothesis: str, reference: str) -> list[int]:
    h, r = tuple(tokens_13a(hypothesis)), tuple(tokens_13a(reference))
    matches = [(_grams(h, n) & _grams(r, n)).total() for n in range(1, BLEU_ORDER + 1)]
    return [*matches, *(max(0, len(h) - n + 1) for n in range(1, BLEU_ORDER + 1)), len(h), len(r)]


def _edge_words(text: str) -> tuple[str, ...]:
    """Words with one mark at an end split off: a last one first, else a first one."""
    out: list[str] = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _EDGES:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _EDGES:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return tuple(out)


def chrf_stats(hypothesis: str, reference: str) -> list[int]:
    out: list[int] = []
    for cut, order in ((lambda t: "".join(t.split()), CHAR_ORDER), (_edge_words, WORD_ORDER)):
        h, r = cut(hypothesis), cut(reference)
        for n in range(1, order + 1):
            a, b = _grams(h, n), _grams(r, n)
            out += [a.total(), b.total(), (a & b).total()]
    return out


def _edits(h: list[str], r: list[str]) -> list[list[int]]:
    table = [list(range(len(r) + 1))]
    for i, x in enumerate(h, 1):
        row, above = [i], table[-1]
        for j, y in enumerate(r, 1):
            row.append(min(above[j - 1] + (x != y), above[j] + 1, row[-1] + 1))
        table.append(row)
    return table


def _aligned(table: list[list[int]], h: list[str], r: list[str]) -> list[tuple[int, int, bool]]:
    """The path from the start to the end: (words of h used, words of r used, whether they match)."""
    i, j, path = len(h), len(r), []
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (h[i - 1] != r[j - 1]):
            i, j = i - 1, j - 1
            path.append((i, j, h[i] == r[j]))
        elif i and table[i][j] == table[i - 1][j] + 1:
            i -= 1
            path.append((i, -1, False))
        else:
            j -= 1
            path.append((-1, j, False))
    return path[::-1]


def ter_stats(hypothesis: str, reference: str) -> list[int]:
    """Edits and reference words: greedy block shifts, each the one that saves most, then insertions, deletions and substitutions."""
    h, r = hypothesis.lower().split(), reference.lower().split()
    if not r:
        return [len(h), 0]
    shifts = 0
    where: dict[str, list[int]] = {}
    for j, w in enumerate(r):
        where.setdefault(w, []).append(j)
    while h:
        table = _edits(h, r)
        best_cost = table[-1][-1]
        if best_cost <= 1:
            break
        path = _aligned(table, h, r)
        right_h = {i for i, _, ok in path if ok}
        right_r = {j for _, j, ok in path if ok}
        place, seen = {}, 0  # position in h that a word of r falls on
        for i, j, _ in path:
            if j >= 0:
                place[j] = seen
            seen += i >= 0
        best: list[str] | None = None
        for i in range(len(h)):
            for j in where.get(h[i], ()):
                if abs(i - j) > SHIFT_DISTANCE:
                    continue
                n = 0
                while n < SHIFT_WORDS and i + n < len(h) and j + n < len(r) and h[i + n] == r[j + n]:
                    n += 1
                    if all(x in right_h for x in range(i, i + n)) or all(x in right_r for x in range(j, j + n)):
                        continue
                    rest = h[:i] + h[i + n :]
                    at = place[j] if place[j] <= i else max(i, place[j] - n)
                    moved = rest[:at] + h[i : i + n] + rest[at:]
                    if moved != h and (cost := _edits(moved, r)[-1][-1]) + 1 < best_cost:
                        best, best_cost = moved, cost + 1
        if best is None:
            break
        h, shifts = best, shifts + 1
    return [shifts + _edits(h, r)[-1][-1], len(r)]


STATS = {"sacrebleu": bleu_stats, "chrf_plus_plus": chrf_stats, "ter": ter_stats}
