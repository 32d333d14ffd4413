"""What the shards' encoder hands to the tokenizer, and that ids stay those of whole texts."""

import itertools
import random
import string

import numpy as np
import pytest

from loomtext.llm import sstable
from loomtext.llm.queries import tokenizer_path
from loomtext.plans.runtime import BATCH


@pytest.fixture
def encoder(monkeypatch):
    """An encoder of its own, and the number of characters that each call gave the tokenizer."""
    made, sent = sstable.PieceEncoder(tokenizer_path()), []
    encode = made._encode
    monkeypatch.setattr(made, "_encode", lambda texts: sent.append(sum(map(len, texts))) or encode(texts))
    return made, sent


def plain(encoder, text):
    return np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u2").tobytes()


def test_known_words_are_not_encoded_again(encoder):
    encode, sent = encoder
    words = ["".join(x) for x in itertools.islice(itertools.product(string.ascii_lowercase, repeat=4), 300_000)]
    assert encode(["x " + " ".join(words)]) == [plain(encode, "x " + " ".join(words))] and sum(sent) > 1_000_000
    sent.clear()
    again = "x " + " ".join(w + ("", ",", "***")[i % 3] for i, w in enumerate(reversed(words)))
    assert encode([again]) == [plain(encode, again)] and sum(sent) < 100


def test_words_between_line_breaks_are_known(encoder):
    encode, sent = encoder
    rows = random.Random(0)
    words = ["".join(rows.choices(string.ascii_letters + "éü", k=9)) for _ in range(2_000)]
    encode(["x " + " ".join(words), "x " + "\n".join(words), "x ." + " .".join("\n" + w for w in words)])
    sent.clear()
    again = "x " + " ".join(f"{a}.\n{b}" for a, b in zip(rows.sample(words, 2_000), rows.sample(words, 2_000), strict=True))
    assert encode([again]) == [plain(encode, again)] and sum(sent) < 100


@pytest.mark.parametrize(("most", "room", "runs"), [(sstable.WORDS, sstable.IDS, sstable.KEPT_MARKS), (100, 2, 5)])
def test_ids_are_those_of_whole_texts(monkeypatch, most, room, runs):
    for name, value in {"WORDS": most, "IDS": room, "KEPT_MARKS": runs}.items():
        monkeypatch.setattr(sstable, name, value)
    encode, rows = sstable.PieceEncoder(tokenizer_path()), random.Random(1)
    words = ["a", "Word", "don't", "été", "×", "÷", "ª", "ɐ", "слово", "漢字", "😀", "é", "42", "a1", ".", "'", "''", "***", "###", "_", "<|", "!!!!!!!!", "!!!!!!!!!"]
    words += ["<|endoftext|>", "\x00", "a\x00", "\u0085", "\x1c", "　", "​", "Ġ", "Ċ", "'re", "q" * 22, "q" * 23, "q" * 24, "é" * 11, "é" * 12]
    breaks = [" "] * 12 + ["\n"] * 6
    odd = breaks + ["", "  ", "\n\n", " \n", "\n ", "\t", "\r\n", "\t\n", "\n\t", "\t "]
    for _ in range(300):
        between = rows.choice((breaks, odd))
        texts = ["".join(rows.choice(words) + rows.choice(between) for _ in range(rows.choice((0, 1, 3, 30)))) for _ in range(20)]
        texts = [None, *(x.strip(" \n") if rows.random() < 0.7 else x for x in texts)]
        for text, ids in zip(texts, encode(texts), strict=True):
            assert ids == plain(encode, text), text


def test_workers_get_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(64 << 20))
    try:
        sstable.token_shards(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), tokenizer_path())
        assert int(spark.conf.get(key)) == BATCH
    finally:
        spark.conf.set(key, before)
