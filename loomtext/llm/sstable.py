"""Token-ID shards as sorted string tables, keyed by document identifier.

A shard holds, in ascending key order: blocks, a sparse block index, a Bloom filter and a footer.

* key: 0 for a null id, or 1 and the id as 8 bytes big-endian with its sign bit turned; then 4 bytes
  each of the part that wrote the row and of its number among the part's rows of equal id.
* block, zstd-compressed: entries (varints of the key's shared and own length and the value's
  length, own key bytes, value), then the 4-byte offsets of the restart entries, which share
  nothing, and their number. A value is the token ids, little-endian, 2 or 4 bytes each.
* index: for each block the varint length of its last key, the key, varints of offset and length,
  and the CRC-32 of the stored block.
* filter: over ids alone, so that a document is looked up by its identifier.
* footer of fixed size: offsets and lengths of index and filter, documents, tokens, bytes an id,
  number of hashes, magic.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.columns import fields
from loomtext.llm.files import give_back, new_file, open_file
from loomtext.plans.runtime import bound_batches, fresh_path, materialise, shuffle_partitions

MAGIC = b"LTSSTBL1"
FOOTER = struct.Struct("<QQQQQQBB8s")
BLOCK, RESTART, BITS_PER_KEY, HASHES = 64 << 10, 16, 10, 7
END_ID = 2
#: A shard is closed once it holds so many bytes.
ROLL = 256 << 20
#: A worker keeps the ids of so many words with keys of so many bytes, and room for so many ids a word; others are encoded again.
WORDS, KEY, IDS = 500_000, 24, 8
#: Marks that a tokenizer parts from the letter before them; ids of about so many runs of them are kept.
MARKS, KEPT_MARKS = string.punctuation, 1000
#: What a word may follow, and how a byte-level tokenizer writes it.
SEPARATORS = {" ": "\u0120", "\n": "\u010a"}
#: First bytes of white space in UTF-8, and of other characters.
MAY_BE_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])
#: Texts of so many characters together are encoded at a time, one at least.
TOGETHER = 2 << 20


def head_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def key_of(doc_id: int | None, number: int = 0, part: int = 0) -> bytes:
    return head_of(doc_id) + struct.pack(">II", part, number)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class ShardWriter:
    """Writes entries given in ascending key order; holds one block, the index and 8 bytes an id."""

    def __init__(self, out, width: int, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.at = self.docs = self.tokens = 0
        self.entries, self.restarts, self.count, self.last = bytearray(), [], 0, b""
        self.index, self.hashes = bytearray(), array("Q")

    def add(self, key: bytes, value: bytes) -> None:
        if self.docs and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.count % RESTART:
            shared = len(os.path.commonprefix([key, self.last]))
        else:
            self.restarts.append(len(self.entries))
        self.entries += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if key[:-8] != self.last[:-8] or not self.docs:
            self.hashes.append(xxhash.xxh64_intdigest(key[:-8]))
        self.last = key
        self.count += 1
        self.docs += 1
        self.tokens += len(value) // self.width
        if len(self.entries) >= self.block:
            self._flush()

    def _flush(self) -> None:
        if not self.count:
            return
        raw = bytes(self.entries) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        stored = zstandard.ZstdCompressor(level=1).compress(raw)
        self.index += _varint(len(self.last)) + self.last + _varint(self.at) + _varint(len(stored)) + struct.pack("<I", zlib.crc32(stored))
        self.out.write(stored)
        self.at += len(stored)
        self.entries, self.restarts, self.count = bytearray(), [], 0

    def close(self) -> None:
        self._flush()
        bloom = bloom_filter(np.frombuffer(self.hashes, dtype=np.uint64))
        self.out.write(bytes(self.index))
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, len(self.index), self.at + len(self.index), len(bloom), self.docs, self.tokens, self.width, HASHES, MAGIC))


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def bloom_filter(hashes: np.ndarray) -> bytes:
    bits = max(64, -(-len(hashes) * BITS_PER_KEY // 8) * 8)
    field = np.zeros(bits // 8, dtype=np.uint8)
    for at in range(0, len(hashes), 100_000):
        probes = _probes(hashes[at : at + 100_000], bits).ravel()
        np.bitwise_or.at(field, probes >> np.uint64(3), (1 << (probes & np.uint64(7))).astype(np.uint8))
    return field.tobytes()


class Shard:
    """A shard's reader: ``find`` for an id by filter, index and restart search; iteration block by block."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        end = self.file.size()
        if end < FOOTER.size:
            raise ValueError(f"{uri}: too short for a shard")
        self.file.seek(end - FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.docs, self.tokens, self.width, hashes, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC or hashes != HASHES or bloom_at + bloom_len + FOOTER.size != end:
            raise ValueError(f"{uri}: not a shard, or cut short")
        self.file.seek(index_at)
        raw = self.file.read(index_len)
        self.bloom = np.frombuffer(self.file.read(bloom_len), dtype=np.uint8)
        self.keys, self.blocks, at = [], [], 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.keys.append(raw[at : at + n])
            where, at = _read_varint(raw, at + n)
            length, at = _read_varint(raw, at)
            self.blocks.append((where, length, struct.unpack_from("<I", raw, at)[0]))
            at += 4

    def _block(self, i: int) -> tuple[bytes, int, tuple[int, ...]]:
        where, length, crc = self.blocks[i]
        self.file.seek(where)
        stored = self.file.read(length)
        if zlib.crc32(stored) != crc:
            raise ValueError("a block's checksum differs")
        raw = zstandard.ZstdDecompressor().decompress(stored)
        (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 * (n + 1)
        return raw, end, struct.unpack_from(f"<{n}I", raw, end)

    @staticmethod
    def _entry(raw: bytes, at: int, last: bytes) -> tuple[bytes, int, int, int]:
        shared, at = _read_varint(raw, at)
        own, at = _read_varint(raw, at)
        length, at = _read_varint(raw, at)
        return last[:shared] + raw[at : at + own], at + own, at + own + length, length

    def may_hold(self, doc_id: int | None) -> bool:
        bits = _probes(np.array([xxhash.xxh64_intdigest(head_of(doc_id))], dtype=np.uint64), len(self.bloom) * 8)[0]
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bits.tolist())

    def find(self, doc_id: int | None) -> Iterator[tuple[bytes, np.ndarray]]:
        """(key, token ids) of every row of an id, block by block."""
        head = head_of(doc_id)
        if not self.may_hold(doc_id):
            return
        for i in range(bisect_left(self.keys, head), len(self.keys)):
            raw, end, restarts = self._block(i)
            low, high = 0, len(restarts) - 1
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if self._entry(raw, restarts[mid], b"")[0] < head else (low, mid - 1)
            at, last = restarts[low], b""
            while at < end:
                last, value, at, length = self._entry(raw, at, last)
                if last[: len(head)] > head:
                    return
                if last.startswith(head):
                    yield last, np.frombuffer(raw, f"<u{self.width}", length // self.width, value)

    def get(self, key: bytes) -> np.ndarray | None:
        """The token ids under a whole key."""
        return next((ids for k, ids in self.find(id_of(key)) if k == key), None)

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            raw, end, _ = self._block(i)
            at, last = 0, b""
            while at < end:
                last, value, at, length = self._entry(raw, at, last)
                yield last, np.frombuffer(raw, f"<u{self.width}", length // self.width, value)


class Words:
    """The ids of many short words in flat arrays, found by open addressing: some 50 bytes a word, where a dict takes over 100.

    A key is a word's bytes, filled up with zeros, and a last byte of its length and kind, so equal keys are equal words.
    """

    def __init__(self, most: int, width: int):
        self.most, self.count, self.bits = most, 0, (2 * most - 1).bit_length()
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys = np.empty((most, KEY // 8), dtype="<u8")
        self.bounds, self.ids = np.zeros(most + 1, dtype=np.int64), np.empty(most * IDS * width, dtype=np.uint8)

    @staticmethod
    def keys_of(words: pa.LargeStringArray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Each word's key, and whether the word is short enough to have one."""
        bounds, data = _parts(words)
        sizes = np.diff(bounds)
        padded = np.zeros(len(data) + KEY, dtype=np.uint8)
        padded[:-KEY] = data
        raw = np.lib.stride_tricks.sliding_window_view(padded, KEY)[bounds[:-1]]
        raw *= np.arange(KEY) < sizes[:, None]
        fits = sizes < KEY
        raw[:, -1] = np.where(fits, sizes, 0) + (kind << 7)
        return raw.view("<u8"), fits

    def _first(self, keys: np.ndarray) -> np.ndarray:
        mixed = np.zeros(len(keys), dtype=np.uint64)
        for i in range(keys.shape[1]):
            mixed = (mixed ^ keys[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        return (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's word, or -1."""
        out, rows, at = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), self._first(keys)
        while len(rows):
            seen = self.slots[at]
            rows, at, seen = (x[seen >= 0] for x in (rows, at, seen))
            same = (self.keys[seen] == keys[rows]).all(axis=1)
            out[rows[same]] = seen[same]
            rows, at = rows[~same], at[~same] + 1 & (1 << self.bits) - 1
        return out

    def add(self, keys: np.ndarray, values: pa.LargeBinaryArray) -> None:
        """Words that are not there yet, each once, as far as there is room."""
        bounds, data = _parts(values)
        start = int(self.bounds[self.count])
        n = min(self.most - self.count, len(keys), int(np.searchsorted(bounds, bounds[0] + len(self.ids) - start, "right")) - 1)
        if n <= 0:
            return
        numbers = np.arange(self.count, self.count + n, dtype=np.int32)
        self.keys[numbers] = keys[:n]
        self.bounds[numbers + 1] = bounds[1 : n + 1] - bounds[0] + start
        self.ids[start : self.bounds[self.count + n]] = data[bounds[0] : bounds[n]]
        self.count += n
        at = self._first(keys[:n])
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            left = self.slots[at] != numbers
            numbers, at = numbers[left], at[left] + 1 & (1 << self.bits) - 1

    def values(self) -> pa.LargeBinaryArray:
        """The ids of all words by number."""
        return _binary(self.bounds[: self.count + 1], self.ids)


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of a large string or binary column's values, and the bytes that they bound."""
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, bounds, data = column.buffers()
    return np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1], np.frombuffer(data or b"", dtype=np.uint8)


def _binary(bounds: np.ndarray, data) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])


class PieceEncoder:
    """The tokenizer's ids of whole texts, with the ids of recurring words kept.

    A byte-level tokenizer starts a new word at a space that something other than white space
    follows, so a text's ids are those of its pieces, cut before such spaces. So does it at a line
    break between other characters, and marks after a letter are words of their own. A text that has
    another space next to white space, or a special token, is encoded as one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        # Ids that begin with a space or a line break: in words with no other one, each marks a word's start.
        self.opens = {sep: np.zeros(self.tokenizer.get_vocab_size(), dtype=bool) for sep in SEPARATORS}
        for sep, sign in SEPARATORS.items():
            self.opens[sep][[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(sign)]] = True
        self.known = Words(WORDS, self.width)
        self.ends: dict[int, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        return [np.array(e.ids, dtype=kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, words: list[str], sep: str) -> pa.LargeBinaryArray:
        """The ids of each word after a separator and of that, encoded in one text."""
        (joined,) = self._encode([sep + sep.join(words)])
        starts = np.flatnonzero(self.opens[sep][np.frombuffer(joined, f"<u{self.width}")]) * self.width
        if len(starts) != len(words) or starts[0]:
            return pa.array(self._encode([sep + x for x in words]), pa.large_binary())
        return _binary(np.append(starts, len(joined)), joined)

    def _words(self, words: pa.LargeStringArray, sep: str) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """Ids of words after a separator, as distinct values and each word's place among them."""
        keys, fits = Words.keys_of(words, list(SEPARATORS).index(sep))
        places = self.known.find(keys)
        places[~fits] = -1
        new = np.flatnonzero(places < 0)
        values = self.known.values().take(pa.array(places[places >= 0]))
        places[places >= 0] = np.arange(len(values))
        if len(new):
            coded = words.take(pa.array(new)).dictionary_encode()
            codes = coded.indices.to_numpy()
            fresh = self._fresh(coded.dictionary.to_pylist(), sep)
            example = np.empty(len(fresh), dtype=np.int64)
            example[codes] = new
            short = fits[example]
            self.known.add(keys[example[short]], fresh.filter(pa.array(short)))
            places[new] = len(values) + codes
            values = pa.concat_arrays([values, fresh])
        return values, places

    def _marks(self, marks: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """Ids of runs of marks, each given as the number that its bytes make, as ``_words`` gives them."""
        distinct, places = np.unique(marks, return_inverse=True)
        for x in distinct.tolist():
            if x not in self.ends:
                if len(self.ends) >= KEPT_MARKS + len(distinct):
                    self.ends.clear()
                    return self._marks(marks)
                (self.ends[x],) = self._encode([x.to_bytes(8, "little").rstrip(b"\0").decode()])
        return pa.array([self.ends[x] for x in distinct.tolist()], pa.large_binary()), places

    @staticmethod
    def _stems(pieces: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """Pieces without up to 8 marks at their ends, where these follow a Latin letter and so are words of their own; and the marks, or 0."""
        stems = pc.utf8_rtrim(pieces, characters=MARKS)
        sizes, (bounds, data) = np.diff(_parts(stems)[0]), _parts(pieces)
        cut = np.diff(bounds) - sizes
        ends = bounds[:-1] + sizes
        last, before = data[np.maximum(ends - 1, 0)], data[np.maximum(ends - 2, 0)]
        letter = (last | 32) - np.uint8(97) < 26
        letter |= (last >> 6 == 2) & (before >= 0xC3) & (before <= 0xC9) & ~((before == 0xC3) & ((last == 0x97) | (last == 0xB7)))
        split = (cut > 0) & (cut <= 8) & (sizes > 0) & letter
        marks = np.zeros(len(pieces), dtype=np.uint64)
        for i in range(8):
            more = np.flatnonzero(split & (cut > i))
            marks[more] |= data[ends[more] + i].astype(np.uint64) << np.uint64(8 * i)
        return pc.if_else(pa.array(split), stems, pieces), marks

    def _pieces(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of each piece after a space: those of its words between line breaks, and of the marks at their ends."""
        if not len(pieces):
            return pa.array([], pa.large_binary())
        # The words of a piece, in order: its first after the space, the others after a line break.
        broken = np.flatnonzero(pc.match_substring(pieces, "\n").to_numpy(zero_copy_only=False))
        lines = [x.split("\n") for x in pieces.take(pa.array(broken)).to_pylist()]
        apart = np.array([not any(not x or x[0].isspace() for x in parts) for parts in lines], dtype=bool)
        broken, lines = broken[apart], [parts for parts, a in zip(lines, apart.tolist(), strict=True) if a]
        counts = np.ones(len(pieces), dtype=np.int64)
        counts[broken] = [len(parts) for parts in lines]
        bounds = np.r_[0, np.cumsum(counts)]
        is_first = np.zeros(bounds[-1], dtype=bool)
        is_first[bounds[:-1]] = True
        firsts = pieces
        if lines:
            whole = np.ones(len(pieces), dtype=bool)
            whole[broken] = False
            firsts = pc.replace_with_mask(pieces, pa.array(~whole), pa.array([parts[0] for parts in lines], pa.large_string()))
        stems, marks = self._stems(firsts)
        values, places = self._words(stems, " ")
        # Two values a word: its stem's, and its marks' or the empty one.
        take, ends = np.empty((len(is_first), 2), dtype=np.int64), np.zeros(len(is_first), dtype=np.uint64)
        take[is_first, 0], ends[is_first] = places, marks
        if lines:
            stems, marks = self._stems(pa.array([x for parts in lines for x in parts[1:]], pa.large_string()))
            more, places = self._words(stems, "\n")
            take[~is_first, 0], ends[~is_first] = places + len(values), marks
            values = pa.concat_arrays([values, more])
        more, places = self._marks(ends)
        take[:, 1] = places + len(values)
        joined = pa.concat_arrays([values, more]).take(pa.array(take.ravel()))
        at, data = _parts(joined)
        return _binary(at[2 * bounds], data)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. Arrow splits the texts, numbers their distinct pieces and puts the ids together again."""
        if not texts:
            return []
        column = pa.array([t or "" for t in texts], pa.large_string())
        cut = pc.split_pattern(column, " ")
        flat, at = cut.flatten(), cut.offsets.to_numpy()
        is_head = np.zeros(len(flat), dtype=bool)
        is_head[at[:-1]] = True
        coded = flat.filter(pa.array(~is_head)).dictionary_encode()
        pieces, codes = coded.dictionary, np.zeros(len(flat), dtype=np.int64)
        codes[~is_head] = coded.indices.to_numpy()
        # Texts that are encoded as one: by a special token, or a space before white space or at the end.
        bounds, data = _parts(pieces)
        odd = bounds[:-1] == bounds[1:]
        doubtful = np.flatnonzero(~odd)
        doubtful = doubtful[MAY_BE_SPACE[data[bounds[doubtful]]]]
        odd[doubtful] = [x[0].isspace() for x in pieces.take(pa.array(doubtful)).to_pylist()]
        whole = np.zeros(len(texts), dtype=bool)
        if odd.any():
            inside = np.zeros(len(flat), dtype=bool)
            inside[~is_head] = odd[codes[~is_head]]
            whole = np.add.reduceat(inside, at[:-1]) > 0
        for token in self.special:
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        keep = is_head | ~np.repeat(whole, np.diff(at))
        if whole.any():
            used = np.zeros(len(pieces), dtype=bool)
            used[codes[keep & ~is_head]] = True
            pieces = pieces.filter(pa.array(used))
            codes = (np.cumsum(used) - 1)[codes] if len(used) else codes
        codes[is_head] = len(pieces) + np.arange(len(texts))
        heads = flat.filter(pa.array(is_head)).to_numpy(zero_copy_only=False).tolist()
        starts = dict.fromkeys(x for x, w in zip(heads, whole.tolist(), strict=True) if not w)
        starts = dict(zip(starts, self._encode(list(starts)), strict=True)) if starts else {}
        rest = iter(self._encode([texts[i] for i in np.flatnonzero(whole).tolist()]) if whole.any() else ())
        firsts = [next(rest) if w else starts[x] for x, w in zip(heads, whole.tolist(), strict=True)]
        ids = pa.concat_arrays([self._pieces(pieces), pa.array(firsts, pa.large_binary())])
        joined = ids.take(pa.array(codes[keep]))
        ends = np.frombuffer(joined.buffers()[1], dtype=np.int64, count=len(joined) + 1)
        bounds = ends[np.r_[0, np.cumsum(np.where(whole, 1, np.diff(at)))]].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        return [bytes(data[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


@cache
def encoder(path: str) -> PieceEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts, about TOGETHER characters at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= TOGETHER:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _write(folder: str, tokenizer: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, encode = TaskContext.get().partitionId(), encoder(tokenizer)
    tail = np.array([end_id], dtype=f"<u{encode.width}").tobytes()

    def rows() -> Iterator[tuple[bytes, bytes]]:
        last, number = object(), 0
        for ids, texts in _groups(batches):
            for doc_id, value in zip(ids, encode(texts), strict=True):
                number = number + 1 if doc_id == last else 0
                last = doc_id
                yield key_of(doc_id, number, part), value + tail

    found, shard = rows(), 0
    row = next(found, None)
    while row is not None:
        uri, first = f"{folder}/shard-{part:06d}-{shard:04d}.sst", row[0]
        with new_file(uri) as out:
            writer = ShardWriter(out, encode.width)
            while row is not None and writer.at < ROLL:
                writer.add(*row)
                row = next(found, None)
            writer.close()
        give_back()
        yield pa.RecordBatch.from_pydict({"path": [uri], "first_key": [first], "docs": [writer.docs], "tokens": [writer.tokens]})
        shard += 1


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Manifest (path, first_key, docs, tokens, start) of the shards of all rows in ascending id order.

    Null text is empty, null ids come first, rows of equal id stand in order of a hash of their
    text. Rows are dealt by id, that hash and their place in the scan, so that many rows of one id,
    or many equal rows, spread over parts too; a part closes a shard at ROLL bytes, empty parts
    write none. ``start`` is the number of ids in all shards before. Other columns are ignored, an
    empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = fields(docs, id_col, text_col)
    rows = rows.select(F.col("f0").cast("long").alias("id"), F.coalesce(F.col("f1").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"order": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "id", "order", "place").sortWithinPartitions("id", "order", "place").select("id", "text")
    manifest = dealt.mapInArrow(lambda it: _write(folder, tokenizer, end_id, it), "path string, first_key binary, docs long, tokens long")
    manifest = materialise(manifest, "sst-manifest")
    # One row a shard: few enough for one task.
    before = Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for path, start in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            rows: list[tuple] = []
            for key, ids in Shard(path):
                rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards.

    Each row of ids that are null or repeat has a row; an empty manifest gives none. A shard that is
    cut short, or whose block differs from its checksum, raises.
    """
    paths = manifest.select("path", "start").repartition(shuffle_partitions(manifest.sparkSession), "path")
    return paths.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents' token ids as shards and returns what reads back from them."""
    folder = folder or fresh_path(docs.sparkSession, "sst")
    return read_shards(write_shards(docs, tokenizer, folder, id_col=id_col, text_col=text_col))
