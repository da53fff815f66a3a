"""Words of Arrow text batches as numpy arrays: positions and 64-bit hashes, computed on UTF-8 bytes.

A word class given by a regular expression over ASCII is decided byte by byte (every byte of a non-ASCII character is a
word byte), so a batch is split, lower-cased (A-Z only) and hashed without a Python loop. Work arrays cover about a
megabyte of text at a time, or one document where that is longer."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: word bytes after lower-casing: 0-9, a-z and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: everything but blank and \t \n \v \f \r
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

CHUNK_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNMULT = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, kept for the next batch."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offset of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]: at[-1]], at - at[0]


class Words:
    """Words of some texts. `start`/`end`: byte positions; `hash`: one per word; `first`: index of each text's first
    word (one entry more than texts); `data`: the lower-cased bytes; `offsets`: bytes where each text begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, hashed: bool = True):
        self.data, self.offsets = LOWER[data], offsets
        inside = is_word[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        if hashed:
            self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODES[self.data] * _power(_MULT, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * _power(_UNMULT, n)[self.start] + (self.end - self.start).astype(np.uint64))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of n words inside one text."""
        if len(self.start) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = np.repeat(self.first[1:], self.counts)[: len(self.start) - n + 1]
        at = np.arange(len(self.start) - n + 1)
        fits = at + n <= last
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * _MULT + self.hash[k: len(at) + k]
        return at[fits], mix(h[fits] + np.uint64(n))

    def normal(self, word: int, n: int) -> bytes:
        """n words from this one on, joined by one blank."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[word: word + n], self.end[word: word + n]))


def small_batches(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of about CHUNK_BYTES of text each; a longer text comes alone and whole."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1)
            yield batch.slice(lo, hi - lo), data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
            lo = hi


def map_words(text: str, is_word: np.ndarray, fn: Callable[[pa.RecordBatch, Words], pa.RecordBatch], hashed: bool = True):
    """A function for mapInArrow that hands `fn` each small batch with its words."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in small_batches(batches, text):
            yield fn(rows, Words(data, offsets, is_word, hashed))
    return run


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted inside it, with the index of each text's first one.

    A text of fewer words than `size`, but some, has its whole word sequence as the only shingle."""
    at, h = words.windows(size)
    doc = np.searchsorted(words.first, at, side="right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        extra = np.array([_sequence_hash(words.hash[words.first[i]: words.first[i + 1]]) for i in short], np.uint64)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, extra])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[keep], h[keep]
    return h, np.searchsorted(doc, np.arange(len(words.counts) + 1))


def _sequence_hash(hashes: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for x in hashes:
        h = h * _MULT + x
    return mix(h + np.uint64(len(hashes)))[0]


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, type=kind))
