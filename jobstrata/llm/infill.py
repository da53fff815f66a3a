"""Fill-in-middle: texts are cut into prefix, middle and suffix at unit borders found by rank queries on a wavelet matrix.

Every code point has a class (letter, digit, white space, other) and a bit that tells whether it goes on with the class of
the one before it in its text. The symbols of a batch of texts make one wavelet matrix. A unit is a run of a class that
runs, else a single code point; so the units that begin in a stretch are its code points less the continuing ones of the
running classes, which are ranks. Both cuts of all texts are located together by bisection on these counts."""
from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobstrata.llm.words import small_batches

LETTER, DIGIT, SPACE, OTHER = range(4)
SYMBOL_BITS = 3
SCHEMA = "id long, n long, form string, prefix_chars long, middle_chars long, output string"

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[[32, 9, 10, 11, 12, 13]] = SPACE


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class _Bits:
    """Bits with the number of ones before every word of 64, so that a rank reads one word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Small symbols, one level of bits from the highest down; each level moves the ones behind the zeros."""

    def __init__(self, symbols: np.ndarray, bits: int = SYMBOL_BITS):
        self.levels = []
        for b in reversed(range(bits)):
            ones = (symbols >> b & 1).astype(bool)
            self.levels.append((b, _Bits(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each place."""
        lo, hi = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for b, level in self.levels:
            one_lo, one_hi = level.rank(lo), level.rank(hi)
            lo, hi = (level.zeros + one_lo, level.zeros + one_hi) if symbol >> b & 1 else (lo - one_lo, hi - one_hi)
        return hi - lo


class Units:
    """Units of the texts of a batch. `counts`: of each text; `chars`: code points of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, runs: tuple[int, ...]):
        self.place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte at which each code point begins
        self.first = np.searchsorted(self.place, offsets)
        self.chars = np.diff(self.first)
        kind = _CLASS[data[self.place[:-1]]] if len(data) else np.zeros(0, np.uint8)
        goes_on = np.append(False, kind[1:] == kind[:-1])[: len(kind)]
        goes_on[self.first[:-1][self.chars > 0]] = False
        self.matrix, self.runs = WaveletMatrix(kind * 2 + goes_on), runs
        self.counts = self.begun(self.first[1:]) - self.begun(self.first[:-1])

    def begun(self, at: np.ndarray) -> np.ndarray:
        """Units that begin before each place."""
        return at - sum(self.matrix.rank(kind * 2 + 1, at) for kind in self.runs)

    def after(self, units: np.ndarray) -> np.ndarray:
        """Code points of the first so many units of each text, by bisection: the place where the next unit begins."""
        lo, hi = self.first[:-1].copy(), self.first[1:].copy()
        wanted = self.begun(lo) + units
        while (lo < hi).any():
            mid = (lo + hi) // 2
            passed = (self.begun(mid + 1) > wanted) & (lo < hi)
            hi = np.where(passed, mid, hi)
            lo = np.where(~passed & (lo < hi), mid + 1, lo)
        return lo - self.first[:-1]


def draws(seed: str, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 that depend on the seed and the id only; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k: k + 8], 16) for k in range(0, 32, 8)]


def _checked(sentinels: Sentinels) -> Sentinels:
    for s in sentinels:
        if not s or any(s[:k] == s[-k:] for k in range(1, len(s))) or sum(s in t for t in sentinels) > 1:
            raise ValueError("sentinels have to differ, none inside another, and none may end as it begins")
    return sentinels


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_percent: int = 10, spm_percent: int = 20,
           runs: tuple[int, ...] = (LETTER,), sentinels: Sentinels = Sentinels()) -> DataFrame:
    """Per row: id, n (units), form, prefix_chars, middle_chars (code points), output.

    The prefix ends and the middle ends after a number of units drawn from 0 to n, the smaller first. Form is `plain` (the
    text as it is, null lengths) for empty texts, texts that hold a sentinel and `plain_percent` of the others; `spm` for
    `spm_percent` of what is left, else `psm`. A null text is empty; a null id draws as an empty one; rows that repeat an id
    draw alike, and each has a row. Whole texts, however long, are one row of a batch of their own."""
    p, s, m = (x.encode() for x in _checked(sentinels))

    def run(batches):
        for rows, data, offsets in small_batches(batches, "text"):
            ids = rows.column("id").to_pylist()
            units = Units(data, offsets, runs)
            h = np.array([draws(seed, i) for i in ids], np.int64).reshape(-1, 4)
            ends = np.sort(h[:, :2] % (units.counts + 1)[:, None], axis=1)
            a, b = units.after(ends[:, 0]), units.after(ends[:, 1])
            byte = lambda at: units.place[units.first[:-1] + at]
            form, out = [], []
            for k, (lo, x, y, hi) in enumerate(zip(offsets, byte(a), byte(b), offsets[1:])):
                text = data[lo:hi].tobytes()
                if not text or h[k, 2] % 100 >= 100 - plain_percent or p in text or s in text or m in text:
                    form.append("plain")
                    out.append(text)
                    continue
                head, mid, tail = text[: x - lo], text[x - lo: y - lo], text[y - lo:]
                form.append("spm" if h[k, 3] % 100 < spm_percent else "psm")
                out.append(s + tail + p + head + m + mid if form[-1] == "spm" else p + head + s + tail + m + mid)
            plain = np.array([f == "plain" for f in form], bool)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(units.counts), pa.array(form, pa.string()), pa.array(a, mask=plain), pa.array(b - a, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                                             names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    one = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return one.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text from which an output of this form was made."""
    p, s, m = _checked(sentinels)
    chars = lambda c: F.char_length(c)
    after = lambda c, n: c.substr(n + 1, chars(c))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = after(output, F.lit(len(first)))
        x = F.substring_index(rest, second, 1)
        rest = after(rest, chars(x) + len(second))
        y = F.substring_index(rest, m, 1)
        return x, y, after(rest, chars(y) + len(m))

    head, tail, mid = parts(p, s)
    of_psm = F.concat(head, mid, tail)
    tail, head, mid = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", of_psm).otherwise(F.concat(head, mid, tail))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    out = infill(docs, id_col, text_col)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select(id_col, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


DIGEST_SQL = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, [CAST('0x' || h[8 * k + 1 : 8 * k + 8] AS UBIGINT) FOR k IN range(4)] AS h_ FROM u),
c AS (SELECT *, least(h_[1] % (n + 1), h_[2] % (n + 1)) AS a, greatest(h_[1] % (n + 1), h_[2] % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h_[3] % 100 >= 90 THEN 'plain' WHEN h_[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
