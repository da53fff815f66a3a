"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scans the windows of training texts.

Windows of the benchmark go into a sorted hash array; every document window is looked up in it, and each hit is verified
on its words before it counts. An index of more than `block` windows is broadcast block by block, so what an executor
holds has a fixed bound whatever the benchmark's size."""
from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobstrata.llm.words import ALNUM, Words, map_words, small_batches
from jobstrata.session import cut_lineage

BLOCK = 1 << 19
_STATE = "_dc_items"
_SPANS = "_dc_spans"


def benchmark_windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window: n_words, window (its words), h (its hash), items (ids of the items that have it).

    An item of fewer than n words, but some, is one window; null and empty texts have none. A null id is left out of the list."""
    def cut(batches):
        for rows, data, offsets in small_batches(batches, "_t"):
            w, ids = Words(data, offsets, ALNUM), rows.column("_i").to_pylist()
            out = []
            for size in {n} | set(int(c) for c in w.counts if 0 < c < n):
                at, h = w.windows(size)
                doc = np.searchsorted(w.first, at, side="right") - 1
                whole = np.ones(len(at), bool) if size == n else w.counts[doc] == size
                out += [(size, w.normal(a, size), x, ids[d]) for a, x, d in zip(at[whole], h[whole].astype(np.int64), doc[whole])]
            yield pa.RecordBatch.from_pydict({"n_words": pa.array([o[0] for o in out], pa.int32()), "window": pa.array([o[1] for o in out], pa.binary()),
                                              "h": pa.array([int(o[2]) for o in out], pa.int64()), "item": pa.array([o[3] for o in out], pa.int64())})

    one = items.select(F.col(id_col).cast("long").alias("_i"), F.col(text_col).alias("_t"))
    rows = one.mapInArrow(cut, "n_words int, window binary, h long, item long")
    return rows.groupBy("n_words", "window", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))


class _Index:
    """Windows of one block: hashes sorted for lookup, words for the check."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: r["h"] & 0xFFFFFFFFFFFFFFFF)
        self.hash = np.array([r["h"] & 0xFFFFFFFFFFFFFFFF for r in rows], np.uint64)
        self.sizes = sorted({r["n_words"] for r in rows})
        self.rows = [(r["n_words"], bytes(r["window"]), list(r["items"])) for r in rows]
        self.seen = np.zeros(1 << 22, bool)  # a first sieve on 22 bits of the hash
        self.seen[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, w: Words):
        """(word, number of words, items) of every verified window."""
        for size in self.sizes:
            at, h = w.windows(size)
            maybe = self.seen[(h >> np.uint64(42)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            for a, i, j in zip(at[lo < hi], lo[lo < hi], hi[lo < hi]):
                words = w.normal(a, size)
                for k in range(i, j):
                    if self.rows[k][0] == size and self.rows[k][1] == words:
                        yield int(a), size, self.rows[k][2]


def _scan(index, text_col: str):
    def fn(rows: pa.RecordBatch, w: Words) -> pa.RecordBatch:
        docs = [[] for _ in range(rows.num_rows)]
        for a, size, items in index.value.hits(w):
            d = int(np.searchsorted(w.first, a, side="right") - 1)
            docs[d].append((a - int(w.first[d]), size, items))
        spans, found = [], []
        for d, (old, items) in enumerate(zip(rows.column(_SPANS).to_pylist(), rows.column(_STATE).to_pylist())):
            marked = list(struct.iter_unpack("<qq", old)) + [(a, a + size) for a, size, _ in docs[d]]
            merged: list[list[int]] = []
            for a, b in sorted(marked):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            spans.append(b"".join(struct.pack("<qq", a, b) for a, b in merged))
            found.append(sorted(set(items).union(*(x for _, _, x in docs[d]))))
        kept = [rows.column(c) for c in rows.schema.names if c not in (_SPANS, _STATE)]
        return pa.RecordBatch.from_arrays(kept + [pa.array(spans, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=[c for c in rows.schema.names if c not in (_SPANS, _STATE)] + [_SPANS, _STATE])
    return map_words(text_col, ALNUM, fn)


def _finish(text_col: str, cleaned: bool):
    """Counts from the word spans; with `cleaned`, also the text without the hit words."""
    def fn(rows: pa.RecordBatch, w: Words) -> pa.RecordBatch:
        n_hit, sha, chars, texts = [], [], [], []
        raw = rows.column(text_col)
        for d, (state, items) in enumerate(zip(rows.column(_SPANS).to_pylist(), rows.column(_STATE).to_pylist())):
            spans = list(struct.iter_unpack("<qq", state))
            n_hit.append(sum(b - a for a, b in spans))
            sha.append(hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest())
            f, base = int(w.first[d]), int(w.offsets[d])
            cut = [(int(w.start[f + a]) - base, int(w.end[f + b - 1]) - base) for a, b in spans]
            text = raw[d].as_py().encode() if cut else None
            chars.append([{"start": len(text[:a].decode()), "end": len(text[:b].decode())} for a, b in cut])
            if cleaned:
                texts.append(None if not cut else "".join(text[a:b].decode() for a, b in zip([0] + [e for _, e in cut], [s for s, _ in cut] + [len(text)])))
        names = [c for c in rows.schema.names if c not in (_SPANS, _STATE)]
        out = [rows.column(c) for c in names] + [pa.array(w.counts.astype(np.int64)), pa.array(n_hit, pa.int64()), rows.column(_STATE), pa.array(sha, pa.string()),
                                                 pa.array(chars, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        extra = ["_dc_n_words", "_dc_n_hit", "_dc_found", "_dc_sha", "_dc_chars"]
        if cleaned:
            out.append(pa.array(texts, pa.string()))
            extra.append("_dc_cleaned")
        return pa.RecordBatch.from_arrays(out, names=names + extra)
    return map_words(text_col, ALNUM, fn, hashed=False)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", block: int = BLOCK, cleaned: bool = False) -> DataFrame:
    """Every row of docs with `_dc_n_words`, `_dc_n_hit` (words inside a benchmark window), `_dc_found` (item ids, ascending),
    `_dc_sha`, `_dc_chars` (hit spans in code points) and, if asked for, `_dc_cleaned` (null: nothing to remove).

    Defined cases: null and empty texts have no words and no hits; repeated rows are scanned one by one; an empty
    benchmark hits nothing; other columns of docs pass unchanged."""
    windows = cut_lineage(benchmark_windows(benchmark, n), "windows")
    blocks = max(1, -(-windows.count() // block))
    state = docs.withColumn(_SPANS, F.lit(b"")).withColumn(_STATE, F.array().cast("array<bigint>"))
    for i in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod("h", F.lit(blocks)) == i)
        index = docs.sparkSession.sparkContext.broadcast(_Index(part.collect()))  # at most about `block` windows
        state = state.mapInArrow(_scan(index, text_col), state.schema)
        if i + 1 < blocks:
            state = cut_lineage(state, "scan")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    added = {"_dc_n_words": T.LongType(), "_dc_n_hit": T.LongType(), "_dc_found": T.ArrayType(T.LongType()), "_dc_sha": T.StringType(), "_dc_chars": T.ArrayType(span)}
    added |= {"_dc_cleaned": T.StringType()} if cleaned else {}
    return state.mapInArrow(_finish(text_col, cleaned), T.StructType(docs.schema.fields + [T.StructField(k, t) for k, t in added.items()]))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256 (of the item ids sorted as strings), contaminated."""
    one = docs.select(F.col(id_col).alias("_dc_id"), F.col(text_col).alias("_dc_text"))
    s = scan(one, benchmark, n, "_dc_text", block)
    return s.select(F.col("_dc_id").alias(id_col), F.col("_dc_n_words").alias("n_words"), F.col("_dc_n_hit").alias("n_hit"), F.size("_dc_found").cast("long").alias("n_items"),
                    F.col("_dc_sha").alias("items_sha256"), (F.col("_dc_n_hit") > 0).alias("contaminated"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows of docs without any benchmark window, with the columns of docs."""
    return scan(docs, benchmark, n, text_col, block).where("_dc_n_hit = 0").select(*[f"`{c}`" for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with the words of benchmark windows cut out of the texts; what else a text holds stays as it is."""
    s = scan(docs, benchmark, n, text_col, block, cleaned=True)
    return s.withColumn(text_col, F.coalesce("_dc_cleaned", text_col)).select(*[f"`{c}`" for c in docs.columns])
