"""Repeated byte strings by a sparse suffix array over ranges of leading tokens.

Every string of SPAN bytes holds one anchor, the 16 bytes of least hash inside it, which depends on nothing but the string.
Neighbouring strings of one anchor travel together, so a text is dealt out as overlapping records of some seventy bytes
instead of one suffix for every byte. Records are range-partitioned by their leading tokens, the bytes of the anchor, at
splitters taken from a sample; equal strings meet in one range. A token that fills several ranges (a passage of a third of
all texts) has its strings dealt among these by a second token, a hash of the string, which again puts equal ones together.

Inside a range equal records are one, tokens that only one document has are left out, and what remains is sorted by
multikey quicksort: rows that are equal so far are sorted by their next eight bytes, and drop out once they stand alone.
No string meets a range's border, since all that begin with one token, or share its second one, are in one range.

A task that reads texts packs its records into compressed blocks, one for each range, in which copies share their bytes."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata.llm.rows import row_key
from jobstrata.llm.words import CHUNK_BYTES, mix, small_batches
from jobstrata.session import Stages

SPAN = 50
GRAM = 16
WIDTH = 2 * SPAN - GRAM      # longest record: as many strings as can share an anchor
RUN = SPAN - GRAM + 1
RANGES = 8                   # ranges of one task, which holds one of them at a time
SAMPLED = 16                 # documents looked at for each splitter
MOST_SAMPLED = 100_000
RATE = 16                    # every so many anchors of these are taken
HELD_RECORDS = 1 << 19
SLICE_RECORDS = 1 << 15
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_ROW = np.random.default_rng(20240913).integers(1, 1 << 63, WIDTH // 4 + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODEC = pa.Codec("zstd", compression_level=3)
_WORDS = [*range(0, SPAN - 8, 8), SPAN - 8]  # places of eight bytes that cover a string


def _at_every_byte(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data).data, strides=(1,)) if len(data) > 7 else np.zeros(0, np.uint64)


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, anchor, text) of each run of strings that share an anchor, inside one text."""
    n = len(data) - SPAN + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    words = _at_every_byte(data).copy()
    h = words[: len(data) - GRAM + 1] * _M[0] + words[8:] * _M[1]
    h ^= h >> np.uint64(32)
    h *= _M[2]
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= RUN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n], least[RUN - width: RUN - width + n])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.ones(n, bool)
    over = (offsets[1:, None] - np.arange(1, SPAN)).ravel()
    whole[over[(over >= 0) & (over < n)]] = False
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
    last = whole.copy()
    last[:-1] &= ~whole[1:] | (anchor[1:] != anchor[:-1])
    lo = np.flatnonzero(new)
    return lo, np.flatnonzero(last) - lo + 1, anchor[lo], np.searchsorted(offsets, lo, side="right") - 1


def _pieces(batches):
    """(ids, keys, text of each piece, data, offsets, place in its text at which a piece begins) of bounded size.

    A long text comes in pieces that overlap, so that every string is whole in one of them and begins in no other."""
    for rows, data, offsets in small_batches(batches, "text"):
        ids, keys = np.array(rows.column("id")), np.array(rows.column("key"))
        if len(ids) > 1 or len(data) <= 2 * CHUNK_BYTES:
            yield ids, keys, data, offsets, 0
        else:
            for at in range(0, len(data), CHUNK_BYTES):
                part = data[at: at + CHUNK_BYTES + SPAN - 1]
                yield ids, keys, part, np.array([0, len(part)]), at


def _grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(sliding_window_view(data, GRAM)[at]).view(f"S{GRAM}").ravel()


def splitters(docs: DataFrame, ranges: int) -> np.ndarray:
    """Borders of about equal ranges of leading tokens; a token that fills several ranges is there several times."""
    wanted = min(SAMPLED * ranges, MOST_SAMPLED)
    count = docs.count()

    def run(batches):
        for ids, _, data, offsets, begin in _pieces(batches):
            lo, _, anchor, doc = anchored(data, offsets)
            h = mix(ids[doc].astype(np.uint64) * _M[0] + (lo + begin - offsets[doc]).astype(np.uint64))
            take = h % np.uint64(RATE) == 0
            yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(_grams(data, anchor[take]).tolist() if take.any() else [], pa.binary())], names=["h", "gram"])

    sample = docs.sample(min(1.0, wanted / max(count, 1)), seed=13).mapInArrow(run, "h long, gram binary")
    found = sample.orderBy("h").limit(RATE * wanted).collect()
    grams = np.sort(np.array([bytes(r["gram"]) for r in found], f"S{GRAM}"))
    return grams[np.arange(1, ranges) * len(grams) // ranges] if len(grams) else grams


class _Dealer:
    """The range of each record; the strings of a token with several ranges are records of their own."""

    def __init__(self, borders: np.ndarray):
        self.tokens, self.times = np.unique(borders, return_counts=True)
        self.upto = np.concatenate([[0], np.cumsum(self.times)])

    def __call__(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last range of the token, number of its ranges)."""
        at = np.searchsorted(self.tokens, gram, side="right")
        same = np.zeros(len(gram), bool)
        same[at > 0] = self.tokens[at[at > 0] - 1] == gram[at > 0]
        many = np.ones(len(gram), np.int64)
        many[same] = self.times[at[same] - 1]
        return self.upto[at], many


def _filled(run: np.ndarray) -> np.ndarray:
    """Which bytes of record rows belong to the records."""
    return np.arange(WIDTH) < (run + SPAN - 1)[:, None]


def _record_rows(data: np.ndarray, lo: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The bytes of each record, zeros behind them."""
    rows = sliding_window_view(np.concatenate([data, np.zeros(WIDTH, np.uint8)]), WIDTH)[lo]
    rows *= _filled(run)
    return rows


def _fingerprints(rows: np.ndarray, run: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-WIDTH // 8) * 8), np.uint8)
    wide[:, :WIDTH] = rows
    return mix((wide.view("<u8") * _ROW[: wide.shape[1] // 8]).sum(axis=1, dtype=np.uint64) + run.astype(np.uint64))


def _alike(rows: np.ndarray, run: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each record's bytes among the different ones, and the first record of each of these; keys sort before the bytes.

    Fingerprints put equal records side by side, and bytes decide."""
    order = np.lexsort((_fingerprints(rows, run), *keys))
    sorted_ = rows[order]
    new = np.append(True, (sorted_[1:] != sorted_[:-1]).any(axis=1) | (run[order][1:] != run[order][:-1]))[: len(order)]
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _packed(columns: list[np.ndarray]) -> bytes:
    raw = [np.ascontiguousarray(c).tobytes() for c in columns]
    sizes = np.array([len(r) for r in raw], "<i8").tobytes()
    body = b"".join([sizes, *raw])
    return len(body).to_bytes(8, "little") + _CODEC.compress(body, asbytes=True)


def _unpacked(block: bytes, kinds: list[str]) -> list[np.ndarray]:
    body = _CODEC.decompress(block[8:], int.from_bytes(block[:8], "little"), asbytes=True)
    sizes = np.frombuffer(body, "<i8", len(kinds))
    ends = np.cumsum(sizes) + 8 * len(kinds)
    return [np.frombuffer(body[e - s: e], k) for s, e, k in zip(sizes, ends, kinds)]


#: ids and keys of the texts; bytes, strings and anchor of the records; record, text (as steps) and place of the occurrences
_KINDS = ["<i8", "<i8", "u1", "u1", "u1", "<i4", "<u4", "<u4"]


def _blocks(borders):
    def flushed(held):
        rows, run, off, range_, text, place, ids, keys = (np.concatenate(c) for c in zip(*held))
        number, first = _alike(rows, run, range_)
        order = np.argsort(range_, kind="stable")
        edges = np.flatnonzero(np.append(True, range_[order][1:] != range_[order][:-1])) if len(order) else np.zeros(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(order))):
            mine = order[a:b]
            # records in the order in which the texts show them first
            used, seen, which = np.unique(number[mine], return_index=True, return_inverse=True)
            rank = np.empty(len(used), np.int64)
            rank[np.argsort(seen)] = np.arange(len(used))
            one = first[used[np.argsort(seen)]]
            texts, at = np.unique(text[mine], return_inverse=True)
            steps = np.diff(rank[which], prepend=0).astype("<i4")
            yield int(range_[mine[0]]), _packed([ids[texts], keys[texts], rows[one][_filled(run[one])], run[one].astype("u1"), off[one].astype("u1"), steps, at.astype("<u4"), place[mine].astype("<u4")])

    def run(batches):
        dealer = _Dealer(borders.value)
        held, n, texts = [], 0, 0

        def out():
            blocks = list(flushed(held))
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=["range", "block"])

        for ids, keys, data, offsets, begin in _pieces(batches):
            lo, many, anchor, doc = anchored(data, offsets)
            last, ranges = dealer(_grams(data, anchor) if len(lo) else np.zeros(0, f"S{GRAM}"))
            split = np.repeat(np.arange(len(lo)), np.where(ranges > 1, many, 1))
            step = np.arange(len(split)) - np.searchsorted(split, split)
            alone = ranges[split] > 1
            lo, many, anchor, doc, last, ranges = lo[split] + step, np.where(alone, 1, many[split]), anchor[split], doc[split], last[split], ranges[split]
            rows = _record_rows(data, lo, many)
            range_ = last.copy()
            range_[alone] -= (_fingerprints(rows[alone], many[alone]) % ranges[alone].astype(np.uint64)).astype(np.int64)
            held.append((rows, many, anchor - lo, range_, doc + texts, lo - offsets[doc] + begin, ids, keys))
            n, texts = n + len(lo), texts + len(ids)
            if n >= HELD_RECORDS:
                yield out()
                held, n, texts = [], 0, 0
        if n:
            yield out()
    return run


def _equal_strings(flat: np.ndarray, at: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: (places in `at`, class) of the strings that some other one with the same token equals."""
    words, alive, group = _at_every_byte(flat), np.arange(len(at)), token
    for level in (None, *_WORDS):
        key = group[alive] if level is None else words[at[alive] + level]
        order = np.argsort(key, kind="stable") if level is None else np.lexsort((key, group))
        alive, key = alive[order], key[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        if level is not None:
            group = group[order]
            new[1:] |= group[1:] != group[:-1]
        group = np.cumsum(new) - 1
        more = np.bincount(group, minlength=1)[group] > 1 if len(group) else new
        alive, group = alive[more], group[more]
    return alive, group


def _first_ids(rows: np.ndarray, run: np.ndarray, off: np.ndarray, least: np.ndarray, token: np.ndarray) -> np.ndarray:
    """(record, string) -> smallest id that has the string, of different records sorted by their token; beyond a record's strings the largest number."""
    first = np.where(np.arange(RUN) < run[:, None], least[:, None], np.iinfo(np.int64).max)
    flat = rows.reshape(-1)
    begins = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token)) if len(token) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(token):
        # whole tokens, about SLICE_RECORDS records at a time
        hi = begins[np.searchsorted(begins, lo + SLICE_RECORDS)] if lo + SLICE_RECORDS < len(token) else len(token)
        record = np.repeat(np.arange(lo, hi), run[lo:hi])
        step = np.arange(len(record)) - np.repeat(np.cumsum(run[lo:hi]) - run[lo:hi], run[lo:hi])
        alive, group = _equal_strings(flat, record * WIDTH + step, token[record] * WIDTH + off[record] - step)
        if len(alive):
            owner = least[record[alive]]
            order = np.lexsort((owner, group))
            smallest = owner[order][np.append(True, group[order][1:] != group[order][:-1])]
            new = np.append(0, np.cumsum(group[order][1:] != group[order][:-1]))
            first[record[alive[order]], step[alive[order]]] = smallest[new]
        lo = hi
    return first


def _spans_of_range(blocks: list[bytes]) -> pa.RecordBatch:
    """id, key, spans (pairs of places) of the texts whose strings of one range also stand in a document of smaller id."""
    parts, texts, records = [], 0, 0
    for block in blocks:
        ids, keys, data, run, off, steps, text, place = _unpacked(block, _KINDS)
        run = run.astype(np.int64)
        rows = np.zeros((len(run), WIDTH), np.uint8)
        rows[_filled(run)] = data
        parts.append((ids, keys, rows, run, off.astype(np.int64), np.cumsum(steps, dtype=np.int64) + records, text + np.int64(texts), place.astype(np.int64)))
        texts, records = texts + len(ids), records + len(run)
    ids, keys, rows, run, off, record, text, place = (np.concatenate(c) for c in zip(*parts))
    # the token of a record; only those that several documents have go on
    gram = rows[np.arange(len(rows))[:, None], off[:, None] + np.arange(GRAM)].view("<u8")
    token = mix(gram[:, 0] * _M[0] + gram[:, 1] * _M[1])
    _, token = np.unique(token, return_inverse=True)
    owner = ids[text]
    low, high = np.full(token.max(initial=0) + 1, np.iinfo(np.int64).max), np.full(token.max(initial=0) + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, token[record], owner)
    np.maximum.at(high, token[record], owner)
    shared = (low < high)[token]
    kept = np.cumsum(shared) - 1
    mine = shared[record]
    rows, run, off, token, record, text, place, owner = rows[shared], run[shared], off[shared], token[shared], kept[record[mine]], text[mine], place[mine], owner[mine]
    number, one = _alike(rows, run, token)
    rows, run, off, token, record = rows[one], run[one], off[one], token[one], number[record]
    least = np.full(len(run), np.iinfo(np.int64).max)
    np.minimum.at(least, record, owner)
    first = _first_ids(rows, run, off, least, token)
    later = np.flatnonzero(first.min(axis=1, initial=np.iinfo(np.int64).max)[record] < owner)
    out = []
    for a in range(0, len(later), SLICE_RECORDS):
        part = later[a: a + SLICE_RECORDS]
        gone = np.zeros((len(part), RUN + 2), bool)
        gone[:, 1:-1] = first[record[part]] < owner[part, None]
        which, begin = np.nonzero(gone[:, 1:] & ~gone[:, :-1])
        _, end = np.nonzero(~gone[:, 1:] & gone[:, :-1])
        out.append((text[part[which]], place[part[which]] + begin, place[part[which]] + end + SPAN - 1))
    if not out:
        return _span_rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), ids, keys)
    return _span_rows(*(np.concatenate(c) for c in zip(*out)), ids, keys)


def _span_rows(text: np.ndarray, begin: np.ndarray, end: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((begin, text))
    text, pairs = text[order], np.stack([begin[order], end[order]], axis=1).astype("<i4")
    new = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
    offsets = (np.append(new, len(text)) * 8).astype(np.int32)
    spans = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(pairs))])
    return pa.RecordBatch.from_arrays([pa.array(ids[text[new]]), pa.array(keys[text[new]]), spans], names=["id", "key", "spans"])


def _resolved(batches):
    range_, blocks = None, []
    for b in batches:
        for r, block in zip(b.column("range").to_pylist(), b.column("block")):
            if r != range_ and blocks:
                yield _spans_of_range(blocks)
                blocks = []
            range_ = r
            blocks.append(block.as_buffer().to_pybytes())
    if blocks:
        yield _spans_of_range(blocks)


def repeated_spans(docs: DataFrame, stages: Stages) -> DataFrame:
    """id, key (of the text), spans (array of packed pairs of places) of the texts that have strings of documents of smaller ids; docs: id, key, text."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = spark.sparkContext.broadcast(splitters(docs, partitions * RANGES))  # as many as ranges
    dealt = docs.mapInArrow(_blocks(borders), "range int, block binary").repartitionById(partitions, F.floor(F.col("range") / RANGES).cast("int")).sortWithinPartitions("range")
    found = stages.keep(dealt.mapInArrow(_resolved, "id long, key long, spans binary"), "spans")
    return found.groupBy("id", "key").agg(F.collect_list("spans").alias("spans"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of some spans (rows of begin, end)."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])[: len(spans)]
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1) if len(spans) else spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept (bytes of the text that are left).

    A byte goes if a string of SPAN bytes that covers it also begins in a document of smaller id; strings are those of the
    texts as given, and overlaps count. Null texts are empty and shorter ones than SPAN stay whole. A row without an id stays
    whole and takes nothing from others. Rows that repeat an id take nothing from each other and are each judged by their
    own text. Extra columns play no part."""
    stages = Stages(docs.sparkSession)
    one = docs.select(F.col(id_col).cast("long").alias("id"), row_key(docs, id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    spans = repeated_spans(one.where("id is not null and text is not null"), stages)

    def cut(batches):
        for rows in batches:
            out = []
            for text, blocks in zip(rows.column("text"), rows.column("spans")):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                gone = merged(np.frombuffer(b"".join(blocks.as_py()), "<i4").reshape(-1, 2)) if blocks.is_valid else ()
                kept, at = [], 0
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]]) if at else data
                out.append((len(data), len(data) - len(kept), len(gone), kept))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([rows.column("id"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return one.join(spans, ["id", "key"], "left").select("id", "text", "spans").mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return without_repeats(docs, id_col, text_col).select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


DIGEST_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT row, doc_id, i, hash(substr(x, 2 * i + 1, {2 * SPAN})) AS h, substr(x, 2 * i + 1, {2 * SPAN}) AS s FROM (SELECT *, unnest(range(0, greatest(len(x) // 2 - {SPAN - 1}, 0))) AS i FROM d)),
least AS (SELECT h, s, min(doc_id) AS first FROM w GROUP BY ALL),
hit AS (SELECT w.row, w.i FROM w JOIN least USING (h, s) WHERE least.first < w.doc_id),
runs AS (SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i) AS run FROM (SELECT row, i, CASE WHEN i - lag(i) OVER (PARTITION BY row ORDER BY i) <= {SPAN} THEN 0 ELSE 1 END AS new FROM hit)),
spans AS (SELECT row, min(i) AS a, max(i) + {SPAN} AS b FROM runs GROUP BY row, run),
kept AS (SELECT d.row, d.doc_id, d.x, list(s.a ORDER BY s.a) FILTER (s.a IS NOT NULL) AS a, list(s.b ORDER BY s.a) FILTER (s.a IS NOT NULL) AS b FROM d LEFT JOIN spans s USING (row) GROUP BY ALL)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(b) - list_sum(a), 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN a IS NULL THEN x ELSE array_to_string([substr(x, CASE WHEN k = 0 THEN 1 ELSE 2 * b[k] + 1 END, CASE WHEN k = len(a) THEN len(x) ELSE 2 * a[k + 1] - CASE WHEN k = 0 THEN 0 ELSE 2 * b[k] END END) FOR k IN range(0, len(a) + 1)], '') END)) AS kept_sha256
FROM kept
"""
