"""Embedding near-duplicates by spherical-cap filters.

Filter directions are products of random codewords, one per block of rotated coordinates, in a few independent codes. A vector is listed under every
direction whose inner product with it exceeds a threshold; the list is decoded block by block, keeping only partial sums
that can still exceed it. Vectors that share a direction (and a label) meet and are verified in double precision. A pair
counts once, at the smallest direction both have. The number of directions follows the number of vectors, so that lists
keep their length and the vectors under one direction stay few; a direction with many (a large group of near copies) is
split into blocks whose pairs go to different tasks."""
from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobstrata.llm.graph import components
from jobstrata.llm.words import list_array
from jobstrata.session import Stages

THRESHOLD = 0.98
RECALL = 0.995             # share of pairs at the threshold that must share a direction, by trial on random pairs
LIST = 10.0               # directions that a vector exceeds in one code, on average
LOAD = 2.0                # unrelated vectors of a label under one direction, on average
BLOCK_ROWS = 512          # vectors of one direction that meet in one step
MIN_DIMENSIONS = 16
MAX_CODEWORDS = 4096
MAX_CODES = 64
TRIALS = 400
SEED = 3


@dataclass(frozen=True)
class Code:
    """One product code. rotation: of the padded coordinates; words: codewords of each block; cut: least inner product."""
    rotation: np.ndarray
    words: tuple[np.ndarray, ...]
    cut: float

    def products(self, unit: np.ndarray) -> list[np.ndarray]:
        padded = np.zeros((len(unit), len(self.rotation)))
        padded[:, : unit.shape[1]] = unit
        return [p @ w.T for p, w in zip(np.split(padded @ self.rotation, len(self.words), axis=1), self.words)]

    def listed(self, unit: np.ndarray) -> list[np.ndarray]:
        """Numbers of the directions that each unit vector exceeds."""
        products = self.products(unit)
        tops = np.array([p.max(1) for p in products])
        out = []
        for i in range(len(unit)):
            sums, numbers = np.zeros(1), np.zeros(1, np.int64)
            for k, p in enumerate(products):
                rest = tops[k + 1:, i].sum()
                own = np.flatnonzero(p[i] >= self.cut - rest - sums.max()) if len(sums) else np.zeros(0, np.int64)
                grown = np.add.outer(sums, p[i][own])
                a, b = np.nonzero(grown >= self.cut - rest)
                sums, numbers = grown[a, b], numbers[a] * len(self.words[k]) + own[b]
            out.append(numbers)
        return out


@dataclass(frozen=True)
class Filters:
    codes: tuple[Code, ...]
    directions: int  # of one code

    @staticmethod
    def design(dimensions: int, rows: int, threshold: float = THRESHOLD) -> Filters:
        """Codes for `rows` vectors that may meet: LOAD and LIST give the number of directions and, by trial on random
        vectors, the cut; codes are added until random pairs at the threshold share a direction often enough."""
        wanted = max(rows, 50) * LIST / LOAD
        blocks = 2 if wanted <= MAX_CODEWORDS ** 2 else 3
        size = -(-max(dimensions, MIN_DIMENSIONS) // 6) * 6  # can be cut in two or three
        per_block, rnd = math.ceil(wanted ** (1 / blocks)), np.random.default_rng(SEED)
        x, z = (rnd.normal(size=(TRIALS, dimensions)) for _ in range(2))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        y = threshold * x + math.sqrt(1 - threshold ** 2) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        codes, met = [], np.zeros(TRIALS, bool)
        while met.mean() < RECALL and len(codes) < MAX_CODES:
            rotation = np.linalg.qr(rnd.normal(size=(size, size)))[0]
            words = rnd.normal(size=(blocks, per_block, size // blocks))
            words /= np.linalg.norm(words, axis=2, keepdims=True) * math.sqrt(blocks)
            low, high = 0.0, 1.0
            for _ in range(14):
                cut = (low + high) / 2
                code = Code(rotation, tuple(words), cut)
                low, high = (cut, high) if cut < 0.05 or np.mean([len(a) for a in code.listed(x[:100])]) > LIST else (low, cut)
            codes.append(Code(rotation, tuple(words), high))
            met |= [len(np.intersect1d(a, b)) > 0 for a, b in zip(codes[-1].listed(x), codes[-1].listed(y))]
        if met.mean() < RECALL:
            raise ValueError(f"{MAX_CODES} codes find {met.mean():.3f} of the pairs at the threshold, not {RECALL}; raise MAX_CODES or LIST")
        return Filters(tuple(codes), per_block ** blocks)

    def listed(self, unit: np.ndarray) -> list[np.ndarray]:
        """Ascending numbers of the directions, over all codes, that each unit vector exceeds."""
        parts = [[n + k * self.directions for n in c.listed(unit)] for k, c in enumerate(self.codes)]
        return [np.sort(np.concatenate(own)) for own in zip(*parts)]


def keyed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, vec (bytes of the components as they are given, float32 or float64) and key (equal for equal vectors of one label and length). The key is null, and the
    vector links with nothing, if the id, the label, the vector or a component is null, a component is not finite, or the
    vector is zero or empty."""
    kind, dtype = vectors.schema[label_col].dataType, component_type(vectors, vector_col)

    def run(batches):
        for b in batches:
            keys, vecs = [], []
            for i, v, label in zip(b.column("id"), b.column("v"), b.column("label")):
                values = v.values if v.is_valid else None
                ok = i.is_valid and label.is_valid and values is not None and len(values) > 0 and values.null_count == 0
                x = values.to_numpy(zero_copy_only=False).astype(dtype) if ok else None
                ok = ok and bool(np.isfinite(x).all() and (x != 0).any())
                vecs.append(x.tobytes() if ok else None)
                keys.append(hashlib.blake2b(repr(label.as_py()).encode() + b"\0" + vecs[-1], digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "label", "key", "vec"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", kind), T.StructField("key", T.BinaryType()), T.StructField("vec", T.BinaryType())])
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label")).mapInArrow(run, schema)


def component_type(vectors: DataFrame, vector_col: str) -> str:
    return "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"


def _unit(column: pa.Array, dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), dtype).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _list_filters(designs, dtype: str):
    """rep (number of the class), copies, vec, meet (label and length), list (directions) of each class."""
    def run(batches):
        for b in batches:
            lists: list = [None] * b.num_rows
            lengths = np.array([len(v) // int(dtype[-1]) for v in b.column("vec").to_pylist()])
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                for lo in range(0, len(at), 256):
                    some = at[lo: lo + 256]
                    for i, found in zip(some, designs.value[int(d)].listed(_unit(b.column("vec").take(pa.array(some)), dtype))):
                        lists[i] = found
            first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("rep", "copies", "vec", "meet")] + [list_array(flat, first, pa.int64())], names=["rep", "copies", "vec", "meet", "list"])
    return run


def _verify(threshold: float, dtype: str):
    """Links of runs of rows with equal (meet, filter, i, j): rep, links (copies linked at this filter), to (a node joined with)."""
    def run(batches):
        rest = None
        for b in batches:
            b = pa.Table.from_batches(([rest] if rest is not None else []) + [b]).combine_chunks().to_batches()[0]
            starts = _starts(b)
            if len(starts) > 1:
                yield _links(b.slice(0, starts[-1]), starts[:-1], threshold, dtype)
            rest = b.slice(starts[-1])
        if rest is not None and rest.num_rows:
            yield _links(rest, _starts(rest), threshold, dtype)
    return run


def _starts(b: pa.RecordBatch) -> np.ndarray:
    change = np.ones(b.num_rows, bool)
    change[1:] = False
    for c in ("meet", "filter", "i", "j"):
        x = np.array(b.column(c))
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _links(b: pa.RecordBatch, starts: np.ndarray, threshold: float, dtype: str) -> pa.RecordBatch:
    rep, copies, block, number = (np.array(b.column(c)) for c in ("rep", "copies", "block", "filter"))
    i, j, lists = np.array(b.column("i")), np.array(b.column("j")), b.column("list")
    at, flat = np.array(lists.offsets), np.array(lists.values)
    nodes, counts, ends = [], [], []
    for lo, hi in zip(starts, np.append(starts[1:], b.num_rows)):
        if hi - lo < 2:
            continue
        x = _unit(b.column("vec").slice(lo, hi - lo), dtype)
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if i[lo] != j[lo]:
            near &= block[lo:hi, None] != block[None, lo:hi]
        if not near.any():
            continue
        own = flat[at[lo]: at[hi]]
        row = np.repeat(np.arange(hi - lo), np.diff(at[lo: hi + 1]))
        smaller = own < number[lo]
        if smaller.any():  # a pair that shares a smaller direction is counted there
            which, place = np.unique(own[smaller], return_inverse=True)
            has = np.zeros((hi - lo, len(which)), np.float32)
            has[row[smaller], place] = 1
            counted = near & (has @ has.T == 0)
        else:
            counted = near
        label = np.arange(hi - lo)
        while True:
            low = np.minimum(label, np.where(near, label[None, :], hi - lo).min(1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        some = near.any(1)
        nodes.append(rep[lo:hi][some])
        counts.append((counted @ copies[lo:hi])[some])
        ends.append(rep[lo:hi][label[some]])
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(join(nodes)), pa.array(join(counts)), pa.array(join(ends))], names=["rep", "links", "to"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per vector: id, n_links (other vectors of its label with cosine of at least the threshold), component_id (smallest id
    reachable), kept (id = component_id).

    Vectors compare only with those of their label and length. Equal vectors are linked without a comparison; rows that
    repeat an id are vectors of their own. A vector that links with nothing (see `keyed`) is its own component and kept;
    a null id has a null component and is kept."""
    stages, dtype = Stages(vectors.sparkSession), component_type(vectors, vector_col)
    all_ = stages.keep(keyed(vectors, id_col, vector_col, label_col), "vectors")
    meet = F.xxhash64("label", F.octet_length("vec"))
    classes = all_.where("key is not null").groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.any_value("vec").alias("vec"), F.any_value(meet).alias("meet")).withColumn("rep", F.xxhash64("key"))
    classes = stages.keep(classes, "classes")
    largest = (classes.groupBy("meet", (F.octet_length("vec") / int(dtype[-1])).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n")).groupBy("size").agg(F.max("n").alias("n"))).collect()  # one row per vector length
    designs = vectors.sparkSession.sparkContext.broadcast({r["size"]: Filters.design(r["size"], r["n"], threshold) for r in largest})
    listed = stages.keep(classes.mapInArrow(_list_filters(designs, dtype), "rep long, copies long, vec binary, meet long, list array<bigint>"), "listed")
    full = listed.select("meet", F.explode("list").alias("filter")).groupBy("meet", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # vectors join last: what is dealt by direction to count and to split is narrow
    rows = listed.select("rep", "meet", F.explode("list").alias("filter")).join(full, ["meet", "filter"])
    k, own = F.ceil(F.col("n") / block_rows).cast("int"), F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / block_rows)).cast("int")
    split = rows.withColumn("block", own).select("*", F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))).alias("p"))
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = split.select("meet", "filter", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "rep").join(listed.select("rep", "copies", "vec", "list"), "rep")
    dealt = placed.select("meet", "filter", "i", "j", "block", "rep", "copies", "vec", "list").repartition(partitions, "meet", "filter", "i", "j").sortWithinPartitions("meet", "filter", "i", "j")
    links = stages.keep(dealt.mapInArrow(_verify(threshold, dtype), "rep long, links long, to long"), "links")
    roots = components(links.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")).distinct())
    found = links.groupBy("rep").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    rooted = stages.keep(classes.select("key", "rep", "low", "copies").join(found, "rep", "left").select("key", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root")), "rooted")
    per_class = stages.keep(rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component")), "root").select("key", "n_links", "component"), "answers")
    stages.drop(listed, links, classes, rooted)
    out = all_.select("id", "key").join(per_class, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


EXACT_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0 AND len([e FOR e IN embedding IF e <> 0]) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
reach(node, low) AS (SELECT a, b FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.low = links.a),
lowest AS (SELECT node, min(low) AS low FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN degree ON a = vec_id LEFT JOIN lowest ON node = vec_id
"""
