"""N-gram Jaccard join: token-combination prefixes, exact verification, components.

A document is the set of its distinct word shingles, as 64-bit hashes. Tokens (shingles) are ordered: those of a rare
class first, those of a frequent class last, by hash inside a class. Two sets with Jaccard of at least t = num/den share a
token among the first n - ceil(t n) + 1 of each. Rare tokens of that prefix are indexed singly. A set whose prefix reaches
its frequent tokens has all its rare ones in it; if two such sets share none of these, they share so many frequent ones
that some two stand side by side in both, so neighbouring pairs of frequent tokens are indexed instead of single ones.

The class of a token is that of its cell in a table of counters over all documents (2**21 cells, of one size whatever the
input): frequent are the cells far above the mean. So a rare token has few documents, in proportion to the input, and the
order, which decides only how much work there is, is the same for every document. The links found do not depend on it.

Sets under one key are first compared with one of them, the leader, and those linked to it form a component. Pairs are
compared only if they share a key and are not yet connected, and signatures of parity bits do not show too many
unshared tokens, so a large group of near copies costs about one comparison
for each member and leader instead of one for each pair. Of the keys that two sets share, those behind one that both have among
their first ones do not bring them together again. Three exact bounds come before a comparison of whole sets: the
sizes; the tokens that stand before the key where a pair meets first, which it cannot share; and the heads, the of smallest hashes, where an unlike pair already has more unshared tokens than a similar one may have at all."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobstrata.llm.graph import components
from jobstrata.llm.sums import packed, tree_sum
from jobstrata.llm.words import NOT_SPACE, Words, mix, shingle_sets, small_batches
from jobstrata.session import Stages

SHINGLE = 5
SIMILARITY = (75, 100)
CELL_BITS = 21
MARGIN = 8
DEVIATIONS = 4
SALTS = 16
SIGNATURE = 8     # words of 64 parity bits
LEADER_ROUNDS = 2
LARGE_KEY = 1000
FIRST_KEYS = 8    # keys of a set by which a pair is known to have met before
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def cells_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def frequent_cells(counts: np.ndarray) -> np.ndarray:
    """True for cells far above the mean: more than DEVIATIONS standard deviations of an even spread, and MARGIN."""
    mean = counts.mean()
    return counts > mean + DEVIATIONS * np.sqrt(mean) + MARGIN


def set_nodes(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash per set, the same for equal sets, as int64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ _PAIR), dtype=np.uint64)])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def prefix_keys(tokens: np.ndarray, first: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """(set, key, whether the key is of the frequent class, tokens before it) of all keys under which sets are indexed.

    "Before it" are the set's tokens that a partner cannot share if this is the first key at which the two meet: those of
    lower rank than a single token, all rare ones for a pair of frequent tokens."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    often = frequent[cells_of(tokens)]
    order = np.argsort(doc * 2 + often, kind="stable")  # tokens of a set are in the order of their hashes already
    tokens, often = tokens[order], often[order]
    rank = np.arange(len(tokens)) - first[doc]
    prefix = (n - -(-num * n // den) + 1)[doc]
    # A union of up to `few` tokens guarantees no neighbouring pair; such small sets index single frequent tokens too.
    few = int(1 / (2 * num / den - 1) * den / num) + 1
    single = (rank < prefix) & (~often | (n[doc] <= few))
    rare = np.bincount(doc, weights=~often, minlength=len(n)).astype(np.int64)
    reaches = rare[doc] < prefix
    pair = np.zeros(len(tokens), bool)
    pair[:-1] = often[:-1] & often[1:] & (doc[:-1] == doc[1:]) & reaches[:-1]
    at = np.flatnonzero(pair)
    return np.concatenate([doc[single], doc[at]]), np.concatenate([tokens[single], mix(tokens[at] * _PAIR + tokens[at + 1])]), np.concatenate([often[single], np.ones(len(at), bool)]), np.concatenate([rank[single], rare[doc[at]]])


def least_shared(n_a, n_b, num: int, den: int):
    """Fewest tokens that two similar sets of these sizes share (numbers, arrays or columns)."""
    total = n_a + n_b
    return F.ceil(total * num / (num + den)) if isinstance(total, Column) else -(-num * total // (num + den))


def parities(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SIGNATURE int64 per set; bit k tells whether an odd number of tokens fall into class k. Where two of them differ,
    the sets have an unshared token."""
    bits, n = 64 * SIGNATURE, len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    odd = np.bincount(doc * bits + (tokens & np.uint64(bits - 1)).astype(np.int64), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64).reshape(n, SIGNATURE)


def _described(size: int):
    """id, key, node, n, head (upper halves of the smallest quarter of hashes) and signature of each document; the task's cell
    counts as a row of `sums`."""
    names = ["id", "key", "node", "n", "head", "sums"] + [f"s{i}" for i in range(SIGNATURE)]

    def run(batches):
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for rows, data, offsets in small_batches(batches, "text"):
            tokens, first = shingle_sets(Words(data, offsets, NOT_SPACE), size)
            counts += np.bincount(cells_of(tokens), minlength=1 << CELL_BITS)
            n, upper = np.diff(first), (tokens >> np.uint64(32)).astype(np.uint32)
            heads = [upper[a: a + (k + 3) // 4].tobytes() for a, k in zip(first, n)]
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("key"), pa.array(set_nodes(tokens, first), mask=n == 0), pa.array(n), pa.array(heads, pa.binary()), pa.nulls(len(n), pa.binary()), *map(pa.array, np.ascontiguousarray(parities(tokens, first).T))], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.binary()), pa.array([packed(counts)], pa.binary())] + [pa.nulls(1, pa.int64())] * SIGNATURE, names=names)
    return run


def _postings(size: int, frequent, num: int, den: int):
    def run(batches):
        for _, data, offsets in small_batches(batches, "text"):
            tokens, first = shingle_sets(Words(data, offsets, NOT_SPACE), size)
            doc, key, often, before = prefix_keys(tokens, first, frequent.value, num, den)
            node = set_nodes(tokens, first)[doc]
            salt, n = np.where(often, node & (SALTS - 1), -1).astype(np.int32), np.diff(first)[doc].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), salt, before.astype(np.int32), n, node)], names=["key", "salt", "r", "n", "node"])
    return run


def _runs(batches):
    """Of rows sorted by (key, salt, r, node): those of keys with several nodes, once each, with the first one as leader.

    Nodes under a salt come even if alone, since the same key may have others. Only the last row and its leader are remembered."""
    names = ["key", "salt", "r", "n", "node", "leader_r", "leader_n", "leader"]
    last = lead = None  # (key, salt, r, n, node) of the last row, and of the first one of its key
    told = True         # whether the leader's own row has been given
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.column_stack([np.array(b.column(c)).astype(np.int64) for c in ("key", "salt", "r", "n", "node")])
        if last is not None:
            rows = np.concatenate([[last], rows])
        same_run = np.append(False, (rows[1:, :2] == rows[:-1, :2]).all(1))
        keep = np.append(True, ~(same_run[1:] & (rows[1:, 4] == rows[:-1, 4])))
        rows, same_run = rows[keep], same_run[keep]
        which = np.cumsum(~same_run) - 1
        leads = rows[~same_run][which]
        if last is not None:
            leads[which == 0] = lead
        shown = same_run | np.append(same_run[1:], False) | (rows[:, 1] >= 0)
        if last is not None:  # the repeated last row of the batch before
            again = shown[0] and not told and (rows[0] == lead).all()
            out = shown.copy()
            out[0] = again
            last_told = told or again
        else:
            out, last_told = shown, False
        one = out.nonzero()[0]
        told = bool(shown[-1]) if which[-1] > 0 or last is None else (last_told or bool(shown[-1]))
        last, lead = rows[-1], leads[-1]
        table = np.column_stack([rows[one], leads[one][:, [2, 3, 4]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(table[:, i])) for i in range(8)], names=names)


def _not_refuted(num: int, den: int):
    """Pairs whose heads do not show more unshared tokens than two similar sets can have."""
    def run(batches):
        for rows in batches:
            n_a, n_b = np.array(rows.column("n_a")), np.array(rows.column("n_b"))
            limit = n_a + n_b - 2 * least_shared(n_a, n_b, num, den)
            open_ = []
            for x, y, most, k_a, k_b in zip(rows.column("head_a"), rows.column("head_b"), limit, n_a, n_b):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                # up to this hash both heads are complete
                end = min([int(h[-1]) for h, n in ((x, k_a), (y, k_b)) if len(h) < n], default=1 << 32)
                x, y = x[: np.searchsorted(x, end, "left")], y[: np.searchsorted(y, end, "left")]
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                open_.append(len(x) + len(y) - 2 * shared <= most)
            mask = pa.array(open_, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])
    return run


def _verified(num: int, den: int):
    """Pairs (a, b) whose sets are similar enough."""
    def run(batches):
        for rows in batches:
            same = []
            for x, y in zip(rows.column("set_a"), rows.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                same.append(den * both >= num * (len(x) + len(y) - both))
            mask = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column("a").filter(mask), rows.column("b").filter(mask)], names=["a", "b"])
    return run


class _Graph:
    """Verifies pairs of nodes and keeps the components of what is linked so far."""

    def __init__(self, docs: DataFrame, members: DataFrame, size: int, similarity: tuple[int, int], stages: Stages):
        self.docs, self.members, self.size, (self.num, self.den), self.stages = docs, members, size, similarity, stages
        self.links = self.tested = self.roots = None

    def pairs(self, rows: DataFrame, x: str, y: str) -> DataFrame:
        """Distinct pairs (a < b) of rows with x, x_n, x_r, y, y_n, y_r that the sizes, and the tokens before the key, allow.

        A similar pair passes at the first key that both have."""
        n_x, n_y = F.col(f"{x}_n"), F.col(f"{y}_n")
        fits = (F.least(n_x, n_y) * self.den >= F.greatest(n_x, n_y) * self.num) & (F.least(n_x - F.col(f"{x}_r"), n_y - F.col(f"{y}_r")) >= least_shared(n_x, n_y, self.num, self.den))
        first = F.col(x) < F.col(y)
        way = lambda s, t: F.when(first, F.col(s)).otherwise(F.col(t))
        return rows.where((F.col(x) != F.col(y)) & fits).select(way(x, y).alias("a"), way(y, x).alias("b"), way(f"{x}_n", f"{y}_n").alias("n_a"), way(f"{y}_n", f"{x}_n").alias("n_b")).distinct()

    def _sets(self, pairs: DataFrame) -> DataFrame:
        """Whole sets of the nodes of some pairs, each read from one of its rows; one with an id where there is one."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        size, rows = self.size, self.members.select("id", "key", "node").join(nodes, "node").groupBy("node").agg(F.max(F.struct("id", "key")).alias("row")).select(F.col("row.id").alias("of_id"), F.col("row.key").alias("of_key")).distinct()

        def read(batches):
            for _, data, offsets in small_batches(batches, "text"):
                tokens, first = shingle_sets(Words(data, offsets, NOT_SPACE), size)
                yield pa.RecordBatch.from_arrays([pa.array(set_nodes(tokens, first)), pa.array([tokens[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=["node", "tokens"])

        return self.stages.keep(self.docs.join(rows, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left_semi").mapInArrow(read, "node long, tokens binary").dropDuplicates(["node"]), "sets")

    def compare(self, pairs: DataFrame) -> None:
        """Adds the links among the pairs not compared before."""
        fits = self.stages.keep(pairs if self.tested is None else pairs.join(self.tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        self.tested = fits if self.tested is None else self.tested.unionByName(fits)
        head = self.heads()
        shown = fits.join(head.select(F.col("node").alias("b"), F.col("head").alias("head_b")), "b").join(head.select(F.col("node").alias("a"), F.col("head").alias("head_a")), "a")
        left = self.stages.keep(shown.select("a", "b", "n_a", "n_b", "head_a", "head_b").mapInArrow(_not_refuted(self.num, self.den), "a long, b long"), "open")
        sets = self._sets(left)
        near = left.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("set_a")), "a")
        new = self.stages.keep(near.select("a", "b", "set_a", "set_b").mapInArrow(_verified(self.num, self.den), "a long, b long"), "near")
        self.links = new if self.links is None else self.links.unionByName(new)
        self.roots = components(self.links)
        self.stages.drop(left, sets)

    def heads(self) -> DataFrame:
        return self.members.where("node is not null").groupBy("node").agg(F.first("head").alias("head"))

    def open_keys(self, candidates: DataFrame) -> DataFrame:
        """Rows of the candidates whose key still has several components: key, salt, node, node_n, node_r, root, size.

        Of keys with the same nodes one is enough; where a pair meets first is then unknown, so no token counts as before it."""
        rooted = candidates.join(self.roots.withColumnRenamed("component", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        of_key = [F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in range(2)]]
        many = rooted.groupBy("key").agg(*of_key).where("lo <> hi").groupBy("size", "h0", "h1").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("alike"))
        return self.stages.keep(rooted.join(many, "key").select("key", "salt", "node", "node_n", F.when(F.col("alike") > 1, 0).otherwise(F.col("node_r")).alias("node_r"), "root", "size"), "open")


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: tuple[int, int]) -> DataFrame:
    """id, key (hash of the text), n, root (node of the group; null without shingles) of every row."""
    num, den = similarity
    spark = docs.sparkSession
    stages = Stages(spark)
    one = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    described = stages.keep(one.mapInArrow(_described(size), "id long, key long, node long, n long, head binary, sums binary, " + ", ".join(f"s{i} long" for i in range(SIGNATURE))), "described")
    members = described.where("sums is null").drop("sums")
    counts = tree_sum(described.where("sums is not null").select(F.lit(0).alias("k"), "sums"), stages).get(0, np.zeros(1 << CELL_BITS, np.int64))
    frequent = spark.sparkContext.broadcast(frequent_cells(counts))  # a table of fixed size

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = one.mapInArrow(_postings(size, frequent, num, den), "key long, salt int, r int, n int, node long")
    sorted_ = postings.repartition(partitions, "key", "salt").sortWithinPartitions("key", "salt", "r", "node")
    runs = sorted_.mapInArrow(_runs, "key long, salt long, r long, n long, node long, leader_r long, leader_n long, leader long")
    candidates = stages.keep(runs.withColumnsRenamed({"r": "node_r", "n": "node_n"}), "candidates")

    # a key dealt out by salts has a leader for each; these are compared with the first of them
    led = candidates.where("salt >= 0 and leader = node").select("key", "salt", "leader", "leader_n", "leader_r")
    top = led.groupBy("key").agg(F.min(F.struct("leader_r", "leader", "leader_n")).alias("t"))
    across = led.join(top, "key").select("salt", "leader", "leader_n", "leader_r", F.col("t.leader").alias("top"), F.col("t.leader_n").alias("top_n"), F.col("t.leader_r").alias("top_r"))
    g = _Graph(one, members, size, similarity, stages)
    g.compare(g.pairs(candidates, "leader", "node").unionByName(g.pairs(across, "leader", "top")).distinct())
    rest = g.open_keys(candidates.select("key", "salt", "node", "node_n", "node_r"))
    for k in range(LEADER_ROUNDS):
        large = rest.where(F.col("size") > LARGE_KEY)
        if large.isEmpty():
            break
        # more leaders for keys with many sets, and every set not connected with them
        first = F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "node_n", "node_r", "root")).alias("l")
        led = large.groupBy("key").agg(first).select("key", *[F.col(f"l.{c}").alias(c.replace("node", "leader")) for c in ("node", "node_n", "node_r")], F.col("l.root").alias("leader_root"))
        g.compare(g.pairs(large.join(led, "key").where("root <> leader_root"), "leader", "node"))
        rest = g.open_keys(rest.drop("root", "size"))
    signed = members.where("node is not null").groupBy("node").agg(*[F.first(f"s{i}").alias(f"s{i}") for i in range(SIGNATURE)])
    rest = rest.join(signed, "node").join(rest.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("node_r", "key"))), 1, FIRST_KEYS)["key"].alias("first")), "node")
    other = rest.select("key", F.col("first").alias("other_first"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(SIGNATURE)], *[F.col(c).alias(c.replace("node", "other")) for c in ("node", "node_n", "node_r")], F.col("root").alias("other_root"))
    unlike = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(SIGNATURE)), F.lit(0))
    near = F.col("node_n") + F.col("other_n") - unlike >= 2 * least_shared(F.col("node_n"), F.col("other_n"), num, den)
    # the earliest of the first keys that both have, in the order of the smaller node; a similar pair passes there or before
    met = F.get(F.array_intersect("first", "other_first"), F.lit(0))
    once = met.isNull() | F.array_position("first", F.col("key")).between(1, F.array_position("first", met))
    g.compare(g.pairs(rest.join(other, "key").where(F.expr("root <> other_root and node < other") & near & once), "node", "other"))

    return members.select("id", "key", "node", "n").join(g.roots, "node", "left").select("id", "key", "n", F.coalesce("component", "node").alias("root"))


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Per row: id, n_shingles (distinct shingles; of a text of fewer words than `size`, the whole sequence is one),
    component_id (smallest id reachable by links of Jaccard of at least `similarity`, itself included).

    Null and empty texts have no shingles and link with nothing. Rows that repeat an id each get a row, by their own text; equal
    texts are one node of the graph. A null id has the component of its text's group, null if no id is in it; texts without
    an id link others like any."""
    rows = Stages(docs.sparkSession).keep(_grouped(docs, id_col, text_col, size, similarity), "grouped")
    named = rows.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    out = rows.join(named, "root", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, one row of each group of near copies (that of smallest id), with the columns of docs.

    Of rows that repeat an id each is judged by its own text; of those that repeat a kept id and its text one stays. Rows with a null id, and texts without words, are kept."""
    rows = Stages(docs.sparkSession).keep(_grouped(docs, id_col, text_col, SHINGLE, SIMILARITY).where("id is not null"), "grouped")
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("id", "key")).alias("first"))
    drop = rows.join(first, "root").where(F.struct("id", "key") != F.col("first")).select(F.col("id").alias("_nj_id"), F.col("key").alias("_nj_key")).distinct()
    own = lambda table: (docs[id_col] == table["_nj_id"]) & (F.xxhash64(docs[text_col]) == table["_nj_key"])
    left = docs.join(drop, own(drop), "left_anti")
    again = rows.groupBy(F.col("id").alias("_nj_id"), F.col("key").alias("_nj_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_nj_id", "_nj_key")
    if again.isEmpty():
        return left
    return left.join(again, own(again), "left_anti").unionByName(left.join(again, own(again), "left_semi").dropDuplicates([id_col, text_col]))
