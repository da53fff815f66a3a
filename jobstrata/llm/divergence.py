"""How far the sources of a language differ in their use of terms, in whole numbers throughout.

Identical texts of a language are one row with the number of documents of every source that has them, and are split into
terms once; term counts and document frequencies are weighted by these numbers. Copies are counted by the tasks that read
them before they are dealt out, so a text of a third of all rows is few rows. What is kept for a text is one number for
each source, which is less than one row of the report's pairs of sources.

Pairs are compared sparsely: a term that neither source has adds the same to every sum, one that only one source has
depends on the other only through its share of an unseen term, and only terms that both have are joined."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.llm.words import Words, small_batches
from jobstrata.session import Stages

MIN_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
HELD_ROWS = 1 << 19
HELD_BYTES = 1 << 24

#: a-z (after lower-casing) and everything beyond ASCII
TERM = np.zeros(256, bool)
TERM[97:123] = TERM[128:] = True
_TEXTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.large_string()), ("copies", pa.int64())])
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])


def _summed(tables: list[pa.Table], keys: list[str], sums: list[str], schema: pa.Schema) -> pa.Table:
    out = pa.concat_tables(tables).group_by(keys).aggregate([(s, "sum") for s in sums])
    return out.select(keys + [f"{s}_sum" for s in sums]).rename_columns(keys + sums).cast(schema)


def _copies(batches):
    """Rows of equal lang, source and text counted, as far as HELD_BYTES of text reach."""
    held, size = [], 0
    for b in batches:
        held.append(pa.table([b.column("lang"), b.column("source"), b.column("text").cast(pa.large_string()), pa.array(np.ones(b.num_rows, np.int64))], schema=_TEXTS))
        size += b.column("text").nbytes
        if size >= HELD_BYTES:
            yield from _summed(held, ["lang", "source", "text"], ["copies"], _TEXTS).to_batches()
            held, size = [], 0
    if held:
        yield from _summed(held, ["lang", "source", "text"], ["copies"], _TEXTS).to_batches()


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, text, sources (array of source and number of documents) of every distinct text of a language; docs: lang, source, text without nulls."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.select("lang", "source", "text").mapInArrow(_copies, "lang string, source string, text string, copies long")
    # both sums use the one dealing by lang and text
    by_source = counted.repartition(partitions, "lang", "text").groupBy("lang", "text", "source").agg(F.sum("copies").alias("copies"))
    return by_source.groupBy("lang", "text").agg(F.collect_list(F.struct("source", "copies")).alias("sources"))


def _term_counts(batches):
    """lang, source, term, count, docs: weighted sums of the texts of a batch, added up over some batches of the task."""
    held, n = [], 0
    for rows, data, offsets in small_batches(batches, "text"):
        w = Words(data, offsets, TERM, hashed=False)
        ends = np.concatenate([[0], np.cumsum(w.end - w.start)])
        terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(w.data[TERM[w.data]])]).dictionary_encode()
        names = terms.dictionary.cast(pa.string())
        pair, count = np.unique(w.doc_of_word() * max(len(names), 1) + terms.indices.to_numpy(), return_counts=True)
        doc, term = pair // max(len(names), 1), pair % max(len(names), 1)
        # one row for each source of a text
        lists = rows.column("sources")
        per_text = np.diff(lists.offsets.to_numpy())
        first, flat = np.concatenate([[0], np.cumsum(per_text)]), lists.flatten()
        owner = np.repeat(doc, per_text[doc])
        at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(per_text[doc]) - per_text[doc], per_text[doc])
        copies = np.array(flat.field("copies"))[at]
        columns = [rows.column("lang").take(pa.array(owner)), flat.field("source").take(pa.array(at)), names.take(pa.array(np.repeat(term, per_text[doc]))), pa.array(np.repeat(count, per_text[doc]) * copies), pa.array(copies)]
        held.append(_summed([pa.table(columns, schema=_COUNTS)], ["lang", "source", "term"], ["count", "docs"], _COUNTS))
        n += held[-1].num_rows
        if n >= HELD_ROWS:
            held = [_summed(held, ["lang", "source", "term"], ["count", "docs"], _COUNTS)]
            n = held[0].num_rows
            if n >= HELD_ROWS // 2:
                yield from held[0].to_batches()
                held, n = [], 0
    if held:
        yield from _summed(held, ["lang", "source", "term"], ["count", "docs"], _COUNTS).to_batches()


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), in decimals beyond the range of a long."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(count + SMOOTHING) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + terms * SMOOTHING))


class Usage:
    """kept: lang, source, term, count, p and, of the whole language, q; groups: lang, source, n (counts of kept terms), used
    (kept terms that occur), sum_p, terms (kept ones of the lang), p0 (share of an unseen term; null without terms)."""

    def __init__(self, docs: DataFrame, stages: Stages, min_documents: int):
        filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
        # before anything is dealt out only these three columns are left
        counts = collapsed(filled).mapInArrow(_term_counts, "lang string, source string, term string, count long, docs long")
        counts = stages.keep(counts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
        vocabulary = stages.keep(counts.groupBy("lang", "term").agg(F.sum("count").alias("whole"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents).select("lang", "term", "whole"), "vocabulary")
        langs = vocabulary.groupBy("lang").agg(F.sum("whole").alias("all"), F.count(F.lit(1)).alias("terms"))
        of_group = counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "count", "whole")
        occurring = filled.select("lang", "source").distinct()
        sums = of_group.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("used"))
        groups = occurring.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "used", "all", "terms"])
        groups = stages.keep(groups, "groups")
        p = _share(F.col("count"), F.col("n"), F.col("terms"))
        q = _share(F.col("whole"), F.col("all"), F.col("terms"))
        self.kept = stages.keep(of_group.join(groups.drop("used"), ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")), "kept")
        sum_p = self.kept.groupBy("lang", "source").agg(F.sum("p").alias("sum_p"))
        p0 = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("n"), F.col("terms")))
        self.groups = stages.keep(groups.join(sum_p, ["lang", "source"], "left").select("lang", "source", "used", "terms", F.coalesce("sum_p", F.lit(0)).alias("sum_p"), p0.alias("p0")), "groups")


def _side(table: DataFrame, side: str, keys: tuple[str, ...] = ("lang",)) -> DataFrame:
    return table.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in table.columns if c not in keys])


def pair_distances(usage: Usage) -> DataFrame:
    """lang, a, b, value for every two sources a < b of a language: the sum over all kept terms of |p of a - p of b|."""
    groups, kept = usage.groups, usage.kept
    pairs = _side(groups, "a").join(_side(groups, "b"), "lang").where("source_a < source_b")
    # terms of one source against the other's share of an unseen term: shares are never below the own one of an unseen
    # term, so only those between the two change sign; there are few different shares, each summed once
    shares = kept.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("many")).join(groups.select("lang", "source", "p0"), ["lang", "source"])
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    below = shares.join(others, "lang").where("p0 < other_p0 and p < other_p0").groupBy("lang", "source", "other").agg(F.sum(F.expr("2 * (other_p0 - p) * many")).alias("turned"))
    both = kept.select("lang", "term", "source", "p").join(groups.select("lang", "source", "p0"), ["lang", "source"])
    met = _side(both, "a", ("lang", "term")).join(_side(both, "b", ("lang", "term")), ["lang", "term"]).where("source_a < source_b")
    met = met.groupBy("lang", "source_a", "source_b").agg(F.sum(F.expr("abs(p_a - p_b) - abs(p_a - p0_b) - abs(p_b - p0_a) + abs(p0_a - p0_b)")).alias("shared"))
    turned = lambda x, y: below.select("lang", F.col("source").alias(f"source_{x}"), F.col("other").alias(f"source_{y}"), F.col("turned").alias(f"turned_{x}"))
    keys = ["lang", "source_a", "source_b"]
    all_ = pairs.join(met, keys, "left").join(turned("a", "b"), keys, "left").join(turned("b", "a"), keys, "left")
    value = F.expr("(terms_a - used_a - used_b) * abs(p0_a - p0_b) + sum_p_a - used_a * p0_b + coalesce(turned_a, 0) + sum_p_b - used_b * p0_a + coalesce(turned_b, 0) + coalesce(shared, 0)")
    return all_.select("lang", F.col("source_a").alias("a"), F.col("source_b").alias("b"), F.when(F.col("terms_a") > 0, value).otherwise(0).cast("long").alias("value"))


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of every source of every language.

    Part `pair`: each other source with the summed difference of the shares of all kept terms. Part `term`: the `top_terms`
    terms whose share exceeds that of the whole language the most. Ranks go by value descending, then item. A term is kept
    if at least `min_documents` documents of the language have it. Null lang, source and text are empty ones, which are
    groups and texts like others; sources without terms have pairs, and a language without kept terms has values of 0. Rows
    that repeat count each."""
    stages = Stages(docs.sparkSession)
    usage = Usage(docs, stages, min_documents)
    pairs = stages.keep(pair_distances(usage), "pairs")
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = usage.kept.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(w))
    return ranked(both).unionByName(ranked(terms).where(F.col("rank") <= top_terms))


DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term, count(*) AS whole FROM t GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCUMENTS}),
langs AS (SELECT lang, sum(whole) AS n, count(*) AS terms FROM v GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS count FROM t JOIN v USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(count) AS n FROM c GROUP BY ALL),
p AS MATERIALIZED (
    SELECT g.lang, g.source, v.term, coalesce(c.count, 0) AS count,
           1 + ({SCALE}::HUGEINT * (coalesce(c.count, 0) + {SMOOTHING})) // (coalesce(n.n, 0)::HUGEINT + {SMOOTHING} * langs.terms) AS p,
           1 + ({SCALE}::HUGEINT * (v.whole + {SMOOTHING})) // (langs.n::HUGEINT + {SMOOTHING} * langs.terms) AS q
    FROM g JOIN v USING (lang) JOIN langs USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE count > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
