"""Line dedup as an exact set-similarity join, in DataFrame expressions only.

A line is the set of its five-word shingles (a shorter line has one: all its words). Words are counted in cells over all
documents, and a shingle, which is no more frequent than its rarest word, has that word's class of frequency. Shingles of a
line are ordered by class, then hash. Lines of Jaccard of at least t share a shingle among the first n - ceil(t n) + 1 of
both; sizes, the place of the shared shingle (what follows it must suffice) and parity bits of each set (where they
differ, only one of the lines has a shingle) rule out most other pairs, and the rest are verified on whole sets. A line goes if an earlier one (by document id, then line number) is similar to it.

Lines that repeat an earlier one word for word are found by hash and go before anything is dealt out: what is similar to one of
them is so to the first of its kind. Others are first compared with the first line under each key; only those that match none of these are compared with all earlier lines under their keys.
Postings carry no bits: those are made, and the lines read again, only where a shingle is shared."""
from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.llm.rows import row_key
from jobstrata.session import Stages

SHINGLE = 5
SIMILARITY = (75, 100)
CELLS = 1 << 16
CLASSES = 120
COMMON = 48       # class from which the lines of a key are dealt out by salts
SALTS = 16
BLANKS = "[ \\t\\u000B\\f\\r]+"
WORD = "[^ \\t\\u000B\\f\\r]"
_HASH = (1 << 56) - 1
_LINE = ["id", "key", "no"]   # key: see row_key
SIGNATURE = 4     # words of 64 parity bits
_BITS = [f"bits{k}" for k in range(SIGNATURE)]
_POSTED = ("id", "key", "no", "n", "before")
_OF_LINE = (*_POSTED, *_BITS)


def words(text: Column, separators: str = BLANKS) -> Column:
    return F.filter(F.split(F.lower(text), separators), lambda w: w != "")


def rarity(docs: DataFrame, text: str) -> Column:
    """Class of frequency of each cell of words as one constant array: four classes for each doubling of the count.

    CELLS counts reach the driver, whatever the input."""
    cell = F.xxhash64("w").bitwiseAND(F.lit(CELLS - 1))
    counts = docs.select(F.explode(F.split(F.lower(text), "[ \\t\\n\\u000B\\f\\r]+")).alias("w")).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    classes = [0] * CELLS
    for r in counts.collect():
        classes[r["cell"]] = min(CLASSES, int(4 * math.log2(r["n"] + 1)))
    return F.from_json(F.lit(json.dumps(classes)), "array<tinyint>")


def shingles(line: Column, classes: Column) -> Column:
    """Distinct shingles of a line as numbers, rarest class first: the class in the upper byte, a hash below it."""
    def code(h):
        return h.bitwiseAND(F.lit(_HASH)).bitwiseOR(F.shiftleft(F.get(classes, h.bitwiseAND(F.lit(CELLS - 1)).cast("int")).cast("long"), 56))

    def of(coded):
        def numbered(i):  # what is beyond the end of a shorter line is null, which neither function counts
            run = [F.get(coded, i + k) for k in range(SHINGLE)]
            return F.xxhash64(*run).bitwiseAND(F.lit(_HASH)).bitwiseOR(F.least(*run).bitwiseAND(F.lit(127 << 56)))

        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(coded) - SHINGLE, F.lit(0))), numbered)
        return F.when(F.size(coded) == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.array_distinct(runs)))

    # through an array of one element, so that the codes of the words are computed once
    return F.transform(F.array(F.transform(F.transform(words(line), lambda w: F.xxhash64(w)), code)), of)[0]


def _parity(t: Column) -> list[Column]:
    """SIGNATURE words; a bit of them tells whether an odd number of shingles fall into its class."""
    of = lambda k: F.filter(t, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(SIGNATURE - 1)) == k)
    flip = lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))
    return [F.aggregate(of(k), F.lit(0).cast("long"), flip).alias(c) for k, c in enumerate(_BITS)]


def _ceil_share(n: Column) -> Column:
    num, den = SIMILARITY
    return F.ceil(n * num / den).cast("int")


def _least_shared(a: Column, b: Column) -> Column:
    num, den = SIMILARITY
    return F.ceil((a + b) * num / (num + den))


def _lines(docs: DataFrame, which: Callable[[Column], Column]) -> DataFrame:
    """id, key, no, line of the lines with words whose number is asked for."""
    asked = F.transform(F.split("text", "\n"), lambda x, i: F.when(which(i) & x.rlike(WORD), x))
    return docs.select("id", "key", F.posexplode(asked).alias("no", "line")).where("line is not null")


_PAIR = [f"{s}_{c}" for s in "el" for c in _LINE]


def _allowed(rows: DataFrame) -> DataFrame:
    """Distinct pairs of lines, the earlier one first, that sizes, places and bits allow; rows: e_* and l_* of both lines."""
    num, den = SIMILARITY
    sizes = F.least("e_n", "l_n") * den >= F.greatest("e_n", "l_n") * num
    rest = F.least(F.col("e_n") - F.col("e_before"), F.col("l_n") - F.col("l_before")) >= _least_shared(F.col("e_n"), F.col("l_n"))
    differ = sum((F.bit_count(F.col(f"e_{c}").bitwiseXOR(F.col(f"l_{c}"))) for c in _BITS), F.lit(0))
    rest &= F.col("e_n") + F.col("l_n") - differ >= 2 * _least_shared(F.col("e_n"), F.col("l_n"))
    earlier = (F.col("e_id") < F.col("l_id")) | ((F.col("e_id") == F.col("l_id")) & (F.col("e_no") < F.col("l_no")))
    return rows.where(sizes & rest & earlier).select(*_PAIR).distinct()


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("token", *[F.col(c).alias(f"{side}_{c}") for c in _OF_LINE])


def _repeated(one: DataFrame) -> DataFrame:
    """id, key, no (from 0) of every line similar to an earlier one; one: id, key, text without nulls."""
    stages = Stages(one.sparkSession)
    classes = rarity(one, "text")

    plain = F.array_join(words(F.col("line")), " ")
    keyed = _lines(one, lambda i: F.lit(True)).select(*_LINE, plain.alias("line")).select(*_LINE, F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit(1)).alias("k2"))
    keyed = stages.keep(keyed, "lines")
    first = keyed.groupBy("k1", "k2").agg(F.min(F.struct("id", "no")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    equal = stages.keep(keyed.join(first, ["k1", "k2"]).where(F.struct("id", "no") > F.col("first")).select(*_LINE).distinct(), "equal")
    stages.drop(keyed)

    found_equal = one.join(equal.groupBy("id", "key").agg(F.collect_set("no").alias("skip")), ["id", "key"], "left")  # of one document
    others = _lines(found_equal, lambda i: ~F.coalesce(F.array_contains("skip", i), F.lit(False)))
    # no condition on the sets here: it would be tested before they are made, on sets made for it alone
    tokens = others.select(*_LINE, shingles(F.col("line"), classes).alias("t")).select(*_LINE, "t", F.size("t").alias("n"))
    posted = tokens.select(*_LINE, "n", F.posexplode(F.slice("t", 1, F.col("n") - _ceil_share(F.col("n")) + 1)).alias("before", "token"))
    posted = posted.withColumn("salt", F.when(F.shiftright("token", 56) >= COMMON, F.pmod("id", F.lit(SALTS)).cast("int")).otherwise(-1))
    w = Window.partitionBy("token", "salt").orderBy("id", "no", "key")
    lead = F.first(F.struct(*_POSTED)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = posted.withColumn("lead", lead).withColumn("next", F.lead("id").over(w)).where("salt >= 0 or next is not null or lead.id <> id or lead.no <> no or lead.key <> key").drop("next")
    met = stages.keep(met, "met")

    # of tokens with the same lines one is enough; where a pair meets first is then unknown, so nothing counts as before it
    of_token = [F.bit_xor(F.xxhash64(*_LINE, F.lit(k))).alias(f"h{k}") for k in range(2)]
    one_of = met.groupBy("token").agg(F.count(F.lit(1)).alias("size"), *of_token).where("size > 1").groupBy("size", "h0", "h1").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("alike"))
    before = lambda c: F.when(F.col("alike") > 1, 0).otherwise(F.col(c)).alias("before")
    lead = F.struct(*[before("lead.before") if c == "before" else F.col(f"lead.{c}") for c in _POSTED]).alias("lead")
    fewer = stages.keep(met.join(one_of.select("token", "alike"), "token").select("token", "salt", *[before(c) if c == "before" else F.col(c) for c in _POSTED], lead), "fewer")
    stages.drop(met)

    # the lines under these, each once, with their bits; the leads are among them
    numbers = fewer.groupBy("id", "key").agg(F.collect_set("no").alias("numbers"))
    read = _lines(one.join(numbers, ["id", "key"]).dropDuplicates(["id", "key"]), lambda i: F.array_contains("numbers", i))
    lines = stages.keep(read.select(*_LINE, "line", shingles(F.col("line"), classes).alias("t")).select(*_LINE, "line", *_parity(F.col("t"))), "lines")
    of_lead = lines.select(*[F.col(c).alias(f"lead_{c}") for c in (*_LINE, *_BITS)])
    both = fewer.select("*", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in _LINE]).join(of_lead, [f"lead_{c}" for c in _LINE]).join(lines.select(*_LINE, *_BITS), _LINE)
    met = stages.keep(both.select("token", "salt", *_OF_LINE, F.struct("lead.*", *[F.col(f"lead_{c}").alias(c) for c in _BITS]).alias("lead")), "signed")
    stages.drop(fewer)

    late = lambda rows, lead: rows.select(*[F.col(f"{lead}.{c}").alias(f"e_{c}") for c in _OF_LINE], *[F.col(c).alias(f"l_{c}") for c in _OF_LINE])
    top = met.where("salt >= 0").groupBy("token").agg(F.min("lead").alias("top"))
    pairs = stages.keep(_allowed(late(met, "lead").unionByName(late(met.join(top, "token"), "top"))), "pairs")
    found = _similar(lines, pairs, classes, stages)
    open_ = met.join(found.select(*[F.col(f"l_{c}").alias(c) for c in _LINE]).distinct(), _LINE, "left_anti")
    rest = _allowed(_side(met, "e").join(_side(open_, "l"), "token")).join(pairs, _PAIR, "left_anti")
    more = _similar(lines, stages.keep(rest, "pairs"), classes, stages)
    near = found.unionByName(more).select(*[F.col(f"l_{c}").alias(c) for c in _LINE])
    out = stages.keep(near.unionByName(equal).distinct(), "repeated")
    stages.drop(equal, met, lines, pairs)
    return out


def _texts(docs: DataFrame, key: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).alias("text")).where("id is not null and text is not null")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, no (from 0) of every line similar to an earlier one.

    Lines are split at line breaks; those without words are never removed. Rows that repeat an id count as one document, so
    lines at the same place of them are neither earlier nor later. Null texts and ids have no lines."""
    return _repeated(_texts(docs, row_key(docs, id_col, text_col), id_col, text_col)).select(F.col("id").alias(id_col), "no").distinct()


def _similar(lines: DataFrame, pairs: DataFrame, classes: Column, stages: Stages) -> DataFrame:
    """Pairs whose whole sets are similar enough; lines: id, key, no and line of all that pairs are made of."""
    num, den = SIMILARITY
    end = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in _LINE])
    ends = pairs.select(F.explode(F.array(end("e"), end("l"))).alias("p")).select("p.*").distinct()
    sets = stages.keep(lines.select(*_LINE, "line").join(ends, _LINE).select(*_LINE, shingles(F.col("line"), classes).alias("t")), "sets")
    side = lambda s: sets.select(*[F.col(c).alias(f"{s}_{c}") for c in _LINE], F.col("t").alias(f"{s}_t"))
    both = pairs.join(side("l"), [f"l_{c}" for c in _LINE]).join(side("e"), [f"e_{c}" for c in _LINE])
    shared = F.size(F.array_intersect("e_t", "l_t"))
    out = stages.keep(both.where(shared * den >= num * (F.size("e_t") + F.size("l_t") - shared)).select(*_PAIR), "similar")
    stages.drop(sets)
    return out


def _decided(docs: DataFrame, id_col: str, text_col: str, *columns: str | Column) -> DataFrame:
    """The given columns of docs with _ln_gone: the numbers of the removed lines of a row, null where none is."""
    key = row_key(docs, id_col, text_col)
    gone = _repeated(_texts(docs, key, id_col, text_col)).groupBy(F.col("id").alias("_ln_id"), F.col("key").alias("_ln_key")).agg(F.sort_array(F.collect_set("no")).alias("_ln_gone"))
    rows = docs.select(*columns, F.col(id_col).alias("_ln_of"), key.alias("_ln_text"))
    return rows.join(gone, (rows["_ln_of"] == gone["_ln_id"]) & (rows["_ln_text"] == gone["_ln_key"]), "left")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_lines, n_removed, removed (numbers of the removed lines of this row's text, ascending)."""
    # counted before the join, so that no text is dealt out for it
    n_lines = F.greatest(F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)), F.lit(0)).cast("long")
    out = _decided(docs, id_col, text_col, F.col(id_col), n_lines.alias("n_lines"))
    removed = F.coalesce("_ln_gone", F.array().cast("array<int>"))
    return out.select(id_col, "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that are similar to earlier ones; a document that loses all its words goes, others stay.

    Null and empty texts, and rows without an id, stay as they are. Rows that repeat an id each lose lines of their own text."""
    lines = F.split(text_col, "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("_ln_gone", i), x)), lambda x: x.isNotNull())
    out = _decided(docs, id_col, text_col, "*").withColumn(text_col, F.when(F.col("_ln_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    return out.where(F.col("_ln_gone").isNull() | F.col(text_col).rlike("[^ \\t\\n\\u000B\\f\\r]")).select(*[f"`{c}`" for c in docs.columns])
