"""Log rows of the boards → unique site postings.

In date order a row belongs to the posting its url opened; else to the latest posting with its title and company seen
at most 30 days ago; else it opens a posting and registers its url. Which urls get registered depends on every earlier
row, so the openings are found as a fixpoint: with a guess of them, each row is either bound to a posting by url or free;
among a key's rows an opening is a free row more than the window after the one before. The guess is right up to the
first wrong opening in time, so each round gets further, and it stops when nothing changes. A round is a join on the
url, a partial aggregate per key and window-wide bucket and a window over those few buckets; no key is gathered whole.
After the second round only what a changed opening can reach is looked at again: the keys of the rows with its url, of the
posting that had registered the url and of the one that does now.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.functions import text, urls
from jobstrata.session import cut_lineage

RANK = {"shown": 3, "applied": 2, "personal_reject": 1, "technical": 0}
KEY = ["tk", "ck"]


def _keyed(rows: DataFrame, pos: Column) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("status")]
    return rows.select(text.norm_title(F.col("title")).alias("tk"), text.company_key(F.col("company")).alias("ck"), F.nullif(urls.url_key(F.col("url")), F.lit("")).alias("uk"),
                       F.struct(F.unix_date("day").alias("d"), pos.alias("p")).alias("at"), rank.alias("rank"), "title", "company", "url")


def _registered(openings: DataFrame) -> DataFrame:
    """uk, g: the opening that registered each url."""
    return openings.where(F.col("uk").isNotNull()).groupBy("uk").agg(F.min(F.struct("at", *KEY, "next")).alias("g"))


def _bound(rows: DataFrame, reg: DataFrame) -> DataFrame:
    """Rows with the posting their url opened earlier (gk, gat, gnext), null for free rows."""
    return rows.join(reg, "uk", "left").withColumn("g", F.when(F.col("g.at") < F.col("at"), F.col("g")))


def _events(bound: DataFrame) -> DataFrame:
    """Key, at, free, uk of the rows that are free or keep the posting they are bound to open."""
    latest = F.col("g.next").isNull() | (F.col("at") < F.col("g.next"))
    return bound.where(F.col("g").isNull() | latest).select(*[F.coalesce(F.col(f"g.{k}"), F.col(k)).alias(k) for k in KEY], "at", F.col("g").isNull().alias("free"), "uk")


def _openings(events: DataFrame, window: int) -> DataFrame:
    """Openings (tk, ck, at, uk, next) that follow from events."""
    per = events.groupBy(*KEY, F.floor(F.col("at.d") / window).alias("b")).agg(F.min(F.struct("at", "free", "uk")).alias("first"), F.max("at.d").alias("last"))
    w = Window.partitionBy(*KEY).orderBy("b")
    before = F.lag("last").over(w)
    opened = per.withColumn("_open", F.col("first.free") & (before.isNull() | (F.col("first.at.d") - before > window))).where("_open")
    return opened.select(*KEY, F.col("first.at").alias("at"), F.col("first.uk").alias("uk"), F.lead("first.at").over(w).alias("next"))


def _reached(rows: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose events differ between two guesses: those of rows with a url whose registration changed, and of both
    registrations."""
    o, n = (_registered(d).withColumnRenamed("g", f"g{i}") for i, d in enumerate((old, new)))
    urls_ = cut_lineage(o.join(n, "uk", "full").where("not g0 <=> g1"))
    own = rows.join(urls_.select("uk"), "uk", "left_semi").select(*KEY)
    of = [urls_.where(f"g{i} is not null").select(*[F.col(f"g{i}.{k}").alias(k) for k in KEY]) for i in (0, 1)]
    return own.unionByName(of[0]).unionByName(of[1]).distinct()


def _again(rows: DataFrame, openings: DataFrame, keys: DataFrame, window: int) -> DataFrame:
    """Openings that follow for `keys`: from their own rows and the rows bound to them by url."""
    reg = _registered(openings)
    bound_to = reg.join(keys.select(*[F.col(k).alias(f"_{k}") for k in KEY]), (F.col("g.tk") == F.col("_tk")) & (F.col("g.ck") == F.col("_ck")), "left_semi").select("uk", F.lit(True).alias("_by_url"))
    near = rows.join(keys.withColumn("_own", F.lit(True)), KEY, "left").join(bound_to, "uk", "left").where("_own or _by_url").drop("_own", "_by_url")
    return _openings(_events(_bound(near, reg)).join(keys, KEY, "left_semi"), window)


def settled_openings(rows: DataFrame, window: int) -> tuple[DataFrame, list[int]]:
    """The openings that follow from themselves, and how many keys each round after the first looked at again."""
    guess = cut_lineage(_openings(rows.select(*KEY, "at", F.lit(True).alias("free"), "uk"), window))
    openings = cut_lineage(_openings(_events(_bound(rows, _registered(guess))), window))
    looked_at = []
    while True:
        keys = cut_lineage(_reached(rows, guess, openings))
        looked_at.append(keys.count())
        if looked_at[-1] == 0:
            return openings, looked_at
        guess, openings = openings, cut_lineage(openings.join(keys, KEY, "left_anti").unionByName(_again(rows, openings, keys, window)))


def unique_postings(rows: DataFrame, pos: Column, window: int = 30) -> DataFrame:
    """One row per posting with its last day and best status. A posting another one of the same title and company came
    after is `superseded`."""
    rows = cut_lineage(_keyed(rows, pos))
    openings, _ = settled_openings(rows, window)
    j = _bound(rows, _registered(openings))
    spans = openings.withColumn("b", F.floor(F.col("at.d") / window))
    free = j.where(F.col("g").isNull()).withColumn("b", F.floor(F.col("at.d") / window))
    # the posting open in each bucket of a key: its last opening so far
    marks = free.select(*KEY, "b").distinct().join(spans.select(*KEY, "b", F.col("at").alias("gat")), [*KEY, "b"], "left")
    marks = marks.withColumn("gat", F.last("gat", ignorenulls=True).over(Window.partitionBy(*KEY).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
    placed = free.join(marks, [*KEY, "b"]).select(*KEY, "gat", "at", "rank").unionByName(
        j.where(F.col("g").isNotNull()).select(F.col("g.tk").alias("tk"), F.col("g.ck").alias("ck"), F.col("g.at").alias("gat"), "at", "rank"))
    groups = placed.groupBy(*KEY, "gat").agg(F.max("at.d").alias("last"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("rows"))
    birth = rows.select(*KEY, F.col("at").alias("gat"), "title", "company", "url", F.col("at.d").alias("first")).join(
        openings.select(*KEY, F.col("at").alias("gat"), F.col("next").isNotNull().alias("superseded")), [*KEY, "gat"])
    name = F.element_at(F.array(*[F.lit(n) for n, _ in sorted(RANK.items(), key=lambda x: x[1])]), F.col("rank") + 1)
    return groups.join(birth, [*KEY, "gat"]).select("title", "company", "url", F.date_from_unix_date("first").alias("first_day"), F.date_from_unix_date("last").alias("day"),
                                                    name.alias("status"), "rows", "superseded", F.col("gat").alias("idx"))
