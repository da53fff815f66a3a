"""Collection of channels, intake of records and the shown-once rule as streams over committed tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobstrata.session import Stages
from jobstrata.streaming.commits import CommitLog

COLLECTED, GAP, EMPTY = "ok", "gap", "empty"
FEED = "channel string, read_id long, post_id long, ts timestamp, at_start boolean"
MARKS, STATUSES = "channel string, mark long", "channel string, status string"


def collection_log(spark: SparkSession, root: str, posts: str, details: str) -> CommitLog:
    """Posts and what is derived from them, channel statuses, and the channels' high-water marks, committed together."""
    return CommitLog(spark, root, {"details": details, "posts": posts, "statuses": STATUSES, "marks": MARKS}, ("marks",))


def complete_reads(feed: DataFrame, marks: DataFrame, since: Column) -> DataFrame:
    """One row per channel: mark before, `advanced` mark, `good` reads and all `reads`.

    A read is complete if it reached the mark as the complete reads before it left it, a post before `since`, or the
    channel's first post. Reads are folded in order, so a gap between two reads of one delivery is seen too."""
    per_read = feed.groupBy("channel", "read_id").agg(
        F.min("post_id").alias("lo"), F.max(F.when(F.col("ts") >= since, F.col("post_id"))).alias("hi"),
        F.coalesce(F.bool_or((F.col("ts") < since) | F.coalesce("at_start", F.lit(False))), F.lit(False)).alias("reached"))
    reads = per_read.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("read_id", "lo", "hi", "reached"))).alias("reads"))
    d = reads.join(marks, "channel", "left").withColumn("mark", F.coalesce("mark", F.lit(0).cast("long")))
    start = F.struct(F.col("mark").alias("mark"), F.array().cast("array<long>").alias("good"))

    def step(acc: Column, read: Column) -> Column:
        grown = F.struct(F.greatest(acc["mark"], read["hi"]).alias("mark"), F.concat(acc["good"], F.array(read["read_id"])).alias("good"))
        return F.when(read["reached"] | (read["lo"] <= acc["mark"]), grown).otherwise(acc)

    folded = d.withColumn("_f", F.aggregate("reads", start, step))
    return folded.select("channel", "mark", F.col("_f.mark").alias("advanced"), F.col("_f.good").alias("good"), F.col("reads.read_id").alias("reads"))


def collector(log: CommitLog, registry: DataFrame, since: Column, details: Callable[[DataFrame], DataFrame],
              after: Callable[[str], None] = lambda step: None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: new posts of complete reads are written, their channels' marks move, in one commit.

    A channel with an incomplete read keeps its mark and status `gap`, so a later read that reaches the mark brings
    what is missing; a channel of the registry without any row is `empty`. Of a post in several reads the last wins."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= log.last():
            return
        stages = Stages(log.spark)
        feed, marks = stages.keep(batch, "feed"), log.read("marks")
        state = stages.keep(complete_reads(feed, marks, since), "reads")
        good = state.select("channel", "mark", F.explode("good").alias("read_id"))
        rows = feed.join(good, ["channel", "read_id"]).where((F.col("post_id") > F.col("mark")) & (F.col("ts") >= since)).drop("mark")
        rest = F.struct(*[c for c in rows.columns if c not in ("channel", "post_id")])
        posts = stages.keep(rows.groupBy("channel", "post_id").agg(F.max_by(rest, "read_id").alias("_r")).select("channel", "post_id", "_r.*"), "posts")
        found = F.when(F.col("reads").isNull(), EMPTY).when(F.size("good") < F.size("reads"), GAP).otherwise(COLLECTED)
        moved = state.select("channel", F.col("advanced").alias("mark"))
        log.commit(batch_id, {
            "details": details(posts), "posts": posts,
            "statuses": registry.select("channel").distinct().join(state, "channel", "full").select("channel", found.alias("status")),
            "marks": marks.unionByName(moved).groupBy("channel").agg(F.max("mark").alias("mark"))}, after)
        stages.drop(feed, state, posts)
    return write


def intake_log(spark: SparkSession, root: str, schema: str) -> CommitLog:
    return CommitLog(spark, root, {"rows": f"source string, {schema}", "dead_letters": "source string, value string",
                                   "health": "source string, cards long, corrupt long"}, ("health",))


def intake(log: CommitLog, schema: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over (source, value): readable records, dead letters and running counts per source.

    A record that cannot be read harms neither its batch nor other sources; a null value is a dead letter."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= log.last():
            return
        stages = Stages(log.spark)
        record = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        lines = stages.keep(batch.select("source", "value", record.alias("r")), "lines")
        bad = F.col("value").isNull() | F.col("r._corrupt").isNotNull()
        counts = lines.groupBy("source").agg(F.count_if(~bad).alias("cards"), F.count_if(bad).alias("corrupt"))
        log.commit(batch_id, {
            "rows": lines.where(~bad).select("source", "r.*"), "dead_letters": lines.where(bad).select("source", "value"),
            "health": log.read("health").unionByName(counts).groupBy("source").agg(F.sum("cards").alias("cards"), F.sum("corrupt").alias("corrupt"))})
        stages.drop(lines)
    return write


def health(log: CommitLog) -> DataFrame:
    """Status of every source so far."""
    status = F.when(F.col("cards") == 0, "недоступне").when(F.col("corrupt") > 0, "ЧАСТКОВО").otherwise("OK")
    return log.read("health").withColumn("status", status)


def shown_log(spark: SparkSession, root: str, keys: str) -> CommitLog:
    """`shown`: keys and the days they were shown; `latest`: the last of these days of each key that still counts."""
    return CommitLog(spark, root, {"shown": f"{keys}, day date", "latest": f"{keys}, last date, newest date"}, ("latest",))


def show_once(log: CommitLog, keys: list[str], days: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over (keys, day): a key is shown unless it was on one of the `days` days before.

    `newest`, the latest day seen, is the watermark: what was last shown more than `days` days before it leaves the
    state, and rows from before that are late and not shown. Rows without a day are not shown. A key's days are
    folded in order, so the result does not depend on how the days are cut into batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= log.last():
            return
        stages = Stages(log.spark)
        latest = log.read("latest")
        seen = latest.agg(F.max("newest")).scalar()
        rows = batch.where(F.col("day").isNotNull()).groupBy(*keys, "day").agg(F.lit(1).alias("_one"))
        fresh = stages.keep(rows.where(seen.isNull() | (F.col("day") >= F.date_sub(seen, days))).select(*keys, "day"), "days")
        per_key = fresh.groupBy(*keys).agg(F.array_sort(F.collect_list("day")).alias("_days"))
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        both = per_key.alias("a").join(latest.alias("b"), same, "full").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], "_days", "last")
        start = F.struct(F.col("last").alias("last"), F.array().cast("array<date>").alias("shown"))

        def step(acc: Column, day: Column) -> Column:
            again = F.struct(day.alias("last"), F.concat(acc["shown"], F.array(day)).alias("shown"))
            return F.when(acc["last"].isNull() | (F.datediff(day, acc["last"]) > days), again).otherwise(acc)

        folded = stages.keep(both.select(*keys, F.aggregate(F.coalesce("_days", F.array().cast("array<date>")), start, step).alias("_f")), "folded")
        newest = F.greatest(fresh.agg(F.max("day")).scalar(), seen)
        log.commit(batch_id, {
            "shown": folded.select(*keys, F.explode("_f.shown").alias("day")),
            "latest": folded.select(*keys, F.col("_f.last").alias("last"), newest.alias("newest")).where(F.col("last") >= F.date_sub("newest", days))})
        stages.drop(fresh, folded)
    return write
