"""Queries: streaming forms, run to completion over the given tables and compared with batch SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata.functions import dates
from jobstrata.plans.bindings import ctes, table, view
from jobstrata.plans.q_monitor import RUNS, runs
from jobstrata.plans.registry import query
from jobstrata.session import scratch_path
from jobstrata.streaming import collection, commits, streams

FAR = "2100-01-01 00:00:00"


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _closed(d, split="2024-01-16 00:00:00"):
    """Early rows, late rows, then two far rows whose only job is to move the watermark."""
    far = d.groupBy().agg(*[F.max(c).alias(c) for c in d.columns]).withColumn("ts", F.lit(FAR).cast("timestamp"))
    return [d.where(F.col("ts") < split), d.where(F.col("ts") >= split), far, far.withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 DAYS"))]


@query("t1_posts_above_marks", ctes("posts", ("marks", "SELECT channel, max(post_id) AS mark FROM posts WHERE ts < DATE '1998-01-01' GROUP BY channel")) + "SELECT channel, post_id FROM posts JOIN marks USING (channel) WHERE post_id > mark AND ts >= DATE '1998-01-01'")
def _(spark, sf):
    p = view(spark, sf, "posts").select("channel", "post_id", "ts")
    marks = streams.advance_marks(spark.createDataFrame([], "channel string, mark long"), p.where("ts < DATE '1998-01-01'"))
    return streams.above_marks(p, marks, F.lit("1998-01-01").cast("timestamp")).select("channel", "post_id")


@query("t2_complete_channels", ctes("posts") + "SELECT channel, count(*) AS n FROM posts GROUP BY channel HAVING count(*) FILTER (classified = 'False') * 100 <= 7 * count(*)")
def _(spark, sf):
    p = view(spark, sf, "posts")
    coverage = p.groupBy("channel").agg((F.count_if(F.col("classified") == "False") * 100 <= 7 * F.count(F.lit(1))).alias("complete"))
    return streams.complete_channels(p, coverage).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


SINCE = "1996-01-01 00:00:00"
_CUTS = "SELECT max(post_id) // 3 AS p1, max(post_id) // 3 * 2 AS p2, max(post_id) // 12 AS back FROM posts"
# a channel without a mark starts at 0, so posts are numbered from 1
_COLLECTED = f"SELECT channel, post_id, classified FROM posts, cuts WHERE post_id > 0 AND ts >= TIMESTAMP '{SINCE}' AND NOT (channel = 'ch11' AND post_id > p2)"


def _collect(spark, sf) -> commits.CommitLog:
    """Three deliveries: the second misses the mark of two channels and the third makes up for it; ch11's third misses it."""
    p = view(spark, sf, "posts").select("channel", "post_id", "ts", "classified")
    top = p.agg(F.max("post_id")).first()[0] or 0
    p1, p2, back = top // 3, top // 3 * 2, top // 12
    late = F.col("channel").isin("ch03", "ch07")
    short = F.col("ts") >= SINCE

    def read(i: int, rows: DataFrame, at_start: bool = False) -> DataFrame:
        return rows.select("channel", F.lit(i).cast("long").alias("read_id"), "post_id", "ts", F.lit(at_start).alias("at_start"), "classified")

    post = F.col("post_id")
    parts = [read(1, p.where(post <= p1), True),
             read(2, p.where(post.between(p1 - back, p2) & (~late | ((post > p1 + back) & short)))),
             read(3, p.where(F.when(late, post > p1 - back).when(F.col("channel") == "ch11", (post > p2 + back) & short).otherwise(post > p2 - back)))]
    root = scratch_path(spark, "collection")
    log = collection.collection_log(spark, f"{root}/tables", "channel string, read_id long, post_id long, ts timestamp, classified string", "channel string, post_id long, classified string")
    registry = view(spark, sf, "channels").select(F.col("handle").alias("channel")).unionByName(spark.range(1).select(F.lit("ch99").alias("channel")))
    write = collection.collector(log, registry, F.lit(SINCE).cast("timestamp"), lambda posts: posts.where("classified = 'False'"))
    commits.deliver(parts, write, f"{root}/feed")
    return log


@query("t1_t2_collection_stream", ctes("posts", ("cuts", _CUTS), ("collected", _COLLECTED)) + "SELECT 'posts' AS part, channel, post_id FROM collected UNION ALL SELECT 'details', channel, post_id FROM collected WHERE classified = 'False'")
def _(spark, sf):
    log = _collect(spark, sf)
    return log.read("posts").select(F.lit("posts").alias("part"), "channel", "post_id").unionByName(log.read("details").select(F.lit("details").alias("part"), "channel", "post_id"))


@query("t2_k11_channel_marks", ctes("posts", ("cuts", _CUTS), ("collected", _COLLECTED)) + """SELECT CAST(batch_id AS BIGINT) AS batch_id, channel,
  CASE WHEN channel = 'ch99' THEN 'empty' WHEN batch_id = 1 AND channel IN ('ch03', 'ch07') OR batch_id = 2 AND channel = 'ch11' THEN 'gap' ELSE 'ok' END AS status, mark
FROM (SELECT channel, max(post_id) AS mark FROM collected GROUP BY channel UNION ALL SELECT 'ch99', NULL), (VALUES (0), (1), (2)) b(batch_id)""")
def _(spark, sf):
    log = _collect(spark, sf)
    return log.read("statuses").join(log.read("marks"), "channel", "left").select("batch_id", "channel", "status", "mark")


@query("t3_k6_shown_once", """WITH RECURSIVE d AS MATERIALIZED (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events),
s AS (SELECT user_id, event_type, min(day) AS day FROM d GROUP BY ALL UNION ALL
  SELECT s.user_id, s.event_type, min(d.day) FROM s JOIN d ON d.user_id = s.user_id AND d.event_type = s.event_type AND d.day > s.day + 5 GROUP BY s.user_id, s.event_type)
SELECT user_id, event_type, strftime(day, '%Y-%m-%d') AS day FROM s""")
def _(spark, sf):
    """Five days of expiry over four micro-batches: a repeat inside them is not shown, one after them is shown again."""
    e = _events(spark, sf).select("user_id", "event_type", F.to_date("ts").alias("day"))
    lo, hi = e.agg(F.min("day"), F.max("day")).first()
    step = ((hi - lo).days if lo else 0) // 4 + 1
    root = scratch_path(spark, "shown")
    log = collection.shown_log(spark, f"{root}/tables", "user_id long, event_type string")
    commits.deliver([e.where(F.floor(F.datediff("day", F.lit(lo)) / step) == i) for i in range(4)], collection.show_once(log, ["user_id", "event_type"], 5), f"{root}/feed")
    return log.read("shown").select("user_id", "event_type", dates.day_text(F.col("day")).alias("day"))


@query("t3_dedup_with_expiry", "SELECT user_id, event_type FROM events GROUP BY ALL")
def _(spark, sf):
    """One micro-batch: every repeat falls inside the kept period."""
    s = streams.staged_stream([_events(spark, sf)], "dedup")
    return streams.run_to_files(streams.dedup_with_expiry(s, "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "dedup_out")


_STREAKS = """SELECT source, epoch_us(run_ts) AS run_us, streak FROM (SELECT *, CAST(sum(CASE WHEN cards = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source, g ORDER BY run_ts) AS BIGINT) AS streak FROM (
  SELECT *, sum(CASE WHEN cards > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY run_ts) AS g FROM runs))"""


@query("t4_keyed_streaks", ctes(RUNS) + _STREAKS)
def _(spark, sf):
    r = runs(spark, sf).select("source", dates.micros(F.col("run_ts")).alias("run_us"), "cards", "status")
    lo, hi = r.agg(F.min("run_us"), F.max("run_us")).first()
    step = ((hi or 0) - (lo or 0)) // 3 + 1
    periods = [r.where(F.floor((F.col("run_us") - F.lit(lo or 0)) / step) == i) for i in range(3)]
    return streams.run_in_order(periods, streams.keyed_streaks, "streaks").select("source", "run_us", "streak")


@query("t4_streaks_in_any_order", ctes(RUNS) + _STREAKS)
def _(spark, sf):
    """Runs come up to two days late in four deliveries, then two far ones that move the watermark past all others."""
    r = runs(spark, sf).select("source", dates.micros(F.col("run_ts")).alias("run_us"), "cards", "status")
    lo, hi = r.agg(F.min("run_us"), F.max("run_us")).first()
    two_days = 2 * 86_400_000_000
    came = F.col("run_us") + F.pmod(F.xxhash64("source", "run_us"), F.lit(two_days))
    step = ((hi or 0) + two_days - (lo or 0)) // 4 + 1
    far = [spark.createDataFrame([("~", 4_102_444_800_000_000 + i * 40_000_000_000_000, 1, "OK")], r.schema) for i in range(2)]
    with streams.rocksdb_state(spark):
        out = streams.run_in_order([*[r.where(F.floor((came - F.lit(lo or 0)) / step) == i) for i in range(4)], *far], lambda d: streams.streaks_in_any_order(d, "3 days"), "any_order")
    return out.where("source <> '~'").select("source", "run_us", "streak")


_GAPS = """SELECT user_id, event_type, count(*) AS mentions, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM (SELECT *, sum(o) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 86400000000 THEN 0 ELSE 1 END AS o FROM events)) GROUP BY user_id, event_type, s"""


def _us(d):
    return d.select("user_id", "event_type", "mentions", dates.micros(F.col("first_at")).alias("first_us"), dates.micros(F.col("last_at")).alias("last_us"))


@query("t5_session_stream", _GAPS)
def _(spark, sf):
    s = streams.staged_stream(_closed(_events(spark, sf)), "sessions")
    out = streams.run_to_files(streams.sessions(s, "ts", ["user_id", "event_type"], "1 day", "40 days"), "sessions_out")
    return _us(out.where(F.col("last_at") < FAR))


@query("t5_session_batch", _GAPS)
def _(spark, sf):
    return _us(streams.sessions(_events(spark, sf), "ts", ["user_id", "event_type"], "1 day"))


@query("t6_late_text_of_known_posts", "SELECT source AS channel, doc_id AS post_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    s = streams.staged_stream([table(spark, sf, "documents").select(F.col("source").alias("channel"), F.col("doc_id").alias("post_id"))], "late")
    ledger = table(spark, sf, "labels").select(F.col("doc_id").alias("post_id"))
    return streams.run_to_files(streams.known_only(s, ledger, ["post_id"]), "late_out").select("channel", "post_id")


@query("t7_idempotent_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    """Every batch is delivered twice, as after a crash before the commit."""
    root = scratch_path(spark, "commits")
    write = streams.idempotent_writer(f"{root}/rows")

    def twice(batch, batch_id):
        write(batch, batch_id), write(batch, batch_id)

    s = streams.staged_stream([_events(spark, sf)], "events")
    s.writeStream.foreachBatch(twice).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("t8_weekly_stream", "SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    s = streams.staged_stream(_closed(_events(spark, sf)), "weekly")
    out = streams.run_to_files(streams.weekly(s, "ts", ["event_type"], "40 days"), "weekly_out")
    return out.where(F.col("week_start") < "2099-01-01").select("event_type", dates.day_text(F.col("week_start")).alias("week_start"), "n")


@query("t9_unfinished_stream", "SELECT event_id AS run_id FROM events WHERE value < 3")
def _(spark, sf):
    """A run is an event; it finishes after an hour unless its value is small."""
    e = _events(spark, sf)
    far = e.agg((F.max("event_id") + 1).alias("run_id"))
    at = F.lit(FAR).cast("timestamp")
    started = e.select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"))
    finished = e.where("value >= 3").select(F.col("event_id").alias("run_id"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"))
    more = lambda c: [far.withColumn(c, at), far.withColumn(c, at + F.expr("INTERVAL 400 DAYS"))]
    s = streams.staged_stream([started, *more("started_at")], "started")
    f = streams.staged_stream([finished, *more("finished_at")], "finished")
    out = streams.run_to_files(streams.unfinished(s, f, "2 DAYS"), "unfinished")
    return out.where(F.col("started_at") < FAR).select("run_id")


@query("t10_source_health", "SELECT source, count(*) FILTER (doc_id % 50 <> 0 AND source <> 'src3') AS cards, count(*) FILTER (doc_id % 50 = 0 OR source = 'src3') AS corrupt, CASE WHEN source = 'src3' THEN 'недоступне' WHEN count(*) FILTER (doc_id % 50 = 0) > 0 THEN 'ЧАСТКОВО' ELSE 'OK' END AS status FROM documents GROUP BY source")
def _(spark, sf):
    d = table(spark, sf, "documents")
    broken = (F.col("doc_id") % 50 == 0) | (F.col("source") == "src3")
    return streams.source_health(d.select("source", F.when(broken, '{"title": ').otherwise(F.to_json(F.struct(F.col("doc_id").alias("id")))).alias("value")), "id long")


@query("t10_intake_stream", """SELECT source, count(*) FILTER (NOT bad) AS cards, count(*) FILTER (bad) AS corrupt, CASE WHEN bool_and(bad) THEN 'недоступне' WHEN bool_or(bad) THEN 'ЧАСТКОВО' ELSE 'OK' END AS status,
  coalesce(sum(doc_id) FILTER (NOT bad), 0)::BIGINT AS stored, count(*) FILTER (bad) AS dead FROM (SELECT *, source = 'src3' OR (doc_id % 50 = 0 AND source <> 'src1') AS bad FROM documents) GROUP BY source""")
def _(spark, sf):
    """Two deliveries; one source is broken throughout, the records of all but one other now and then."""
    d = table(spark, sf, "documents")
    broken = (F.col("source") == "src3") | ((F.col("doc_id") % 50 == 0) & (F.col("source") != "src1"))
    lines = d.select("doc_id", "source", F.when(broken, '{"id": ').otherwise(F.to_json(F.struct(F.col("doc_id").alias("id")))).alias("value"))
    half = d.agg(F.max("doc_id")).first()[0] or 0
    root = scratch_path(spark, "intake")
    log = collection.intake_log(spark, f"{root}/tables", "id long")
    commits.deliver([lines.where(c).select("source", "value") for c in (F.col("doc_id") * 2 <= half, F.col("doc_id") * 2 > half)], collection.intake(log, "id long"), f"{root}/feed")
    stored = log.read("rows").groupBy("source").agg(F.sum("id").alias("stored"))
    dead = log.read("dead_letters").groupBy("source").agg(F.count(F.lit(1)).alias("dead"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return collection.health(log).join(stored, "source", "left").join(dead, "source", "left").select("source", "cards", "corrupt", "status", zero("stored"), zero("dead"))
