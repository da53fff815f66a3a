"""Incremental forms of the operators on Structured Streaming; each has a batch twin it must equal."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from jobstrata.session import scratch_path


def run_to_files(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over everything available and returns what it wrote. Rows go to files, not to the driver."""
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def staged_stream(parts: list[DataFrame], name: str) -> DataFrame:
    """A file stream over the parts, written in the order given."""
    spark = parts[0].sparkSession
    root = scratch_path(spark, name)
    for i, p in enumerate(parts):
        p.write.parquet(f"{root}/{i:03d}")
    return spark.readStream.schema(parts[0].schema).option("recursiveFileLookup", "true").parquet(root)


def run_in_order(parts: list[DataFrame], transform: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Delivers the parts one after the other to a stream that goes on from its checkpoint; returns all it wrote.

    However many files a part has, its rows come after those of the parts before it."""
    spark = parts[0].sparkSession
    root = scratch_path(spark, name)
    for i, p in enumerate(parts):
        p.write.parquet(f"{root}/in/{i:03d}")
        stream = transform(spark.readStream.schema(parts[0].schema).option("recursiveFileLookup", "true").parquet(f"{root}/in"))
        (stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def above_marks(posts: DataFrame, marks: DataFrame, since: Column) -> DataFrame:
    """Posts after each channel's high-water mark and not before `since`, one per id."""
    d = posts.join(marks, "channel", "left").where((F.col("post_id") > F.coalesce("mark", F.lit(0))) & (F.col("ts") >= since)).drop("mark")
    return d.dropDuplicates(["channel", "post_id"])


def advance_marks(marks: DataFrame, written: DataFrame) -> DataFrame:
    new = written.groupBy("channel").agg(F.max("post_id").alias("mark"))
    return marks.unionByName(new).groupBy("channel").agg(F.max("mark").alias("mark"))


def complete_channels(posts: DataFrame, coverage: DataFrame) -> DataFrame:
    """Only channels whose read reached the previous mark are written; the others' marks stay where they are."""
    return posts.join(coverage.where("complete").select("channel").distinct(), "channel", "left_semi")


def dedup_with_expiry(stream: DataFrame, ts: str, keys: list[str], keep: str) -> DataFrame:
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Gap sessions per key; with `late` the input is a stream and a session is final once the watermark passed it.

    A session window ends one gap after its last row, so the last row's time is carried along."""
    d = events.withWatermark(ts, late) if late else events
    g = d.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("mentions"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
    return g.select(*keys, "mentions", "first_at", "last_at")


def weekly(events: DataFrame, ts: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts per ISO week (weeks start on Monday: the epoch is a Thursday)."""
    d = events.withWatermark(ts, late) if late else events
    return d.groupBy(*keys, F.window(ts, "1 week", "1 week", "4 days").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("week_start"), "n")


STREAK = "source string, run_us long, streak long, baseline double"


def keyed_streaks(runs: DataFrame) -> DataFrame:
    """Zero streak and median of the last seven OK counts per source, kept as state between micro-batches.

    Input is the run ledger — source, run_us, cards, status, one row per source and run — never raw rows. Rows of a source
    must not come in a later micro-batch than its later runs (see `run_in_order`); inside a micro-batch any order will do."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, recent = state.get if state.exists else (0, [])
        recent, out = list(recent), []
        for run in pd.concat(list(batches)).sort_values("run_us").itertuples():
            base = float(pd.Series(recent).median()) if len(recent) >= 3 else None
            streak = 0 if run.cards > 0 else streak + 1
            out.append((key[0], run.run_us, streak, base))
            if run.status == "OK":
                recent = (recent + [int(run.cards)])[-7:]
        state.update((streak, recent))
        yield pd.DataFrame(out, columns=["source", "run_us", "streak", "baseline"])

    return runs.groupBy("source").applyInPandasWithState(step, STREAK, "streak long, recent array<long>", "append", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """Holds the runs of a source until the watermark has passed them and then folds them in order of time.

    The state is what is not yet final (a list of runs per millisecond) and one row (streak, last seven OK counts)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "runs array<struct<run_us:long,cards:long,ok:boolean>>")
        self.folded = handle.getValueState("folded", "streak long, recent array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for d in rows:
            for ms, part in d.groupby(d.run_us // 1000):
                k, new = (int(ms),), [(int(r.run_us), int(r.cards), r.status == "OK") for r in part.itertuples()]
                held = list(self.waiting.getValue(k)[0]) if self.waiting.containsKey(k) else []
                self.waiting.updateValue(k, (held + new,))
                self.handle.registerTimer(int(ms))
        yield pd.DataFrame(columns=["source", "run_us", "streak", "baseline"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        k = (int(expiredTimerInfo.getExpiryTimeInMs()),)
        runs = sorted(tuple(r) for r in self.waiting.getValue(k)[0])
        self.waiting.removeKey(k)
        streak, recent = self.folded.get() if self.folded.exists() else (0, [])
        recent, out = [int(r) for r in recent], []
        for run_us, cards, ok in runs:
            streak = 0 if cards > 0 else int(streak) + 1
            out.append((key[0], run_us, streak, float(pd.Series(recent).median()) if len(recent) >= 3 else None))
            recent = (recent + [cards])[-7:] if ok else recent
        self.folded.update((streak, recent))
        yield pd.DataFrame(out, columns=["source", "run_us", "streak", "baseline"])

    def close(self) -> None:
        pass


def streaks_in_any_order(runs: DataFrame, late: str) -> DataFrame:
    """As `keyed_streaks`, for runs that come in any order but at most `late` behind the newest; later ones are dropped.

    A run is answered once the watermark has passed it. The session must use the RocksDB state store (`rocksdb_state`)."""
    timed = runs.withColumn("_at", F.timestamp_micros("run_us")).withWatermark("_at", late)
    return timed.groupBy("source").transformWithStateInPandas(_InOrder(), STREAK, "append", "eventTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, on disk and with incremental checkpoints."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def known_only(posts: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Late text of posts the (static) ledger knows."""
    return posts.join(ledger.select(*keys).distinct(), keys, "left_semi")


def idempotent_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that may be called again for a batch: its folder is rewritten, not appended to."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def unfinished(started: DataFrame, finished: DataFrame, wait: str, column: str = "run_id") -> DataFrame:
    """Start markers no finish came for within `wait`, emitted once the watermark passed."""
    s = started.withWatermark("started_at", wait)
    f = finished.select(F.col(column).alias("_fin"), "finished_at").withWatermark("finished_at", wait)
    on = (s[column] == f["_fin"]) & (F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= F.col("started_at") + F.expr(f"INTERVAL {wait}"))
    return s.join(f, on, "left_outer").where(F.col("_fin").isNull()).drop("_fin", "finished_at")


def source_health(lines: DataFrame, schema: str) -> DataFrame:
    """Readable and corrupt records per source: a broken source is a status row, not a failed run."""
    rec = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = lines.select("source", rec.alias("r"))
    bad = F.col("r._corrupt").isNotNull()
    g = d.groupBy("source").agg(F.count_if(~bad).alias("cards"), F.count_if(bad).alias("corrupt"))
    return g.withColumn("status", F.when(F.col("cards") == 0, "недоступне").when(F.col("corrupt") > 0, "ЧАСТКОВО").otherwise("OK"))
