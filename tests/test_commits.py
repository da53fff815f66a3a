"""Committed micro-batches: stops between any two steps, gaps of channels, expiry of shown keys, broken records."""
import tempfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobstrata.streaming import collection, commits

POSTS, DETAILS = "channel string, read_id long, post_id long, ts timestamp, at_start boolean", "channel string, post_id long"
DAY0 = datetime(2026, 8, 1)


def feed(spark, *rows):
    """(channel, read, post, at_start): a post's number is its day."""
    return spark.createDataFrame([(c, r, p, DAY0 + timedelta(days=p), s) for c, r, p, s in rows], collection.FEED)


def collect(spark, root, after=lambda step: None):
    log = collection.collection_log(spark, f"{root}/tables", POSTS, DETAILS)
    registry = spark.createDataFrame([("a",), ("b",), ("never",)], "channel string")
    write = collection.collector(log, registry, F.lit(DAY0).cast("timestamp"), lambda posts: posts.where("post_id % 2 = 0").select("channel", "post_id"), after)
    return log, write


def rows(log, name="posts"):
    return sorted((r["channel"], r["post_id"]) for r in log.read(name).collect())


PARTS = [[("a", 1, 1, True), ("a", 1, 2, False), ("b", 1, 1, True)],
         [("a", 2, 2, False), ("a", 2, 3, False), ("a", 2, 3, False), ("b", 2, 5, False), ("b", 2, 6, False)],
         [("a", 3, 4, False), ("a", 3, 3, False), ("b", 3, 1, False), ("b", 3, 4, False), ("b", 3, 5, False), ("b", 3, 6, False)]]
ALL = [("a", i) for i in (1, 2, 3, 4)] + [("b", i) for i in (1, 4, 5, 6)]


def test_a_gap_is_not_written_and_made_up_for_later(spark):
    root = tempfile.mkdtemp()
    log, write = collect(spark, root)
    commits.deliver([feed(spark, *p) for p in PARTS[:2]], write, f"{root}/feed")
    assert rows(log) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert {r["channel"]: r["mark"] for r in log.read("marks").collect()} == {"a": 3, "b": 1}
    assert {r["channel"]: r["status"] for r in log.read("statuses").where("batch_id = 1").collect()} == {"a": "ok", "b": "gap", "never": "empty"}
    feed(spark, *PARTS[2]).write.parquet(f"{root}/feed/in/002")
    commits.run_batches(spark.readStream.schema(collection.FEED).option("recursiveFileLookup", "true").parquet(f"{root}/feed/in"), write, f"{root}/feed/state")
    assert rows(log) == ALL and rows(log, "details") == [r for r in ALL if r[1] % 2 == 0]


@pytest.mark.parametrize("step", ["begin", "details", "posts", "statuses", "marks", "finish"])
def test_a_stop_after_any_step_ends_with_the_same_tables(spark, step):
    root = tempfile.mkdtemp()

    class Stop(Exception):
        pass

    stop_at = []

    def after(done):
        if done in stop_at:
            stop_at.remove(done)
            raise Stop

    log, write = collect(spark, root, after)
    write(feed(spark, *PARTS[0]), 0)
    stop_at.append(step)
    with pytest.raises(Stop):
        write(feed(spark, *PARTS[1]), 1)
    if step != "finish":  # nothing of the unfinished batch is seen
        assert rows(log) == [("a", 1), ("a", 2), ("b", 1)] and {r["channel"]: r["mark"] for r in log.read("marks").collect()} == {"a": 2, "b": 1}
        assert log.pending() == [1]
    taken = log.recover()
    assert log.pending() == [] and (step != "marks" or {n: k for _, n, k in taken} == {"details": 0, "posts": 1, "statuses": 3, "marks": 2})
    write(feed(spark, *PARTS[1]), 1)  # the batch is delivered again
    write(feed(spark, *PARTS[1]), 1)
    write(feed(spark, *PARTS[2]), 2)
    assert rows(log) == ALL and log.last() == 2


def test_reads_of_one_delivery_are_folded_in_order(spark):
    marks = spark.createDataFrame([("a", 10), ("b", 10)], collection.MARKS)
    d = feed(spark, ("a", 1, 9, False), ("a", 1, 20, False), ("a", 2, 18, False), ("a", 2, 30, False), ("b", 1, 12, False), ("b", 2, 10, False), ("b", 2, 15, False), ("c", 1, 5, False))
    got = {r["channel"]: (r["mark"], r["advanced"], r["good"]) for r in collection.complete_reads(d, marks, F.lit(DAY0).cast("timestamp")).collect()}
    assert got == {"a": (10, 30, [1, 2]), "b": (10, 15, [2]), "c": (0, 0, [])}


def shown(days_of, n):
    """Row by row."""
    out, last = [], None
    for d in sorted(set(days_of)):
        if last is None or (d - last).days > n:
            out.append(d)
            last = d
    return out


def test_shown_again_only_after_the_period_however_batches_are_cut(spark):
    import random
    rng = random.Random(5)
    days = {k: sorted(rng.choices(range(60), k=12)) for k in ("x", "y", "z", None)}
    day = lambda i: date(2026, 1, 1) + timedelta(days=i)
    want = sorted((str(k), d) for k, v in days.items() for d in shown([day(i) for i in v], 7))
    all_rows = [(k, day(i)) for k, v in days.items() for i in v]
    for cuts in ([60], [9, 10, 30, 31, 60]):
        log = collection.shown_log(spark, f"{tempfile.mkdtemp()}/t", "k string")
        write, lo = collection.show_once(log, ["k"], 7), 0
        for b, hi in enumerate(cuts):
            write(spark.createDataFrame([r for r in all_rows if day(lo) <= r[1] < day(hi)] + [("no day", None)], "k string, day date"), b)
            lo = hi
        assert sorted((str(r["k"]), r["day"]) for r in log.read("shown").collect()) == want
        state = log.read("latest").collect()
        assert all((r["newest"] - r["last"]).days <= 7 for r in state) and len(state) <= 4
    write(spark.createDataFrame([("late", day(2))], "k string, day date"), len(cuts))
    assert log.read("shown").where("k = 'late'").count() == 0


def test_a_broken_source_leaves_the_others_alone(spark):
    root = tempfile.mkdtemp()
    log = collection.intake_log(spark, f"{root}/t", "id long")
    part = lambda *r: spark.createDataFrame(r, "source string, value string")
    commits.deliver([part(("a", '{"id": 1}'), ("b", '{"id": ')), part(("a", '{"id": 2}'), ("b", None), ("c", '{"id": 3}'), ("c", "x"))], collection.intake(log, "id long"), f"{root}/feed")
    assert {r["source"]: (r["cards"], r["corrupt"], r["status"]) for r in collection.health(log).collect()} == {"a": (2, 0, "OK"), "b": (0, 2, "недоступне"), "c": (1, 1, "ЧАСТКОВО")}
    assert sorted(r["id"] for r in log.read("rows").collect()) == [1, 2, 3] and log.read("dead_letters").count() == 3


def test_nothing_delivered(spark):
    log, write = collect(spark, tempfile.mkdtemp())
    assert log.read("posts").count() == 0 and log.recover() == []
    write(spark.createDataFrame([], collection.FEED), 0)
    assert log.read("posts").count() == 0 and log.read("statuses").where("status = 'empty'").count() == 3
