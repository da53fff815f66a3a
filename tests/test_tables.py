"""Stored tables: only touched days are written again, old days go, a log reads back in its order."""
import glob
import tempfile
from datetime import date

from pyspark.sql import functions as F

from jobstrata.operators import tables

SCHEMA = "k long, v string, day date"


def files(path):
    return {f for f in glob.glob(f"{path}/day=*/*.parquet")}


def test_upsert_writes_only_the_days_it_touches(spark):
    path = f"{tempfile.mkdtemp()}/t"
    rows = lambda *r: spark.createDataFrame([(k, v, d and date(2026, 8, d)) for k, v, d in r], SCHEMA)
    tables.upsert_days(spark, path, SCHEMA, rows((1, "a", 1), (2, "b", 1), (3, "c", 2), (4, "d", 30), (5, "e", None)), ["k"], "day")
    before = files(path)
    tables.upsert_days(spark, path, SCHEMA, rows((2, "B", 1), (6, "f", 1), (7, "g", 9), (5, "E", None)), ["k"], "day")
    after = files(path)
    untouched = {f for f in before if "day=2026-08-02" in f or "day=2026-08-30" in f}
    assert len(untouched) == 2 and untouched <= after and not (before - untouched) & after
    read = lambda: sorted((r["k"], r["v"]) for r in spark.read.schema(SCHEMA).parquet(path).collect())
    assert read() == [(1, "a"), (2, "B"), (3, "c"), (4, "d"), (5, "E"), (6, "f"), (7, "g")]
    gone = tables.retain_days(spark, path, "day", date(2026, 8, 23), 21)
    assert gone == ["day=2026-08-01", "day=__HIVE_DEFAULT_PARTITION__"] and read() == [(3, "c"), (4, "d"), (7, "g")]


def test_a_log_reads_back_in_its_order_and_repeats_are_numbered(spark):
    path = f"{tempfile.mkdtemp()}/log"
    schema = "run_date string, source string, label string, result string, code string, detail string, card_id long"
    rows = [("2026-08-01", s, f"{s}{i}", "показано", "—", "", 30_000 * i) for i in range(5) for s in ("z", "b", "a", "q")] + [("2026-08-02", None, "n", "x", "y", "", 1)]
    d = spark.createDataFrame(rows, schema)
    for _ in range(2):
        tables.write_log(d, ["q", "a"], path, F.concat(F.lit("усього "), F.count(F.lit(1)).cast("string")))
    got = tables.read_log(spark, path).collect()
    want = [f"{s}{i}" for s in ("q", "a", "b", "z") for i in range(5)] + ["ПІДСУМОК"]
    for run in (0, 1):
        one = [r for r in got if r["run_date"] == "2026-08-01" and r["run_index"] == run]
        assert [r["label"] for r in one] == want and [r["row_no"] for r in one] == list(range(1, 22)) and one[-1]["detail"] == "усього 20"
    assert [(r["label"], r["run_index"]) for r in got if r["run_date"] == "2026-08-02"] == [("n", 0), ("ПІДСУМОК", 0), ("n", 1), ("ПІДСУМОК", 1)]
