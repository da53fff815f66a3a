"""Table maintenance on plain folders: append, evolve, upsert, retain, snapshot, recover.

A new version of a table goes to a new folder; readers switch to the path returned. Old folders are the backups.
"""
from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobstrata.operators.quality import column_difference
from jobstrata.operators.scale import running_position
from jobstrata.session import Stages, delete_path, folder_names, scratch_path
from jobstrata.sources.documents import source_order

SHOWN_RETENTION_DAYS, GIG_RETENTION_DAYS = 21, 10
SUMMARY = "ПІДСУМОК"


def append_strict(df: DataFrame, path: str, columns: list[str], partition_by: list[str] | None = None) -> None:
    """Append rows of exactly the table's columns; an unknown column is an error."""
    unknown, missing = column_difference(df, columns)
    if unknown or missing:
        raise ValueError(f"columns do not fit: unknown {unknown}, missing {missing}")
    writer = df.select(*columns).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def evolve_schema(old: DataFrame, columns: list[str]) -> DataFrame:
    """Adds missing columns empty, keeps the order of `columns`, refuses unknown ones."""
    unknown, missing = column_difference(old, columns)
    if unknown:
        raise ValueError(f"unknown columns {unknown}: the schema is not changed by itself")
    return old.select(*[F.lit(None).cast("string").alias(c) if c in missing else F.col(c) for c in columns])


def unseen(new: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, one per key."""
    new = new.dropDuplicates(keys)
    return new if stored is None else new.join(stored.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], pos: str | None = None) -> DataFrame:
    """New rows replace the last old row with their key or are appended; `action` says which.

    With `pos` only the last of several old rows with the key is replaced, the others stay."""
    marks = new.select(*keys).distinct()
    kept = old.join(marks, keys, "left_anti")
    if pos is not None:
        last = old.join(marks, keys, "left_semi").groupBy(*keys).agg(F.max(pos).alias("_last"))
        kept = old.join(last, keys, "left").where(F.col("_last").isNull() | (F.col(pos) < F.col("_last"))).drop("_last")
    known = old.select(*keys).distinct().withColumn("_known", F.lit(True))
    placed = new.join(known, keys, "left").withColumn("action", F.when(F.col("_known"), "updated").otherwise("appended")).drop("_known")
    return kept.withColumn("action", F.lit("kept")).unionByName(placed)


def retain(log: DataFrame, run_date: Column, days: int, new: DataFrame, day: str = "shown_date") -> DataFrame:
    """Entries of the last `days` days plus this run's; entries without a readable date go."""
    d = F.when(F.col(day).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.col(day), "yyyy-MM-dd"))
    return log.where(d >= F.date_sub(run_date, days)).unionByName(new)


def upsert_days(spark: SparkSession, path: str, schema: str, new: DataFrame, keys: list[str], day: str) -> None:
    """Upsert into a stored table with a folder for each `day`: only the days of `new` are read and written again.

    Rows of one key lie in one day. Files of all other days keep their names. Rows without a day have a folder of
    their own, like any other day."""
    stages = Stages(spark)
    new = stages.keep(new, "new")
    here = [f"{path}/{n}" for n in folder_names(spark, path) if n.startswith(f"{day}=")]
    if here:
        touched = new.select(F.col(day).alias("_day")).distinct()
        stored = spark.read.schema(schema).option("basePath", path).parquet(path)
        old = stored.join(touched, F.col(day).eqNullSafe(F.col("_day")), "left_semi")
        merged = stages.keep(upsert(old, new, keys).drop("action"), "merged")
    else:
        merged = new
    merged.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    stages.drop(new, *([merged] if here else []))


def retain_days(spark: SparkSession, path: str, day: str, run_date: date, days: int) -> list[str]:
    """Removes the folders of days more than `days` before the run and of days that cannot be read; no row is read."""
    def old(name: str) -> bool:
        try:
            return date.fromisoformat(name.split("=", 1)[1]) < run_date - timedelta(days=days)
        except ValueError:
            return True
    gone = sorted(n for n in folder_names(spark, path) if n.startswith(f"{day}=") and old(n))
    for name in gone:
        delete_path(spark, f"{path}/{name}")
    return gone


LOG = "row_no long, source string, label string, result string, code string, detail string"


def write_log(decisions: DataFrame, registry: list[str], path: str, summary: Column, pos: str = "card_id", stride: int = 10_000) -> None:
    """The log of each `run_date`: sources in registry order, others after them by name, then by `pos`; a summary row last.

    `run_date` is text. A day that has logs already gets the next `run_index`. `summary` aggregates a run's decisions to the text of its
    last row. Every file holds a sorted range of row numbers, so reading by `row_no` gives the order back."""
    spark, stages = decisions.sparkSession, Stages(decisions.sparkSession)
    d = stages.keep(decisions.select("run_date", "source", "label", "result", "code", "detail", pos), "log")
    sizes = d.groupBy("run_date", "source").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("run_date").orderBy(*source_order(F.col("source"), registry)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("run_date", F.col("source").alias("_source"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = running_position(d.withColumn("_group", F.coalesce("source", F.lit(""))), ["run_date", "_group"], pos, stride, "_at")
    rows = (placed.join(offsets, (placed["run_date"] == offsets["run_date"]) & placed["source"].eqNullSafe(offsets["_source"]))
            .select(placed["run_date"], (F.col("_offset") + F.col("_at")).alias("row_no"), "source", "label", "result", "code", "detail"))
    mark = F.lit(SUMMARY)
    last = d.groupBy("run_date").agg((F.count(F.lit(1)) + 1).alias("row_no"), summary.alias("detail")).select(
        "run_date", "row_no", mark.alias("source"), mark.alias("label"), mark.alias("result"), F.lit("—").alias("code"), "detail")
    taken = [(n.split("=", 1)[1], 1 + max(int(i.split("=")[1]) for i in folder_names(spark, f"{path}/{n}") if i.startswith("run_index=")))
             for n in folder_names(spark, path) if n.startswith("run_date=")]
    known = spark.createDataFrame(taken, "run_date string, run_index int")
    out = rows.unionByName(last).join(known, "run_date", "left").withColumn("run_index", F.coalesce("run_index", F.lit(0)))
    order = ["run_date", "run_index", "row_no"]
    out.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("run_date", "run_index").parquet(path)
    stages.drop(d)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LOG}, run_date string, run_index int").parquet(path).orderBy("run_date", "run_index", "row_no")


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Decisions partitioned by run and repetition; the summary of a run is its own table."""
    decisions.write.mode("append").partitionBy("run_date", "run_index").parquet(f"{path}/rows")
    (decisions.groupBy("run_date", "run_index", "result").agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{path}/summary"))


def dead_letters(rows: DataFrame, kind: str, reason: Column) -> DataFrame:
    """Rows that could not be stored, as JSON with the reason (200 characters)."""
    return rows.select(F.lit(kind).alias("kind"), F.substring(reason, 1, 200).alias("reason"), F.to_json(F.struct(*rows.columns)).alias("row_json"))


def write_csv(df: DataFrame, path: str) -> bool:
    """CSV with a header; nothing is written for an empty result."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").options(header=True).csv(path)
    return True


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], title: str) -> DataFrame:
    """Writes every table below one title and reads it back: (table_name, rows, stored, ok)."""
    root = scratch_path(spark, title)
    out = None
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")
        count = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
        row = count(df, "rows").select(F.lit(name).alias("table_name"), "rows", count(spark.read.parquet(f"{root}/{name}"), "stored").scalar().alias("stored"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.col("rows") == F.col("stored"))


def recover_pending(table: DataFrame, pending: DataFrame) -> DataFrame:
    """The table without the rows of commits that never finished: pending has (run_id, channel)."""
    return table.join(pending.select("run_id", "channel").distinct(), ["run_id", "channel"], "left_anti")


def pending_commits(markers: DataFrame) -> DataFrame:
    """Markers begun and not finished."""
    begun, done = markers.where("state = 'begin'"), markers.where("state = 'finish'")
    return begun.join(done, ["run_id", "channel"], "left_anti").select("run_id", "channel").distinct()


def backfill(fetched: DataFrame, ledger: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fetched posts the ledger knows (and the raw store lacks), and per channel how many were saved and are missing."""
    keys = ["channel", "post_id"]
    wanted = ledger.select(*keys).distinct()
    got = fetched.join(wanted, keys, "left_semi")
    saved = unseen(got, stored, keys)
    report = (wanted.join(got.select(*keys).distinct().withColumn("_got", F.lit(True)), keys, "left").groupBy("channel").agg(F.count_if(F.col("_got").isNull()).alias("missing"))
              .join(saved.groupBy("channel").agg(F.count(F.lit(1)).alias("saved")), "channel", "left").select("channel", F.coalesce("saved", F.lit(0)).alias("saved"), "missing"))
    return saved, report
