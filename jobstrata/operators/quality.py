"""Verification of what was written: each check is a row (name, ok, reason)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ROWS_SHARE = 0.90


def _row(df: DataFrame, name: str, group: list[str], problems: list[tuple[Column, Column]]) -> DataFrame:
    reason = None
    for bad, why in problems:
        reason = F.when(bad, why) if reason is None else reason.when(bad, why)
    return df.select(*group, F.lit(name).alias("name"), reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def check_decision_log(log: DataFrame, found: DataFrame, group: str, pos: str, modified: Column | None = None) -> DataFrame:
    """The log of a run covers 90 % of what was found and ends with the summary row.

    With `modified` (when a row's file was written, such as `_metadata.file_modification_time`) the run of a day `group`
    must also have rows, and the newest of them must be of that day."""
    is_summary = F.col("result") == "ПІДСУМОК"
    at = F.lit(None).cast("timestamp") if modified is None else modified
    d = log.groupBy(group).agg(F.count_if(~is_summary).alias("rows"), F.max_by(is_summary, pos).alias("closed"), F.max(at).alias("modified"))
    j = found.join(d, group, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    few = F.col("rows") < F.ceil(F.col("found") * MIN_ROWS_SHARE)
    why = F.concat(F.lit("лог відсіву: рядків "), F.col("rows").cast("string"), F.lit(" з "), F.col("found").cast("string"), F.lit(" знайдених (< 90%)"))
    today = []
    if modified is not None:
        other_day = F.concat(F.lit("лог відсіву: modifiedTime "), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" не сьогодні"))
        today = [(F.col("modified").isNull(), F.lit("лог відсіву за сьогодні (запис не виконувався)")), (F.col("modified").cast("date") != F.col(group).cast("date"), other_day)]
    return _row(j, "лог відсіву", [group], [*today, (~F.coalesce("closed", F.lit(False)), F.lit("лог відсіву: останній рядок не «ПІДСУМОК»")), (few, why)])


def check_shown_log(log: DataFrame, own: DataFrame, repeated: DataFrame, group: str) -> DataFrame:
    """As many log lines as shown postings (at least, on a repeated run), and every own line present."""
    lines = log.groupBy(group).agg(F.count(F.lit(1)).alias("count"))
    shown = own.groupBy(group).agg(F.count(F.lit(1)).alias("shown"))
    lost = own.join(log.select(group, "line").distinct(), [group, "line"], "left_anti").groupBy(group).agg(F.count(F.lit(1)).alias("missing"))
    j = shown.join(lines, group, "left").join(lost, group, "left").join(repeated, group, "left").na.fill({"count": 0, "missing": 0, "repeat": False})
    wrong = (F.col("count") < F.col("shown")) | ((F.col("count") != F.col("shown")) & ~F.col("repeat"))
    s = lambda c: F.col(c).cast("string")
    return _row(j, "лог показаних", [group], [
        (wrong, F.concat(F.lit("лог показаних: за сьогодні "), s("count"), F.lit(" рядків, показано "), s("shown"))),
        (F.col("missing") > 0, F.concat(F.lit("лог показаних: не записано "), s("missing"), F.lit(" з "), s("shown"), F.lit(" рядків цього запуску")))])


def check_metrics(metrics: DataFrame, run: DataFrame, group: str, required: list[str]) -> DataFrame:
    """The run has a metrics row with its key columns filled and the run's own numbers."""
    j = run.join(metrics.withColumn("_there", F.lit(True)), group, "left")
    empty = F.array_join(F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", c) for c in required])), ", ")
    return _row(j, "метрики", [group], [
        (F.col("_there").isNull(), F.lit("метрики: немає рядка за сьогодні")), (empty != "", F.concat(F.lit("метрики: порожні ключові колонки: "), empty)),
        ((F.col("found") != F.col("run_found")) | (F.col("shown") != F.col("run_shown")), F.lit("метрики: «знайдено»/«показано» не збігаються з результатом запуску"))])


def check_finished(runs: DataFrame) -> DataFrame:
    return _row(runs, "результат перевірки", ["run_id"], [(F.col("mark") == "ЗАПУСК ПОЧАТО", F.lit("рядок досі «ЗАПУСК ПОЧАТО»"))])


def check_sources(registry: DataFrame, statuses: DataFrame) -> DataFrame:
    """Required sources that are missing or unavailable."""
    up = statuses.where(F.col("status") != "недоступне").select("source").distinct()
    return registry.join(up, "source", "left_anti")


def verify_writes(checks: dict[str, tuple[Callable[[], DataFrame], Callable[[], None] | None]]) -> list[dict]:
    """Check → one repair → check again. Only the check rows (one per check) reach the driver."""
    out = []
    for name, (check, repair) in checks.items():
        bad = check().where(~F.col("ok")).limit(1).collect()
        repaired = False
        if bad and repair is not None:
            repair()
            again = check().where(~F.col("ok")).limit(1).collect()
            repaired, bad = not again, again
        out.append({"name": name, "ok": not bad, "repaired": repaired, "reason": bad[0]["reason"] if bad else ""})
    return out


def column_difference(df: DataFrame, expected: list[str]) -> tuple[list[str], list[str]]:
    """(unknown, missing) columns."""
    return [c for c in df.columns if c not in expected], [c for c in expected if c not in df.columns]


def label_errors(rows: DataFrame, row_no: str, rules: dict[str, Column]) -> DataFrame:
    """(row, field, value) of every cell that breaks its rule; blanks are allowed. Row 1 is the header."""
    cells = [F.when((F.trim(F.coalesce(F.col(f), F.lit(""))) != "") & ~F.coalesce(ok, F.lit(False)), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f, ok in rules.items()]
    return rows.select((F.col(row_no) + 2).alias("row"), F.explode(F.array_compact(F.array(*cells))).alias("e")).select("row", "e.*")


def step_gate(outputs: DataFrame, started: Column) -> DataFrame:
    """A step is ok only if its output is fresh and not empty: (step, rows, written_at) → status."""
    fresh = F.coalesce(F.col("written_at") >= started, F.lit(False)) & (F.col("rows") > 0)
    return outputs.select("step", "rows", F.when(fresh, "ok").otherwise("failed").alias("status"))
