"""Run monitoring: daily metrics, baselines, streaks, statuses, costs and alerts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.functions.numbers import half_even


def decision_summary(decisions: DataFrame, *group: str) -> DataFrame:
    r = F.col("result")
    return decisions.groupBy(*group).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(r == "показано").alias("shown"), F.count_if(r == "відсіяно").alias("rejected"),
        F.count_if(r == "майже").alias("near"), F.count_if(r.startswith("не оцінено")).alias("not_evaluated"))


BASELINE_RUNS, BASELINE_MIN, ZERO_BASELINE = 7, 3, 10
STREAK_REVIEW, TREND_RUNS, TREND_LOOKBACK = 7, 3, 5
STARTED_MARK = "ЗАПУСК ПОЧАТО"
DOWN = "недоступне"
OK, PARTIAL, NOT_DONE = "OK", "ЧАСТКОВО", "НЕ ВИКОНАНО"
MAX_REASON = 220


def source_baselines(runs: DataFrame, zero_at: int = ZERO_BASELINE) -> DataFrame:
    """Each (source, run_ts, cards, status) with the median of the last seven OK runs before it and the zero alarm.

    The ledger has one row per source and run, so its windows stay as small as the history of a source."""
    ok = F.col("status") == OK
    recent = Window.partitionBy("source", "_ok").orderBy("run_ts").rowsBetween(-BASELINE_RUNS + 1, 0)
    upto = F.when(ok, F.struct(F.expr("percentile(cards, 0.5)").over(recent).alias("m"), F.count(F.lit(1)).over(recent).alias("n")))
    d = runs.withColumn("_ok", ok).withColumn("_upto", upto)
    before = Window.partitionBy("source").orderBy("run_ts").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_last", F.last("_upto", ignorenulls=True).over(before))
    base = F.when(F.col("_last.n") >= BASELINE_MIN, F.col("_last.m"))
    alarm = (F.col("cards") == 0) & F.coalesce(base >= zero_at, F.lit(False))
    return d.withColumn("baseline", base).withColumn("alarm", alarm).drop("_ok", "_upto", "_last")


def zero_streaks(runs: DataFrame, shown: str = "cards") -> DataFrame:
    """Runs in a row without a result, per source; `review` exactly when the streak reaches seven."""
    w = Window.partitionBy("source").orderBy("run_ts")
    island = F.sum((F.col(shown) > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = runs.withColumn("_island", island)
    inside = Window.partitionBy("source", "_island").orderBy("run_ts").rowsBetween(Window.unboundedPreceding, 0)
    streak = F.sum((F.col(shown) == 0).cast("long")).over(inside)
    return d.withColumn("streak", streak).withColumn("review", F.col("streak") == STREAK_REVIEW).drop("_island")


def trailing_signal(runs: DataFrame, group: list[str]) -> DataFrame:
    """Three "так" in a row up to this run, unfinished runs skipped, at most five earlier rows looked at."""
    frame = Window.partitionBy(*group).orderBy("run_ts").rowsBetween(-TREND_LOOKBACK, -1)
    earlier = F.reverse(F.collect_list(F.struct("mark", F.coalesce("signal", F.lit("")).alias("signal"))).over(frame))
    seen = F.filter(earlier, lambda r: r["mark"] != STARTED_MARK)
    stops = F.filter(F.transform(seen, lambda r, i: F.when(r["signal"] != "так", i)), lambda i: i.isNotNull())
    streak = 1 + F.coalesce(F.array_min(stops), F.size(seen))
    return runs.withColumn("alarm", (F.coalesce("signal", F.lit("")) == "так") & (streak >= TREND_RUNS))


def last_of_day(ledger: DataFrame, day: str, ts: str, *group: str) -> DataFrame:
    rest = [c for c in ledger.columns if c not in (day, *group)]
    return ledger.groupBy(*group, day).agg(F.max_by(F.struct(*rest), ts).alias("r")).select(*group, day, "r.*")


def previous_value(runs: DataFrame, column: str, group: list[str], ts: str = "run_ts") -> DataFrame:
    """The value of the run before; `changed` warns when it differs."""
    prev = F.lag(column).over(Window.partitionBy(*group).orderBy(ts))
    return runs.withColumn("previous", prev).withColumn("changed", F.coalesce(F.col("previous") != F.col(column), F.lit(False)))


def coverage_status(queries: DataFrame) -> DataFrame:
    """(source, query, pages, complete, oldest_days) → status and collection method of each source."""
    d = queries.groupBy("source").agg(F.min("complete").alias("_all"), F.max(F.when(~F.col("complete"), F.col("pages"))).alias("_pages"),
                                      F.max(F.when(~F.col("complete"), F.col("oldest_days"))).alias("_old"))
    old = F.coalesce(F.concat(F.col("_old").cast("string"), F.lit(" днів")), F.lit("невідомо"))
    text = F.concat(F.lit("неповне покриття ("), F.col("_pages").cast("string"), F.lit(" сторінок, найстаріша переглянута — "), old, F.lit(")"))
    return d.select("source", F.when(F.col("_all"), OK).otherwise(text).alias("status"), F.when(F.col("_all"), "усі_сторінки").otherwise("оцінка").alias("method"))


def collection_method(sources: DataFrame, *group: str) -> DataFrame:
    """The method all available sources share, "оцінка" when they differ."""
    up = F.when(F.col("status") != DOWN, F.col("method"))
    return sources.groupBy(*group).agg(F.when(F.max(up).isNull(), "не_встановлено").when(F.max(up) == F.min(up), F.max(up)).otherwise("оцінка").alias("method"))


def source_summary(sources: DataFrame, *group: str) -> DataFrame:
    s = F.col("status")
    return sources.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), F.count_if(s == OK).alias("ok"), F.count_if(s != DOWN).alias("collected"),
                                       F.count_if(s.startswith("неповне покриття")).alias("partial"))


def step_status(ok: Column, total: Column, collected: Column, level: Column, unevaluated: Column) -> Column:
    """Status of the main step from its sources, deduplication level and cards without an evaluation."""
    full = (ok == total) & level.isin(1, 2) & (unevaluated == 0)
    return F.when(collected == 0, NOT_DONE).when(full & (level == 1), OK).otherwise(PARTIAL)


def gig_step_status(ok: Column, total: Column, saved: Column) -> Column:
    return F.when((ok == total) & saved, OK).when((ok == 0) & ~saved, NOT_DONE).otherwise(PARTIAL)


def run_status(*steps: Column) -> Column:
    return F.when(F.least(*steps) == F.greatest(*steps), F.when(steps[0].isin(OK, NOT_DONE), steps[0]).otherwise(PARTIAL)).otherwise(PARTIAL)


def conversion(found: Column, shown: Column) -> Column:
    return F.when(found > 0, F.bround(100.0 * shown / found, 0).cast("long").cast("string")).otherwise("н/д")


def low_or_zero(full_coverage: Column, shown: Column, low: Column) -> Column:
    return F.when(~full_coverage, "н/д").when((shown == 0) | (shown == low), "так").otherwise("ні")


def daily_metrics(decisions: DataFrame, sources: DataFrame, costs: DataFrame, registry: list[str]) -> DataFrame:
    """One row per run: counts over its decisions, the status of every source as a column, cost per shown posting."""
    shown = F.col("result") == "показано"
    counts = decisions.groupBy("run_date").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(shown).alias("shown"), F.count_if(shown & F.col("veteran")).alias("veterans"),
        F.count_if(shown & F.col("undated")).alias("undated"))
    states = sources.groupBy("run_date").pivot("source", registry).agg(F.first("status"))
    states = states.select("run_date", *[F.col(f"`{s}`").alias("status_" + s.replace("-", "_")) for s in registry])
    d = counts.join(states, "run_date", "left").join(costs, "run_date", "left")
    names = [c for c in d.columns if c.startswith("status_")]
    usd = F.coalesce("total_usd", F.lit(0.0))
    return d.select("run_date", "found", "shown", "veterans", "undated", *[F.coalesce(c, F.lit(OK)).alias(c) for c in names],
                    half_even(usd, 4).alias("cost_usd"), F.when(F.col("shown") > 0, half_even(usd / F.col("shown"), 4)).alias("cost_per_shown"))


def gig_metrics(gigs: DataFrame) -> DataFrame:
    """`outcome` of each gig: known / hard / irrelevant / old / shown → counts per run."""
    o = F.col("outcome")
    return gigs.groupBy("run_date").agg(
        F.count(F.lit(1)).alias("reviewed"), *[F.count_if(F.col("category") == c).alias("reviewed_" + c.lower()) for c in ("BI", "SQL", "Telegram")],
        *[F.count_if((o == "shown") & (F.col("category") == c)).alias("shown_" + c.lower()) for c in ("BI", "SQL", "Telegram")],
        F.count_if(o == "shown").alias("shown_total"), F.count_if(o.isin("hard", "irrelevant")).alias("rejected_irrelevant"))


def run_ledger(posts: DataFrame, group: str) -> DataFrame:
    """Collection totals per run; more than 2 % unclassified posts make it partial."""
    n = F.col("posts")
    d = posts.groupBy(group).agg(F.count(F.lit(1)).alias("posts"), F.count_if("classified").alias("classified_posts"), F.count_if(F.col("classified") & F.col("is_vacancy")).alias("vacancy_posts"),
                                 # whole micro-dollars: a sum of doubles would depend on the order of the rows
                                 (F.sum(F.round(F.col("cost") * 1_000_000).cast("long")) / F.lit(1_000_000.0)).alias("_cost"), F.array_join(F.array_sort(F.collect_set("channel")), "; ").alias("channels"))
    lost = n - F.col("classified_posts")
    return d.select(group, "posts", "classified_posts", lost.alias("unclassified_posts"), "vacancy_posts", "channels", half_even(F.col("_cost"), 4).alias("cost_usd"),
                    half_even(F.col("_cost") / n, 6).alias("cost_per_post_usd"), half_even(1000 * F.col("_cost") / n, 3).alias("cost_per_1000_posts_usd"),
                    F.when(lost / n > 0.02, "partial").otherwise("ok").alias("status"))


def reasons_by_day(log: DataFrame, codes: list[str]) -> DataFrame:
    return log.groupBy("system", "day").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("code") == c).alias(f"n_{i}") for i, c in enumerate(codes)],
                                            F.count_if(~F.coalesce(F.col("code").isin(*codes), F.lit(False))).alias("other_or_shown"))


def days_seen(log: DataFrame, key: str = "url") -> DataFrame:
    """How many postings were seen on 1, 2, 3… days."""
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("day").alias("n_days_seen")).groupBy("n_days_seen").agg(F.count(F.lit(1)).alias("count"))


def new_per_day(log: DataFrame, key: str = "url") -> DataFrame:
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("day").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("new"))


def repeated_reasons(log: DataFrame, technical: list[str], key: str = "url") -> DataFrame:
    """Share of postings given more than one substantive reason."""
    real = F.when(~F.col("code").isin(*technical), F.col("code"))
    d = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(real).alias("n")).agg(F.count(F.lit(1)).alias("postings"), F.count_if(F.col("n") > 1).alias("several"))
    return d.select("postings", "several", half_even(100.0 * F.col("several") / F.col("postings"), 1).alias("share_pct"))


def date_sources(log: DataFrame) -> DataFrame:
    return log.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("date_source") == v).alias(n) for v, n in (("картка", "card"), ("сторінка", "page"), ("невідома", "unknown"))])


def alert_text(reason: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(reason, r"(?U)\s+", " ")), 1, MAX_REASON)


def alerts(reasons: DataFrame) -> DataFrame:
    """(kind, reason) → distinct alert lines; what was not written comes first."""
    t = F.upper(alert_text(F.col("reason")))
    line = F.when(F.col("kind") == "not_written", F.concat(F.lit("🚨🚨🚨 !!! НЕ ЗАПИСАНО: "), t, F.lit(" !!!"))).otherwise(F.concat(F.lit("🚨🚨🚨 **!!! "), t, F.lit(" !!!**")))
    return (reasons.where(F.trim("reason") != "").select(F.when(F.col("kind") == "not_written", 0).otherwise(1).alias("priority"), line.alias("line"))
            .groupBy("line").agg(F.min("priority").alias("priority")))


def source_alerts(sources: DataFrame, label: str = "джерело") -> DataFrame:
    down = F.when(F.col("status") == DOWN, F.concat(F.lit(f"{label} "), F.col("source"), F.lit(" недоступне: "), F.coalesce(F.nullif("note", F.lit("")), F.lit("без деталей"))))
    odd = F.when(F.coalesce("anomaly", F.lit("")) != "", F.concat(F.lit(f"{label} "), F.col("source"), F.lit(": "), F.col("anomaly")))
    return sources.select(F.explode(F.array_compact(F.array(down, odd))).alias("reason")).select(F.lit("event").alias("kind"), "reason")


def status_cell(status: Column, note: Column) -> Column:
    return F.concat(status, F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(" — "), note)).otherwise(""))


def mail_counters(mails: DataFrame) -> DataFrame:
    return mails.agg(F.count(F.lit(1)).alias("total"), F.count_if("from_hr").alias("hr"), F.count_if("from_known").alias("known_company"),
                     F.count_if("loaded").alias("threads_loaded"), F.count_if(~F.col("loaded")).alias("threads_skipped"))


def unfinished_runs(events: DataFrame) -> DataFrame:
    """Runs with a start marker and no finish."""
    return events.where("event = 'started'").join(events.where("event = 'finished'").select("run_id"), "run_id", "left_anti")
