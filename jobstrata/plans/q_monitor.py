"""Queries: run monitoring, costs, quality checks and classifier evaluation."""
from __future__ import annotations

from pyspark.sql import functions as F

from jobstrata.functions import dates, numbers, text
from jobstrata.operators import costs, evaluate, funnel, monitor, quality, scale
from jobstrata.plans.bindings import ctes, table, view
from jobstrata.plans.q_funnel import LOGGED, logged
from jobstrata.plans.registry import query

# one row per source and hour of the event stream
RUNS_SQL = """SELECT event_type AS source, date_trunc('hour', ts) AS run_ts, count(CASE WHEN value > 12 THEN 1 END) AS cards,
  CASE WHEN max(value) > 60 THEN 'недоступне' WHEN min(value) < 0.5 THEN 'неповне покриття (5 сторінок)' ELSE 'OK' END AS status,
  CASE WHEN max(user_id) % 2 = 0 THEN 'усі_сторінки' ELSE 'оцінка' END AS method,
  CASE WHEN count(*) % 4 = 0 THEN 'ЗАПУСК ПОЧАТО' ELSE 'готово' END AS mark, CASE WHEN min(value) < 8 THEN 'так' ELSE 'ні' END AS signal
FROM {events} GROUP BY event_type, date_trunc('hour', ts)"""
RUNS = ("runs", RUNS_SQL.replace("{events}", "events"))


def runs(spark, sf):
    return spark.sql(RUNS_SQL, events=table(spark, sf, "events")).withColumn("run_ts", F.col("run_ts").cast("timestamp"))


def _ts(df):
    return df.withColumn("run_ts", dates.micros(F.col("run_ts")))


_BASE = """SELECT r.source, epoch_us(r.run_ts) AS run_ts, r.cards, CASE WHEN n >= 3 THEN m END AS baseline, r.cards = 0 AND coalesce(n >= 3 AND m >= 2, false) AS alarm FROM runs r ASOF LEFT JOIN (
  SELECT source, run_ts, median(cards) OVER w AS m, count(*) OVER w AS n FROM runs WHERE status = 'OK' WINDOW w AS (PARTITION BY source ORDER BY run_ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) o ON r.source = o.source AND r.run_ts > o.run_ts"""


@query("w3_source_baselines", ctes(RUNS) + _BASE)
def _(spark, sf):
    return _ts(monitor.source_baselines(runs(spark, sf), zero_at=2)).select("source", "run_ts", "cards", "baseline", "alarm")


@query("w4_zero_streaks", ctes(RUNS) + """SELECT source, epoch_us(run_ts) AS run_ts, streak, streak = 7 AS review FROM (
  SELECT *, CAST(sum(CASE WHEN cards = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source, g ORDER BY run_ts) AS BIGINT) AS streak FROM (SELECT *, sum(CASE WHEN cards > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY run_ts) AS g FROM runs))""")
def _(spark, sf):
    return _ts(monitor.zero_streaks(runs(spark, sf))).select("source", "run_ts", "streak", "review")


@query("w5_trailing_signal", ctes(RUNS) + """SELECT source, epoch_us(run_ts) AS run_ts, signal = 'так' AND 1 + coalesce(list_position(list_transform(seen, lambda x: x.signal), 'ні') - 1, len(seen)) >= 3 AS alarm FROM (
  SELECT *, list_filter(list_reverse(coalesce(list({'mark': mark, 'signal': signal}) OVER (PARTITION BY source ORDER BY run_ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), [])), lambda x: x.mark <> 'ЗАПУСК ПОЧАТО') AS seen FROM runs)""")
def _(spark, sf):
    return _ts(monitor.trailing_signal(runs(spark, sf), ["source"])).select("source", "run_ts", "alarm")


@query("w10_last_of_day", ctes(RUNS) + "SELECT source, strftime(run_ts, '%Y-%m-%d') AS day, arg_max(cards, run_ts) AS cards, arg_max(status, run_ts) AS status FROM runs GROUP BY ALL")
def _(spark, sf):
    r = runs(spark, sf).withColumn("day", dates.day_text(F.col("run_ts")))
    return monitor.last_of_day(r, "day", "run_ts", "source").select("source", "day", "cards", "status")


@query("w11_budget_cutoff", ctes("usage") + """SELECT call_id, spent < 0.5 AS made FROM (SELECT *, coalesce(sum(CASE WHEN stage = 'cards_shadow' THEN 0 ELSE CAST(round(usd, 9) AS DECIMAL(20, 9)) END) OVER (PARTITION BY run_date ORDER BY call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM (
  SELECT *, (input_tokens * pi + output_tokens * po + cache_write_tokens * pi * 1.25 + cache_read_tokens * pi * 0.1) / 1000000 AS usd FROM (SELECT *, CAST(CASE WHEN lower(model) LIKE '%haiku%' THEN 1 WHEN lower(model) LIKE '%sonnet%' THEN 3 ELSE 5 END AS DOUBLE) AS pi,
  CAST(CASE WHEN lower(model) LIKE '%haiku%' THEN 5 WHEN lower(model) LIKE '%sonnet%' THEN 15 ELSE 25 END AS DOUBLE) AS po FROM usage)))""")
def _(spark, sf):
    return costs.budget_cutoff(view(spark, sf, "usage"), "run_date", "call_id", 0.5).select("call_id", "made")


@query("w12_repeat_run_index", ctes(RUNS) + "SELECT source, epoch_us(run_ts) AS run_ts, row_number() OVER (PARTITION BY source, CAST(run_ts AS DATE) ORDER BY run_ts) - 1 AS run_index FROM runs")
def _(spark, sf):
    r = runs(spark, sf).withColumn("day", F.to_date("run_ts")).withColumn("us", dates.micros(F.col("run_ts")))
    d = scale.running_position(r, ["source", "day"], "us", 3600_000_000 * 6, "n")
    return _ts(d.withColumn("run_index", F.col("n") - 1)).select("source", "run_ts", "run_index")


@query("w13_changed_parameter", ctes(RUNS) + "SELECT source, epoch_us(run_ts) AS run_ts, previous, coalesce(previous <> method, false) AS changed FROM (SELECT *, lag(method) OVER (PARTITION BY source ORDER BY run_ts) AS previous FROM runs)")
def _(spark, sf):
    return _ts(monitor.previous_value(runs(spark, sf), "method", ["source"])).select("source", "run_ts", "previous", "changed")


@query("w14_batches", """SELECT doc_id, CASE WHEN is_long THEN 'long' ELSE CAST((row_number() OVER (PARTITION BY source, is_long ORDER BY doc_id) - 1) // 10 AS STRING) END AS batch FROM (SELECT *, length(text) > 1500 AS is_long FROM documents)""")
def _(spark, sf):
    """Ten short texts of a source per batch, every long text alone."""
    d = table(spark, sf, "documents").select("doc_id", "source", (F.length("text") > 1500).alias("is_long"))
    d = scale.running_position(d, ["source", "is_long"], "doc_id", 5000, "n")
    return d.select("doc_id", F.when(F.col("is_long"), "long").otherwise(F.floor((F.col("n") - 1) / 10).cast("string")).alias("batch"))


@query("a15_daily_metrics", ctes("cards", "evaluations", LOGGED) + f"""SELECT strftime(run_date, '%Y-%m-%d') AS run_date, count(*) AS found, count(*) FILTER (sh) AS shown, count(*) FILTER (sh AND veteran_bonus) AS veterans, count(*) FILTER (sh AND date_undetermined) AS undated,
  {', '.join(f"coalesce(max(CASE WHEN source = 'board-{x}' THEN st END), 'OK') AS status_board_{x}" for x in 'abcd')}, {'round_even(sum(price) / 1000000, 4)'} AS cost_usd,
  CASE WHEN count(*) FILTER (sh) > 0 THEN round_even(sum(price) / 1000000 / count(*) FILTER (sh), 4) END AS cost_per_shown
FROM (SELECT *, result = 'показано' AS sh, min(CASE WHEN price > 450000 THEN 'недоступне' ELSE 'OK' END) OVER (PARTITION BY run_date, source) AS st FROM logged JOIN evaluations USING (card_id)) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1"))
def _(spark, sf):
    d = logged(spark, sf).join(view(spark, sf, "evaluations").select("card_id", F.col("veteran_bonus").alias("veteran"), F.col("date_undetermined").alias("undated")), "card_id")
    src = d.groupBy("run_date", "source").agg(F.min(F.when(F.col("price") > 450000, monitor.DOWN).otherwise(monitor.OK)).alias("status"))
    cost = d.groupBy("run_date").agg((F.sum("price") / 1000000).alias("total_usd"))
    m = monitor.daily_metrics(d, src, cost, ["board-a", "board-b", "board-c", "board-d"])
    return m.withColumn("run_date", dates.day_text(F.col("run_date")))


_GIG = """CASE WHEN user_id % 10 = 0 THEN 'known' WHEN source = 'gig-board' AND (title LIKE 'Звіт з BAS%' OR title LIKE '%1С:%' OR (title LIKE 'ERP%' AND (budget IS NULL OR budget <= 10000)) OR (budget IS NULL AND bids_count > 40)) THEN 'hard'
  WHEN value < 3 THEN 'irrelevant' WHEN value > 40 THEN 'old' ELSE 'shown' END"""


@query("a16_gig_metrics", ctes("gigs") + f"""SELECT strftime(run_date, '%Y-%m-%d') AS run_date, count(*) AS reviewed, {', '.join(f"count(*) FILTER (category = '{c}') AS reviewed_{c.lower()}" for c in ('BI', 'SQL', 'Telegram'))},
  {', '.join(f"count(*) FILTER (o = 'shown' AND category = '{c}') AS shown_{c.lower()}" for c in ('BI', 'SQL', 'Telegram'))}, count(*) FILTER (o = 'shown') AS shown_total, count(*) FILTER (o IN ('hard', 'irrelevant')) AS rejected_irrelevant
FROM (SELECT *, {_GIG} AS o FROM (SELECT *, TRY_CAST(nullif(regexp_extract(budget_raw, '(\\d+)', 1), '') AS DOUBLE) * CASE WHEN budget_raw LIKE '%USD' THEN 41 ELSE 1 END AS budget FROM gigs)) GROUP BY ALL""")
def _(spark, sf):
    g = view(spark, sf, "gigs")
    hard = funnel.gig_hard_reject(F.col("source"), F.col("title"), F.lit(""), F.col("budget_raw"), F.col("bids_count")).isNotNull()
    o = F.when(F.col("user_id") % 10 == 0, "known").when(hard, "hard").when(F.col("value") < 3, "irrelevant").when(F.col("value") > 40, "old").otherwise("shown")
    return monitor.gig_metrics(g.withColumn("outcome", o)).withColumn("run_date", dates.day_text(F.col("run_date")))


_USD = """(input_tokens * pi + output_tokens * po + cache_write_tokens * pi * 1.25 + cache_read_tokens * pi * 0.1) / 1000000"""
_PRICED = ("priced", f"""SELECT *, {_USD} AS usd FROM (SELECT *, CAST(CASE WHEN lower(model) LIKE '%haiku%' THEN 1 WHEN lower(model) LIKE '%sonnet%' THEN 3 ELSE 5 END AS DOUBLE) AS pi,
  CAST(CASE WHEN lower(model) LIKE '%haiku%' THEN 5 WHEN lower(model) LIKE '%sonnet%' THEN 15 ELSE 25 END AS DOUBLE) AS po FROM usage)""")


@query("a18_j18_stage_costs", ctes("usage", _PRICED) + """SELECT stage, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, round_even(sum(usd), 4) AS usd, array_to_string(list_sort(list(DISTINCT model)), '+') AS models FROM priced GROUP BY ALL""")
def _(spark, sf):
    return costs.stage_costs(view(spark, sf, "usage")).withColumn("usd", numbers.half_even(F.col("usd"), 4))


@query("a18_cost_ledger", ctes("usage", _PRICED) + "SELECT strftime(run_date, '%Y-%m-%d') AS run_date, " + ", ".join(
    f"count(*) FILTER (stage = '{s}') AS {s}_calls, CAST(coalesce(sum(input_tokens) FILTER (stage = '{s}'), 0) AS BIGINT) AS {s}_in, round_even(coalesce(sum(usd) FILTER (stage = '{s}'), 0), 5) AS {s}_usd" for s in costs.STAGES) +
    ", round_even(sum(usd), 5) AS total_usd, round_even(sum(usd) FILTER (stage <> 'cards_shadow'), 5) AS budget_usd FROM priced GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1"))
def _(spark, sf):
    return costs.cost_row(view(spark, sf, "usage"), "run_date").withColumn("run_date", dates.day_text(F.col("run_date")))


@query("a19_run_ledger", ctes("posts") + """SELECT month, posts, cl AS classified_posts, posts - cl AS unclassified_posts, vp AS vacancy_posts, channels, round_even(cost, 4) AS cost_usd, round_even(cost / posts, 6) AS cost_per_post_usd, round_even(1000 * cost / posts, 3) AS cost_per_1000_posts_usd,
  CASE WHEN CAST(posts - cl AS DOUBLE) / posts > 0.02 THEN 'partial' ELSE 'ok' END AS status FROM (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS posts, count(*) FILTER (c) AS cl, count(*) FILTER (c AND is_vacancy) AS vp, CAST(sum(coalesce(views, 0)) AS DOUBLE) / 1000000 AS cost,
  array_to_string(list_sort(list(DISTINCT channel)), '; ') AS channels FROM (SELECT *, classified <> 'False' AS c FROM posts) GROUP BY ALL)""")
def _(spark, sf):
    p = view(spark, sf, "posts").withColumn("month", dates.year_month(F.col("ts"))).withColumn("classified", F.col("classified") != "False")
    return monitor.run_ledger(p.withColumn("cost", F.coalesce("views", F.lit(0)) / F.lit(1000000.0)), "month")


_CODES = ["роль", "ЗП", "подано", "дубль"]


@query("a24_reasons_by_day", ctes("cards", LOGGED) + "SELECT source AS system, strftime(run_date, '%Y-%m-%d') AS day, count(*) AS rows, " + ", ".join(f"count(*) FILTER (code = '{c}') AS n_{i}" for i, c in enumerate(_CODES)) + ", count(*) FILTER (code NOT IN ('роль', 'ЗП', 'подано', 'дубль')) AS other_or_shown FROM logged GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def _(spark, sf):
    d = logged(spark, sf).select(F.col("source").alias("system"), dates.day_text(F.col("run_date")).alias("day"), "code")
    return monitor.reasons_by_day(d, _CODES)


def _seen(spark, sf):
    g = view(spark, sf, "gigs")
    return g.select("url", dates.day_text(F.col("run_date")).alias("day"), F.col("category").alias("code"), F.when(F.col("value") > 20, "картка").when(F.col("value") > 5, "сторінка").otherwise("невідома").alias("date_source"), "source")


@query("a24_days_seen", ctes("gigs") + "SELECT n_days_seen, count(*) AS count FROM (SELECT url, count(DISTINCT run_date) AS n_days_seen FROM gigs GROUP BY url) GROUP BY ALL")
def _(spark, sf):
    return monitor.days_seen(_seen(spark, sf))


@query("a24_new_per_day", ctes("gigs") + "SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS new FROM (SELECT url, min(run_date) AS d FROM gigs GROUP BY url) GROUP BY ALL")
def _(spark, sf):
    return monitor.new_per_day(_seen(spark, sf))


@query("a24_repeated_reasons", ctes("gigs") + "SELECT count(*) AS postings, count(*) FILTER (n > 1) AS several, round_even(100.0::DOUBLE * count(*) FILTER (n > 1) / count(*), 1) AS share_pct FROM (SELECT url, count(DISTINCT category) FILTER (category <> 'Telegram') AS n FROM gigs GROUP BY url)")
def _(spark, sf):
    return monitor.repeated_reasons(_seen(spark, sf), ["Telegram"])


@query("a24_date_sources", ctes("gigs") + "SELECT source, count(*) AS rows, count(*) FILTER (value > 20) AS card, count(*) FILTER (value > 5 AND value <= 20) AS page, count(*) FILTER (value <= 5) AS unknown FROM gigs GROUP BY source")
def _(spark, sf):
    return monitor.date_sources(_seen(spark, sf))


@query("a25_coverage_status", """SELECT source, CASE WHEN bool_and(c) THEN 'OK' ELSE 'неповне покриття (' || max(p) FILTER (NOT c) || ' сторінок, найстаріша переглянута — ' || coalesce(CAST(max(o) FILTER (NOT c) AS STRING) || ' днів', 'невідомо') || ')' END AS status, CASE WHEN bool_and(c) THEN 'усі_сторінки' ELSE 'оцінка' END AS method
FROM (SELECT source, lang, count(*) AS p, max(n_chars) < 4000 AS c, CASE WHEN min(n_chars) > 20 THEN min(n_chars) % 30 END AS o FROM documents GROUP BY ALL) GROUP BY source""".replace("FROM documents GROUP BY ALL", "FROM documents GROUP BY source, lang"))
def _(spark, sf):
    q = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("pages"), (F.max("n_chars") < 4000).alias("complete"), F.when(F.min("n_chars") > 20, F.min("n_chars") % 30).alias("oldest_days"))
    return monitor.coverage_status(q.withColumnRenamed("lang", "query"))


@query("a26_a27_a28_run_statuses", ctes(RUNS, ("d", """SELECT CAST(run_ts AS DATE) AS day, count(*) AS total, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status <> 'недоступне') AS col, CAST(sum(cards) AS BIGINT) AS found, count(*) FILTER (signal = 'так') AS shown,
  count(DISTINCT method) FILTER (status <> 'недоступне') AS nm, min(method) FILTER (status <> 'недоступне') AS m FROM runs GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1"))) +
  """SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN col = 0 THEN 'НЕ ВИКОНАНО' WHEN ok = total THEN 'OK' ELSE 'ЧАСТКОВО' END AS step1, CASE WHEN ok = total AND found > 20 THEN 'OK' WHEN ok = 0 AND found <= 20 THEN 'НЕ ВИКОНАНО' ELSE 'ЧАСТКОВО' END AS gigs,
  CASE WHEN nm = 0 THEN 'не_встановлено' WHEN nm = 1 THEN m ELSE 'оцінка' END AS method, CASE WHEN found > 0 THEN CAST(CAST(round_even(CAST(100.0 * shown AS DOUBLE) / found, 0) AS BIGINT) AS STRING) ELSE 'н/д' END AS conversion, ok = total AS comparable,
  CASE WHEN ok <> total THEN 'н/д' WHEN shown = 0 THEN 'так' ELSE 'ні' END AS low_or_zero,
  CASE WHEN (CASE WHEN col = 0 THEN 'НЕ ВИКОНАНО' WHEN ok = total THEN 'OK' ELSE 'ЧАСТКОВО' END) = (CASE WHEN ok = total AND found > 20 THEN 'OK' WHEN ok = 0 AND found <= 20 THEN 'НЕ ВИКОНАНО' ELSE 'ЧАСТКОВО' END) THEN (CASE WHEN col = 0 THEN 'НЕ ВИКОНАНО' WHEN ok = total THEN 'OK' ELSE 'ЧАСТКОВО' END) ELSE 'ЧАСТКОВО' END AS run FROM d""")
def _(spark, sf):
    r = runs(spark, sf).withColumn("day", dates.day_text(F.col("run_ts")))
    d = monitor.source_summary(r, "day").join(monitor.collection_method(r, "day"), "day")
    d = d.join(r.groupBy("day").agg(F.sum("cards").alias("found"), F.count_if(F.col("signal") == "так").alias("shown")), "day")
    full = F.col("ok") == F.col("total")
    step1 = monitor.step_status(F.col("ok"), F.col("total"), F.col("collected"), F.lit(1), F.lit(0))
    gigs = monitor.gig_step_status(F.col("ok"), F.col("total"), F.col("found") > 20)
    return d.select("day", step1.alias("step1"), gigs.alias("gigs"), "method", monitor.conversion(F.col("found"), F.col("shown")).alias("conversion"), full.alias("comparable"),
                    monitor.low_or_zero(full, F.col("shown"), F.lit(-1)).alias("low_or_zero"), monitor.run_status(step1, gigs).alias("run"))


@query("a31_x31_u4_alerts", ctes(RUNS) + """SELECT DISTINCT CASE WHEN status = 'недоступне' THEN '🚨🚨🚨 **!!! ' || upper('джерело ' || source || ' недоступне: без деталей') || ' !!!**' ELSE '🚨🚨🚨 !!! НЕ ЗАПИСАНО: ' || upper('метрики ' || source) || ' !!!' END AS line,
  CASE WHEN status = 'недоступне' THEN 1 ELSE 0 END AS priority FROM runs WHERE status = 'недоступне' OR mark = 'ЗАПУСК ПОЧАТО'
UNION SELECT '🚨🚨🚨 !!! НЕ ЗАПИСАНО: ' || upper('метрики ' || source) || ' !!!', 0 FROM runs WHERE mark = 'ЗАПУСК ПОЧАТО'""")
def _(spark, sf):
    r = runs(spark, sf).withColumn("note", F.lit("")).withColumn("anomaly", F.lit(""))
    unwritten = r.where(F.col("mark") == monitor.STARTED_MARK).select(F.lit("not_written").alias("kind"), F.concat(F.lit("  метрики\n "), "source").alias("reason"))
    return monitor.alerts(monitor.source_alerts(r).unionByName(unwritten))


@query("x31_status_cells", ctes(RUNS) + "SELECT source, epoch_us(run_ts) AS run_ts, status || CASE WHEN mark = 'готово' THEN '' ELSE ' — ' || mark END AS cell FROM runs")
def _(spark, sf):
    return _ts(runs(spark, sf)).select("source", "run_ts", monitor.status_cell(F.col("status"), F.when(F.col("mark") != "готово", F.col("mark"))).alias("cell"))


@query("k5_t9_unfinished_runs", ctes(RUNS) + "SELECT source || '-' || strftime(run_ts, '%Y%m%dT%H%M%SZ') AS run_id FROM runs WHERE mark = 'ЗАПУСК ПОЧАТО'")
def _(spark, sf):
    r = runs(spark, sf).select(F.concat("source", F.lit("-"), dates.run_id(F.col("run_ts"))).alias("run_id"), "mark")
    events = r.select("run_id", F.explode(F.when(F.col("mark") == monitor.STARTED_MARK, F.array(F.lit("started"))).otherwise(F.array(F.lit("started"), F.lit("finished")))).alias("event"))
    return monitor.unfinished_runs(events).select("run_id")


# ---- quality checks ---------------------------------------------------------------------------------------
@query("q1_decision_log_check", ctes("cards", LOGGED, ("lg", "SELECT run_date, card_id AS pos, CASE WHEN price < 30000 THEN 'ПІДСУМОК' ELSE result END AS result FROM logged")) + """SELECT strftime(run_date, '%Y-%m-%d') AS run_date, 'лог відсіву' AS name, reason = '' AS ok, reason FROM (
  SELECT run_date, CASE WHEN NOT last THEN 'лог відсіву: останній рядок не «ПІДСУМОК»' WHEN rows < ceil(CAST(found AS DOUBLE) * 0.9) THEN 'лог відсіву: рядків ' || rows || ' з ' || found || ' знайдених (< 90%)' ELSE '' END AS reason FROM (
    SELECT run_date, count(*) AS found, count(*) FILTER (result <> 'ПІДСУМОК') AS rows, arg_max(result, pos) = 'ПІДСУМОК' AS last FROM lg GROUP BY ALL))""".replace("FROM lg GROUP BY ALL", "FROM lg GROUP BY run_date"))
def _(spark, sf):
    lg = logged(spark, sf).select("run_date", F.col("card_id").alias("pos"), F.when(F.col("price") < 30000, "ПІДСУМОК").otherwise(F.col("result")).alias("result"))
    d = quality.check_decision_log(lg, lg.groupBy("run_date").agg(F.count(F.lit(1)).alias("found")), "run_date", "pos")
    return d.withColumn("run_date", dates.day_text(F.col("run_date")))


@query("q1_log_written_today", ctes("cards", ("lg", "SELECT run_date, card_id AS pos, CASE WHEN price < 150000 THEN 'ПІДСУМОК' ELSE 'показано' END AS result, CAST(run_date AS TIMESTAMP) + INTERVAL 1 HOUR * (card_id % 26) AS m FROM cards WHERE mark <> 'P' AND card_id % 3 = 0")) + """SELECT strftime(run_date, '%Y-%m-%d') AS run_date, 'лог відсіву' AS name, reason = '' AS ok, reason FROM (
  SELECT run_date, CASE WHEN m IS NULL THEN 'лог відсіву за сьогодні (запис не виконувався)' WHEN CAST(m AS DATE) <> run_date THEN 'лог відсіву: modifiedTime ' || strftime(m, '%Y-%m-%dT%H:%M:%S') || ' не сьогодні' WHEN NOT last THEN 'лог відсіву: останній рядок не «ПІДСУМОК»'
    WHEN rows < ceil(CAST(found AS DOUBLE) * 0.9) THEN 'лог відсіву: рядків ' || rows || ' з ' || found || ' знайдених (< 90%)' ELSE '' END AS reason FROM (SELECT run_date, count(*) // 10 AS found FROM cards GROUP BY run_date)
  LEFT JOIN (SELECT run_date, count(*) FILTER (result <> 'ПІДСУМОК') AS rows, arg_max(result, pos) = 'ПІДСУМОК' AS last, max(m) AS m FROM lg GROUP BY run_date) USING (run_date))""")
def _(spark, sf):
    """Some runs have no log, some one that was written after midnight."""
    c = view(spark, sf, "cards")
    lg = c.where("mark <> 'P' AND card_id % 3 = 0").select("run_date", F.col("card_id").alias("pos"), F.when(F.col("price") < 150000, "ПІДСУМОК").otherwise("показано").alias("result"),
                                                           (F.col("run_date").cast("timestamp") + F.make_dt_interval(hours=(F.col("card_id") % 26).cast("int"))).alias("written"))
    found = c.groupBy("run_date").agg(F.floor(F.count(F.lit(1)) / 10).alias("found"))
    return quality.check_decision_log(lg, found, "run_date", "pos", F.col("written")).withColumn("run_date", dates.day_text(F.col("run_date")))


@query("q2_j22_shown_log_check", ctes("cards", ("own", "SELECT run_date, card_id || ' | ' || title AS line FROM cards WHERE mark <> 'F'"), ("lg", "SELECT run_date, card_id || ' | ' || title AS line FROM cards WHERE mark = 'O' OR (mark = 'P' AND price > 100000)")) + """SELECT strftime(run_date, '%Y-%m-%d') AS run_date, 'лог показаних' AS name, reason = '' AS ok, reason FROM (SELECT run_date,
  CASE WHEN n < shown OR (n <> shown AND NOT rep) THEN 'лог показаних: за сьогодні ' || n || ' рядків, показано ' || shown WHEN missing > 0 THEN 'лог показаних: не записано ' || missing || ' з ' || shown || ' рядків цього запуску' ELSE '' END AS reason FROM (
  SELECT run_date, count(*) AS shown, count(*) FILTER (lg.line IS NULL) AS missing, any_value(coalesce(c.n, 0)) AS n, bool_or(day(run_date) % 2 = 0) AS rep FROM own LEFT JOIN lg USING (run_date, line) LEFT JOIN (SELECT run_date, count(*) AS n FROM lg GROUP BY 1) c USING (run_date) GROUP BY run_date))""")
def _(spark, sf):
    c = view(spark, sf, "cards").withColumn("line", F.concat(F.col("card_id").cast("string"), F.lit(" | "), "title"))
    own = c.where("mark <> 'F'").select("run_date", "line")
    lg = c.where("mark = 'O' OR (mark = 'P' AND price > 100000)").select("run_date", "line")
    rep = own.select("run_date").distinct().withColumn("repeat", F.dayofmonth("run_date") % 2 == 0)
    return quality.check_shown_log(lg, own, rep, "run_date").withColumn("run_date", dates.day_text(F.col("run_date")))


@query("q3_metrics_check", ctes(RUNS) + """SELECT source, 'метрики' AS name, reason = '' AS ok, reason FROM (SELECT source, CASE WHEN cards > 4 THEN 'метрики: немає рядка за сьогодні' WHEN cards = 3 THEN 'метрики: порожні ключові колонки: model' WHEN cards = 2 THEN 'метрики: «знайдено»/«показано» не збігаються з результатом запуску' ELSE '' END AS reason FROM runs)""")
def _(spark, sf):
    r = runs(spark, sf).withColumn("key", F.struct("source", "run_ts"))
    metrics = r.where("cards <= 4").select("key", F.col("cards").alias("found"), F.col("cards").alias("shown"), F.when(F.col("cards") == 3, " ").otherwise("m").alias("model"))
    run = r.select("key", F.when(F.col("cards") == 2, 99).otherwise(F.col("cards")).alias("run_found"), F.col("cards").alias("run_shown"))
    return quality.check_metrics(metrics, run, "key", ["found", "model"]).select("key.source", "name", "ok", "reason")


@query("q4_finished_check", ctes(RUNS) + "SELECT ok, reason, count(*) AS n FROM (SELECT mark <> 'ЗАПУСК ПОЧАТО' AS ok, CASE WHEN mark = 'ЗАПУСК ПОЧАТО' THEN 'рядок досі «ЗАПУСК ПОЧАТО»' ELSE '' END AS reason FROM runs) GROUP BY ALL")
def _(spark, sf):
    return quality.check_finished(runs(spark, sf).withColumn("run_id", F.col("source"))).groupBy("ok", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("q5_missing_sources", "SELECT 'src' || CAST(n_nationkey AS STRING) AS source FROM nation WHERE 'src' || CAST(n_nationkey AS STRING) NOT IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 50)")
def _(spark, sf):
    registry = table(spark, sf, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    st = table(spark, sf, "documents").groupBy("source").agg(F.when(F.count(F.lit(1)) >= 50, "OK").otherwise("недоступне").alias("status"))
    return quality.check_sources(registry, st)


@query("q7_x24_label_errors", ctes("mentions") + """SELECT * FROM (SELECT post_id + 2 AS row, 'level' AS field, level AS value FROM mentions WHERE level NOT IN ('intern', 'junior', 'middle', 'senior')
  UNION ALL SELECT post_id + 2, 'salary_period', salary_period FROM mentions WHERE salary_period <> 'month')""")
def _(spark, sf):
    rules = {"level": F.col("level").isin("intern", "junior", "middle", "senior"), "salary_period": F.col("salary_period") == "month"}
    return quality.label_errors(view(spark, sf, "mentions"), "post_id", rules)


@query("q10_step_gate", """SELECT source AS step, count(*) AS rows, CASE WHEN max(doc_id) >= (SELECT max(doc_id) FROM documents) - 30 THEN 'ok' ELSE 'failed' END AS status FROM documents GROUP BY source""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    outputs = d.groupBy(F.col("source").alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("written_at"))
    return quality.step_gate(outputs, d.agg(F.max("doc_id") - 30).scalar())


# ---- classifier evaluation ----------------------------------------------------------------------------------
_PRED = ("p", "SELECT doc_id, quality = 1 AS truth, toxic, coalesce(n_chars > 600, false) AS pred, lang FROM labels LEFT JOIN documents USING (doc_id)")


def _wilson(k, n):
    p, d = f"(CAST({k} AS DOUBLE) / {n})", f"(1 + 3.8416 / {n})::DOUBLE"
    h = f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + 3.8416::DOUBLE / (4.0 * {n} * {n})) / {d})"
    c = f"(({p} + 3.8416::DOUBLE / (2 * {n})) / {d})"
    return f"round_even(100 * greatest(0.0::DOUBLE, {c} - {h}), 1) AS ci95_low_pct, round_even(100 * least(1.0::DOUBLE, {c} + {h}), 1) AS ci95_high_pct"


@query("a20_a21_j13_precision_recall", ctes(_PRED) + f"SELECT metric, k, n, round_even(100.0::DOUBLE * k / n, 1) AS value_pct, {_wilson('k', 'n')} FROM (SELECT 'post_is_vacancy_precision' AS metric, count(*) FILTER (truth AND pred) AS k, count(*) FILTER (pred) AS n FROM p UNION ALL SELECT 'post_is_vacancy_recall', count(*) FILTER (truth AND pred), count(*) FILTER (truth) FROM p)")
def _(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "left")
    c = evaluate.post_counts(d, F.col("quality") == 1, F.coalesce(F.col("n_chars") > 600, F.lit(False)))
    return evaluate.metric_rows(c, [("post_is_vacancy_precision", "tp", "predicted"), ("post_is_vacancy_recall", "tp", "actual")])


@query("a22_kappa", ctes(("p", "SELECT CAST(quality AS STRING) AS a, CASE WHEN n_chars > 600 THEN '1' ELSE '0' END AS b FROM labels JOIN documents USING (doc_id)"), ("m", "SELECT coalesce(x.a, y.b) AS v, coalesce(ca, 0) AS ca, coalesce(cb, 0) AS cb FROM (SELECT a, count(*) AS ca FROM p GROUP BY a) x FULL JOIN (SELECT b, count(*) AS cb FROM p GROUP BY b) y ON x.a = y.b")) +
       "SELECT n, round_even((po - pe) / (1 - pe), 4) AS kappa FROM (SELECT (SELECT count(*) FROM p) AS n, (SELECT CAST(count(*) FILTER (a = b) AS DOUBLE) / count(*) FROM p) AS po, CAST(sum(ca * cb) AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) * count(*) FROM p) AS pe FROM m)")
def _(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return evaluate.kappa(d.select(F.col("quality").cast("string").alias("a"), F.when(F.col("n_chars") > 600, "1").otherwise("0").alias("b")), "a", "b")


@query("o6_stratified_sample", """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS key, n_chars > 600 AS is_vacancy FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY is_vacancy ORDER BY md5('42-' || key), key) AS r FROM d)
SELECT key, is_vacancy FROM r WHERE CASE WHEN is_vacancy THEN r <= 70 ELSE r <= 100 - (SELECT least(70, count(*)) FROM d WHERE is_vacancy) END""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), (F.col("n_chars") > 600).alias("is_vacancy"))
    return evaluate.stratified_sample(d, 100, 42)


@query("j12_z2_title_matching")
def _(spark, sf):
    """Postings of one channel post: the titles of two mentions against those of the cards of its order."""
    m = view(spark, sf, "mentions")
    gold = m.groupBy("post_id", text.norm_title(F.col("title")).alias("title_norm")).agg(F.min("vacancy_idx").alias("no"))
    pred = view(spark, sf, "cards").select(F.col("card_id").alias("post_id"), text.norm_title(F.col("title")).alias("title_norm"), F.lit(0).alias("no"))
    key = lambda d: d.select(F.col("post_id").cast("string").alias("key"), F.col("no").cast("long").alias("no"), "title_norm")
    return evaluate.match_titles(key(gold), key(pred))


@query("x30_intervals", f"""SELECT source, CASE WHEN n > 0 THEN CAST(CAST(round_even(100.0::DOUBLE * k / n, 0) AS BIGINT) AS STRING) || '% [' || CAST(CAST(round_even(lo, 0) AS BIGINT) AS STRING) || '–' || CAST(CAST(round_even(hi, 0) AS BIGINT) AS STRING) || '], n=' || n ELSE '—' END AS text FROM (
  SELECT source, k, n, {_wilson('k', 'n').replace('round_even(100 * greatest', '(100 * greatest').replace('round_even(100 * least', '(100 * least').replace(', 1) AS ci95_low_pct', ') AS lo').replace(', 1) AS ci95_high_pct', ') AS hi')} FROM (SELECT source, count(*) FILTER (n_chars > 600) AS k, count(*) AS n FROM documents GROUP BY source))""")
def _(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 600).alias("k"), F.count(F.lit(1)).alias("n"))
    return d.select("source", numbers.pct_with_interval(F.col("k"), F.col("n")).alias("text"))


@query("x20_x21_calendar", ctes("posts") + """SELECT printf('%d-W%02d', isoyear(ts), weekofyear(ts)) AS week, strftime(ts, '%Y-%m') AS month, strftime(date_trunc('month', ts) - INTERVAL 1 MONTH, '%Y-%m') AS prev_month,
  strftime(greatest(CAST(date_trunc('month', ts) AS DATE), DATE '1996-02-10'), '%Y-%m-%d') AS from_day, strftime(least(last_day(CAST(ts AS DATE)), DATE '2000-02-10'), '%Y-%m-%d') AS to_day, count(*) AS n FROM posts GROUP BY ALL""")
def _(spark, sf):
    p = view(spark, sf, "posts").withColumn("month", dates.year_month(F.col("ts")))
    a, b = dates.month_bounds(F.col("month"), F.lit("1996-02-10"), F.lit("2000-02-10"))
    return p.groupBy(dates.iso_week(F.col("ts")).alias("week"), "month", dates.previous_month(F.col("ts")).alias("prev_month"), dates.day_text(a).alias("from_day"), dates.day_text(b).alias("to_day")).agg(F.count(F.lit(1)).alias("n"))


@query("x22_x23_x28_labels", ctes("usage") + """SELECT call_id, CASE user_m WHEN 0 THEN 'Haiku 1' WHEN 1 THEN 'Sonnet 2.5' ELSE model END AS label, CASE WHEN cell LIKE '=%' THEN '''' || cell ELSE cell END AS cell, sha1(cell)[1:10] AS hash
FROM (SELECT *, CASE model WHEN 'vendor-haiku-1' THEN 0 WHEN 'vendor-Sonnet-2' THEN 1 ELSE 2 END AS user_m, CASE WHEN call_id % 3 = 0 THEN '=' || stage WHEN call_id % 3 = 1 THEN '-' || CAST(call_id AS STRING) ELSE stage END AS cell FROM usage)""")
def _(spark, sf):
    u = view(spark, sf, "usage")
    model = F.when(F.col("model") == "vendor-haiku-1", "claude-haiku-1-20250101").when(F.col("model") == "vendor-Sonnet-2", "claude-sonnet-2-5").otherwise(F.col("model"))
    cell = F.when(F.col("call_id") % 3 == 0, F.concat(F.lit("="), "stage")).when(F.col("call_id") % 3 == 1, F.concat(F.lit("-"), F.col("call_id").cast("string"))).otherwise(F.col("stage"))
    return u.select("call_id", text.model_label(model).alias("label"), text.safe_cell(cell).alias("cell"), text.prompt_hash(cell).alias("hash"))


@query("f21_labelled_rows", ctes("cards") + """SELECT card_id, mark IN ('F', 'O') AND priority <> '5-LOW' AND (level <> '' OR direction <> '') AND lower(direction) <> 'none' AS kept
FROM (SELECT *, CASE WHEN price > 300000 THEN '' ELSE 'junior' END AS level, CASE WHEN price > 400000 THEN 'None' WHEN price > 350000 THEN '' ELSE 'qa' END AS direction FROM cards)""")
def _(spark, sf):
    c = view(spark, sf, "cards")
    posts = c.select(F.col("card_id").cast("string").alias("key"), F.when((F.col("mark") == "F") & (F.col("priority") != "5-LOW"), " Y").when((F.col("mark") == "O") & (F.col("priority") != "5-LOW"), "ні").otherwise("?").alias("true_is_vacancy"))
    rows = c.select(F.col("card_id").cast("string").alias("key"), "card_id", F.lit("").alias("true_title"), F.lit(" ").alias("true_is_it"),
                    F.when(F.col("price") > 400000, "None").when(F.col("price") > 350000, "").otherwise("qa").alias("true_direction"), F.when(F.col("price") > 300000, "").otherwise("junior").alias("true_level"))
    kept = evaluate.truth_rows(rows, posts).select("card_id", F.lit(True).alias("kept"))
    return c.select("card_id").join(kept, "card_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@query("q6_verify_and_repair", ctes("cards") + """SELECT 'лог показаних' AS name, true AS ok, count(*) FILTER (mark = 'P' AND price <= 100000) > 0 AS repaired FROM cards
UNION ALL SELECT 'джерела', count(*) FILTER (source = 'board-a') = 0, false FROM cards""")
def _(spark, sf):
    """The shown log lacks lines and is repaired once; a missing source cannot be repaired."""
    from jobstrata.operators import tables
    from jobstrata.session import scratch_path
    path = scratch_path(spark, "shown_log")
    own = view(spark, sf, "cards").select("run_date", F.concat(F.col("card_id").cast("string"), F.lit(" | "), "title").alias("line"), "mark", "price", "source")
    own.where("NOT (mark = 'P' AND price <= 100000)").select("run_date", "line").write.parquet(path)
    rep = own.select("run_date").distinct().withColumn("repeat", F.lit(False))
    read = lambda: spark.read.schema("run_date date, line string").parquet(path)

    def repair():
        missing = own.select("run_date", "line").join(read(), ["run_date", "line"], "left_anti")
        tables.append_strict(missing, path, ["run_date", "line"])

    registry = own.select("source").distinct()
    missing = lambda: quality.check_sources(registry, own.where("source <> 'board-a'").select("source", F.lit("OK").alias("status"))).select(F.lit(False).alias("ok"), F.col("source").alias("reason"))
    done = quality.verify_writes({"лог показаних": (lambda: quality.check_shown_log(read(), own.select("run_date", "line"), rep, "run_date"), repair), "джерела": (missing, None)})
    return spark.createDataFrame([(r["name"], r["ok"], r["repaired"]) for r in done], "name string, ok boolean, repaired boolean")
