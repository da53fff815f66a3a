"""Queries: known postings, the rules of the funnel and its decisions."""
from __future__ import annotations

from pyspark.sql import functions as F

from jobstrata.functions import dates, text, urls
from jobstrata.functions.numbers import budget_uah, competition_level
from jobstrata.operators import funnel, known, scale
from jobstrata.plans.bindings import ctes, view
from jobstrata.plans.registry import query

EV = ["card_id", "passes_criteria", "reject_code", "reject_reason", "match_level", "score_skills", "score_duties", "score_expectations",
      "veteran_bonus", "near_miss", "posted_date", "date_undetermined", "failed"]


def nurl(u):
    return rf"regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({u}, ''))), '^https?://(www\.)?', ''), '#.*$', ''), '/+$', '')"


def pid(u):
    n = nurl(u)
    num = ", ".join(f"nullif(regexp_extract({n}, '{p}', 1), '')" for p in (r"vacancy(\d+)", r"[?&]id=(\d+)", r"/vacancies/(\d+)", r"/jobs/(\d+)"))
    return f"(array_to_string(string_split(split_part(split_part({n}, '/', 1), '?', 1), '.')[-2:], '.') || ':' || coalesce({num}))"


def eid(u):
    return f"(CASE WHEN coalesce({u}, '') <> '' THEN coalesce({pid(u)}, 'u:' || {nurl(u)}) END)"


AGE = ("CASE posted_raw WHEN '' THEN NULL WHEN 'сьогодні' THEN 0 WHEN 'вчора' THEN 1 WHEN '10h ago' THEN 0 WHEN '3 дн. тому' THEN 3 "
       "WHEN 'updated 1 day ago' THEN 1 WHEN '2 тиж. тому' THEN 14 ELSE CAST(datediff('day', CAST(posted_raw[1:10] AS DATE), run_date) AS INTEGER) END")
SENIOR, JUNIOR = r"regexp_matches(lower(title), '\b(senior|middle|lead)\b')", r"regexp_matches(lower(title), '\bjunior\b')"
SENIOR_WORD = r"regexp_extract(title, '(?i)\b(senior|middle|lead)\b')"
KNOWN = ("known", f"SELECT cards.*, CASE WHEN a.k IS NOT NULL THEN 'подано' WHEN l.k IS NOT NULL THEN 'дубль' END AS known FROM cards "
         f"LEFT JOIN (SELECT DISTINCT {eid('nullif(trim(url), chr(0))')} AS k FROM applied WHERE trim(url) <> '') a ON {eid('cards.url')} = a.k "
         f"LEFT JOIN (SELECT DISTINCT {eid('identifier')} AS k FROM shown_log) l ON {eid('cards.url')} = l.k")
PRE = ("pre", f"""SELECT *, CASE WHEN known IS NOT NULL THEN known WHEN age >= 2 THEN 'дата' WHEN {SENIOR} AND NOT {JUNIOR} THEN 'досвід' WHEN url IS NULL THEN 'інше' END AS pre_code,
  CASE WHEN known IS NOT NULL THEN 'відомий ID вакансії до оцінки' WHEN age >= 2 THEN 'поза вікном сьогодні/вчора (картка, ' || age || ' дн.)'
       WHEN {SENIOR} AND NOT {JUNIOR} THEN 'рівень у назві: ' || {SENIOR_WORD} WHEN url IS NULL THEN 'немає URL вакансії' END AS pre_detail,
  {SENIOR} AND {JUNIOR} AS cap_medium FROM (SELECT *, {AGE} AS age FROM known)""")


def level_sql(card_only):
    valid = " AND ".join(f"coalesce({c} BETWEEN 0 AND 2, false)" for c in ("score_skills", "score_duties", "score_expectations"))
    t = "(score_skills + score_duties + score_expectations)"
    comp = f"CASE WHEN score_skills = 0 OR score_duties = 0 OR {t} <= 2 THEN 2 WHEN {t} >= 5 THEN 0 ELSE 1 END"
    said = "CASE match_level WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 END"
    rank = f"CASE WHEN {valid} THEN greatest({comp}, coalesce({said}, 0)) ELSE coalesce({said}, 2) END"
    return f"CASE CASE WHEN {card_only} AND ({rank}) = 0 THEN 1 ELSE {rank} END WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END"


def _level(card_only):
    return funnel.match_level(F.col("match_level"), F.col("score_skills"), F.col("score_duties"), F.col("score_expectations"), card_only)


@query("x5_x6_x7_url_keys", f"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\\.)?', ''), '[?#].*$', ''), '/+$', '') AS url_key, {nurl('url')} AS norm_url, {pid('url')} AS posting_id FROM pages")
def _(spark, sf):
    from jobstrata.plans.bindings import table
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.url_key(u).alias("url_key"), urls.norm_url(u).alias("norm_url"), urls.posting_id(u).alias("posting_id"))


@query("x7_posting_ids", ctes("cards") + f"SELECT card_id, {pid('url')} AS posting_id, {eid('url')} AS identity FROM cards")
def _(spark, sf):
    return view(spark, sf, "cards").select("card_id", urls.posting_id(F.col("url")).alias("posting_id"), urls.identity(F.col("url")).alias("identity"))


@query("x11_card_ages", ctes("cards") + f"SELECT card_id, {AGE} AS age FROM cards")
def _(spark, sf):
    return view(spark, sf, "cards").select("card_id", dates.age_days(F.col("posted_raw"), F.col("run_date")).alias("age"))


@query("j1_j23_known_before_evaluation", ctes("cards", "applied", "shown_log", KNOWN) + "SELECT card_id, known FROM known")
def _(spark, sf):
    return known.prefilter_known(view(spark, sf, "cards"), view(spark, sf, "shown_log"), view(spark, sf, "applied")).select("card_id", "known")


@query("j23_known_without_log", ctes("cards", "applied") + f"SELECT card_id, CASE WHEN {eid('url')} IN (SELECT {eid('url')} FROM applied WHERE trim(url) <> '') THEN 'подано' END AS known, 2 AS dedup_level FROM cards")
def _(spark, sf):
    level, _note = known.dedup_level(False, True)
    return known.prefilter_known(view(spark, sf, "cards"), None, view(spark, sf, "applied")).select("card_id", "known", F.lit(level).alias("dedup_level"))


_LABEL = "coalesce(title, '') || ' — ' || coalesce(company, '')"
_DUP_IDS = f"""SELECT card_id FROM cards WHERE {eid('url')} IN (SELECT {eid('identifier')} FROM shown_log)
  OR ({pid('url')} IS NULL AND (coalesce(url, lower(trim(title)) || '|' || lower(trim(company))) IN (SELECT identifier FROM shown_log) OR lower({_LABEL}) IN (SELECT lower(label) FROM shown_log)))"""


@query("j2_shown_duplicates", ctes("cards", "shown_log") + _DUP_IDS)
def _(spark, sf):
    return known.shown_duplicates(view(spark, sf, "cards"), view(spark, sf, "shown_log"))


_REPOST = f"""SELECT card_id, max(d) AS repost_date FROM (SELECT card_id, {eid('url')} AS own, lower({_LABEL}) AS lb FROM cards)
  JOIN (SELECT lower(label) AS lb, {eid('identifier')} AS other, max(CAST(shown_date AS DATE)) AS d FROM shown_log GROUP BY ALL) USING (lb) WHERE own IS DISTINCT FROM other OR own IS NULL GROUP BY card_id"""


@query("j3_reposts", ctes("cards", "shown_log", ("rep", _REPOST)) + "SELECT card_id, strftime(repost_date, '%Y-%m-%d') AS repost_date, CASE WHEN datediff('day', repost_date, run_date) < 7 THEN 'near' ELSE 'flag' END AS state FROM rep JOIN cards USING (card_id)")
def _(spark, sf):
    cards = view(spark, sf, "cards")
    rep = known.repost_dates(cards, view(spark, sf, "shown_log")).join(cards.select("card_id", "run_date"), "card_id")
    return rep.select("card_id", dates.day_text(F.col("repost_date")).alias("repost_date"), known.repost_state(F.col("run_date"), F.col("repost_date")).alias("state"))


_APPLIED = f"""SELECT card_id, CASE WHEN dup IS NOT NULL THEN 'дубль' ELSE 'прапорець' END AS verdict, CASE WHEN dup IS NOT NULL THEN dup_status ELSE any_status END AS status FROM (
  SELECT c.card_id, min(a.row_no) FILTER (hit) AS dup, arg_min(a.status, a.row_no) FILTER (hit) AS dup_status, arg_min(a.status, a.row_no) FILTER (same_co) AS any_status FROM (
    SELECT c.card_id, a.row_no, true AS hit, false AS same_co FROM cards c JOIN applied a ON {eid('c.url')} = {eid('a.url')} WHERE trim(a.url) <> ''
    UNION ALL SELECT c.card_id, a.row_no, trim(a.url) = '' OR contains(lower(a.notes), lower(trim(c.title))), true FROM cards c JOIN applied a ON lower(trim(c.company)) = lower(trim(a.company)) WHERE trim(c.company) <> '') c
  JOIN applied a USING (row_no) GROUP BY c.card_id) WHERE dup IS NOT NULL OR any_status IS NOT NULL"""


@query("j4_application_check", ctes("cards", "applied") + _APPLIED)
def _(spark, sf):
    return known.application_check(view(spark, sf, "cards"), view(spark, sf, "applied"))


@query("j5_new_gigs", ctes("gigs", ("glog", "SELECT 'https://gigs.example/project/' || CAST(c_custkey * 3 AS STRING) AS url FROM customer")) + "SELECT gig_id, url FROM gigs WHERE url NOT IN (SELECT url FROM glog)")
def _(spark, sf):
    from jobstrata.plans.bindings import table
    shown = table(spark, sf, "customer").select(F.concat(F.lit("https://gigs.example/project/"), (F.col("c_custkey") * 3).cast("string")).alias("url"))
    return view(spark, sf, "gigs").join(shown, "url", "left_anti").select("gig_id", "url")


@query("j6_attach_evaluations", ctes("cards", "evaluations") + """SELECT card_id, CASE WHEN k IN (0, 1) AND NOT omitted THEN passes_criteria END AS passes_criteria,
  CASE WHEN k IN (0, 1) AND NOT omitted THEN reject_code END AS reject_code, CASE WHEN k IN (0, 1) AND NOT omitted THEN 'evaluated' ELSE 'не оцінено' END AS state
FROM (SELECT *, CAST(floor(card_id / 20) AS BIGINT) % 3 AS k FROM cards JOIN evaluations USING (card_id))""")
def _(spark, sf):
    """Answers are rendered per batch of twenty (object, bare list or garbage) and read back."""
    ev = view(spark, sf, "evaluations").withColumn("batch_id", F.floor(F.col("card_id") / 20)).withColumn("raw_index", (F.col("card_id") % 20).cast("int"))
    items = F.sort_array(F.collect_list(F.when(~F.col("omitted"), F.struct("raw_index", "passes_criteria", "reject_code", "near_miss"))))
    stray = F.array(F.struct(F.lit(99).alias("raw_index"), F.lit(True).alias("passes_criteria"), F.lit("x").alias("reject_code"), F.lit(True).alias("near_miss")))
    batches = ev.groupBy("batch_id").agg(items.alias("items"), F.lit(20).alias("size"))
    kind = F.col("batch_id") % 3
    answer = (F.when(kind == 0, F.to_json(F.struct(F.concat("items", stray).alias("evaluations")))).when(kind == 1, F.to_json(F.concat(stray, "items"))).otherwise('"no json here"'))
    parsed = funnel.parse_batches(batches.select("batch_id", "size", answer.alias("answer")))
    asked = view(spark, sf, "cards").select("card_id", F.floor(F.col("card_id") / 20).alias("batch_id"), (F.col("card_id") % 20).cast("int").alias("raw_index"))
    j = asked.join(parsed, ["batch_id", "raw_index"], "left")
    return j.select("card_id", F.col("ev.passes_criteria").alias("passes_criteria"), F.col("ev.reject_code").alias("reject_code"),
                    F.when(F.col("ev").isNotNull(), "evaluated").otherwise("не оцінено").alias("state"))


@query("j7_answers_to_repeat", "SELECT 'ask' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'valid', count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def _(spark, sf):
    from jobstrata.plans.bindings import table
    asked, answered = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    n = F.count(F.lit(1)).alias("n")
    again = funnel.missing_answers(asked, answered, "doc_id").agg(n).select(F.lit("ask").alias("kind"), "n")
    return again.unionByName(funnel.valid_answers(answered, asked, "doc_id").agg(n).select(F.lit("valid").alias("kind"), "n"))


@query("f1_f2_f3_prefilter", ctes("cards", "applied", "shown_log", KNOWN, PRE) + "SELECT card_id, pre_code, pre_detail, cap_medium FROM pre")
def _(spark, sf):
    d = known.prefilter_known(view(spark, sf, "cards"), view(spark, sf, "shown_log"), view(spark, sf, "applied"))
    return funnel.prefilter(d).select("card_id", "pre_code", "pre_detail", "cap_medium")


@query("x16_match_levels", ctes("evaluations") + f"SELECT card_id, {level_sql('false')} AS level, {level_sql('true')} AS card_level FROM evaluations")
def _(spark, sf):
    return view(spark, sf, "evaluations").select("card_id", _level(F.lit(False)).alias("level"), _level(F.lit(True)).alias("card_level"))


_VERDICT = f"""CASE WHEN omitted THEN NULL WHEN failed THEN NULL WHEN NOT passes_criteria THEN false ELSE ({level_sql('false')}) <> 'Low' END"""
_VERDICT_TEXT = f"""CASE WHEN omitted THEN 'не оцінено' WHEN failed THEN 'не оцінено (помилка Claude)'
  WHEN NOT passes_criteria THEN 'відсіяно · ' || coalesce(reject_code, 'інше') || CASE WHEN reject_reason <> '' THEN ': ' || reject_reason ELSE '' END
  WHEN ({level_sql('false')}) = 'Low' THEN 'відсіяно · Low на етапі 1 (картка) · Match Low' ELSE 'пройшла · Match ' || ({level_sql('false')}) END"""


def _verdict():
    c = F.col
    return funnel.verdict(~c("omitted"), c("failed"), c("passes_criteria"), c("reject_code"), c("reject_reason"), _level(F.lit(False)))


@query("f4_stage_one_verdicts", ctes("evaluations") + f"SELECT card_id, {_VERDICT} AS passed, {_VERDICT_TEXT} AS text FROM evaluations")
def _(spark, sf):
    return view(spark, sf, "evaluations").select("card_id", _verdict().alias("v")).select("card_id", "v.*")


@query("j16_two_evaluators", ctes("evaluations") + f"""SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS compared, count(*) FILTER (a = b) AS agree, count(*) FILTER (a <> b) AS disagree,
  count(*) FILTER (a AND NOT b) AS first_pass_second_reject, count(*) FILTER (b AND NOT a) AS second_pass_first_reject, count(*) FILTER (a IS NULL OR b IS NULL) AS not_compared
FROM (SELECT {_VERDICT} AS a, CASE WHEN card_id % 12 = 0 THEN NULL ELSE score_duties > 0 END AS b FROM evaluations)""")
def _(spark, sf):
    ev = view(spark, sf, "evaluations")
    a = ev.select("card_id", _verdict()["passed"].alias("a"))
    b = ev.select("card_id", F.when(F.col("card_id") % 12 != 0, F.col("score_duties") > 0).alias("b"))
    return a.join(b, "card_id", "full").agg(*funnel.agreement(F.col("a"), F.col("b")))


_GATE = ("gate", f"SELECT card_id, run_date, {level_sql('false')} AS level1, passes_criteria AND NOT failed AND ({level_sql('false')}) <> 'Low' AS eligible FROM cards JOIN evaluations USING (card_id)")


@query("f5_w7_stage_gate", ctes("cards", "evaluations", _GATE) + """SELECT card_id, level1, eligible, eligible AND r <= 3 AS stage2 FROM (
  SELECT *, row_number() OVER (PARTITION BY run_date, eligible ORDER BY CASE level1 WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, card_id) AS r FROM gate)""")
def _(spark, sf):
    """The cap is three per run here, so that it binds at every scale factor."""
    ev = view(spark, sf, "evaluations").withColumn("level1", _level(F.lit(False)))
    d = view(spark, sf, "cards").select("card_id", "run_date").join(ev, "card_id")
    d = d.withColumn("eligible", F.col("passes_criteria") & ~F.col("failed") & (F.col("level1") != "Low"))
    return funnel.stage_two_cap(d, "eligible", 3).select("card_id", "level1", "eligible", "stage2")


_INW = "posted_date IS NULL OR posted_date = 'скоро' OR datediff('day', CAST(CASE WHEN posted_date <> 'скоро' THEN posted_date END AS DATE), run_date) BETWEEN 0 AND 1"


@query("f6_f19_date_window", ctes("cards", "evaluations") + f"SELECT card_id, {_INW} AS in_window, near_miss AND ({_INW}) AS near FROM cards JOIN evaluations USING (card_id)")
def _(spark, sf):
    d = view(spark, sf, "cards").select("card_id", "run_date").join(view(spark, sf, "evaluations"), "card_id")
    w = funnel.in_window(F.col("posted_date"), F.col("run_date"))
    return d.select("card_id", w.alias("in_window"), (F.col("near_miss") & w).alias("near"))


@query("f7_x14_x15_gig_rejects", ctes("gigs") + r"""SELECT gig_id, budget, competition, CASE WHEN source <> 'gig-board' THEN NULL
  WHEN regexp_matches(title, '(?i)\bbas\b|\b1[сcСC]\b|1[СсCc]:') OR title LIKE '%1С:%' THEN 'специфічна система (BAS/1С)'
  WHEN regexp_matches(title, '(?i)\berp\b') AND (budget IS NULL OR budget <= 10000) THEN 'ERP / автоматичне планування з малим бюджетом або без бюджету'
  WHEN budget IS NULL AND competition = 'висока' THEN 'бюджет не вказано, висока конкуренція' END AS reason
FROM (SELECT *, TRY_CAST(nullif(regexp_extract(budget_raw, '(\d+)', 1), '') AS DOUBLE) * CASE WHEN budget_raw LIKE '%USD' THEN 41.0 ELSE 1.0 END::DOUBLE AS budget,
  CASE WHEN bids_count IS NULL THEN NULL WHEN bids_count <= 14 THEN 'низька' WHEN bids_count <= 40 THEN 'середня' ELSE 'висока' END AS competition FROM gigs)""")
def _(spark, sf):
    g = view(spark, sf, "gigs")
    reason = funnel.gig_hard_reject(F.col("source"), F.col("title"), F.lit(""), F.col("budget_raw"), F.col("bids_count"))
    return g.select("gig_id", budget_uah(F.col("budget_raw")).alias("budget"), competition_level(F.col("bids_count")).alias("competition"), reason.alias("reason"))


_PROFILE = """CASE WHEN NOT is_it OR direction <> 'analytics' THEN 'роль' WHEN level NOT IN ('intern', 'junior', 'unspecified') OR coalesce(experience_years_min > 1, false) THEN 'досвід'
  WHEN work_format NOT IN ('remote', 'unspecified') THEN 'формат' WHEN salary_period = 'month' AND coalesce(coalesce(salary_min, salary_max) < CASE salary_currency WHEN 'USD' THEN 700 ELSE 30000 END, false) THEN 'ЗП'
  WHEN list_contains(list_transform(string_split(skills, ';'), lambda s: lower(trim(s))), 'uml') THEN 'стоп-навик' END"""


@query("f8_profile_rejects", ctes("mentions") + f"SELECT post_id, vacancy_idx, part_id, supp_id, {_PROFILE} AS reject FROM mentions")
def _(spark, sf):
    m = view(spark, sf, "mentions")
    cols = {c: F.col(c) for c in ("is_it", "direction", "level", "work_format", "salary_min", "salary_max", "salary_currency", "salary_period", "title", "company", "skills")}
    return m.select("post_id", "vacancy_idx", "part_id", "supp_id", funnel.profile_reject({**cols, "experience": F.col("experience_years_min")}).alias("reject"))


@query("a7_profile_funnel", ctes("mentions") + f"SELECT coalesce({_PROFILE}, 'пройшла') AS code, count(*) AS n FROM mentions GROUP BY ALL")
def _(spark, sf):
    m = view(spark, sf, "mentions")
    cols = {c: F.col(c) for c in ("is_it", "direction", "level", "work_format", "salary_min", "salary_max", "salary_currency", "salary_period", "title", "company", "skills")}
    reject = funnel.profile_reject({**cols, "experience": F.col("experience_years_min")})
    return m.groupBy(F.coalesce(reject, F.lit("пройшла")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


_CODE = "CASE mark WHEN 'F' THEN 'відсіяно' WHEN 'O' THEN CASE WHEN price > 300000 THEN 'майже' ELSE 'не оцінено (ліміт бюджету)' END ELSE CASE WHEN price < 20000 THEN 'ПІДСУМОК' ELSE 'показано' END END"
_REASON = "CASE priority WHEN '1-URGENT' THEN 'подано' WHEN '2-HIGH' THEN 'роль' WHEN '3-MEDIUM' THEN 'ЗП' WHEN '5-LOW' THEN 'дубль' ELSE '' END"
LOGGED = ("logged", f"SELECT *, {_CODE} AS result, {_REASON} AS code FROM cards")
STATUS = """CASE WHEN result = 'ПІДСУМОК' OR starts_with(result, 'не оцінено') THEN NULL WHEN result = 'майже' THEN 'personal_reject'
  WHEN result = 'відсіяно' THEN CASE WHEN code = 'подано' THEN 'applied' WHEN code IN ('роль', 'ЗП') THEN 'personal_reject' ELSE 'technical' END ELSE 'shown' END"""


def logged(spark, sf):
    return view(spark, sf, "cards").selectExpr("*", f"{_CODE} AS result", f"{_REASON} AS code")


@query("f9_f10_log_status", ctes("cards", LOGGED) + f"SELECT card_id, status, coalesce(status IN ('shown', 'applied'), false) AS strict, coalesce(status IN ('shown', 'applied', 'personal_reject'), false) AS wide FROM (SELECT *, {STATUS} AS status FROM logged)")
def _(spark, sf):
    d = logged(spark, sf).withColumn("status", funnel.log_status(F.col("result"), F.col("code")))
    within = lambda names: F.coalesce(F.col("status").isin(*names), F.lit(False))
    return d.select("card_id", "status", within(funnel.STRICT).alias("strict"), within(funnel.WIDE).alias("wide"))


@query("f18_x19_categories", ctes("cards", "evaluations") + """SELECT card_id, CASE WHEN veteran_bonus AND d THEN 'обидві' WHEN veteran_bonus THEN 'ветеран' WHEN d THEN 'інвалідність' ELSE '—' END AS category
FROM (SELECT *, contains(lower(snippet), 'people with disabilities') AS d FROM cards JOIN evaluations USING (card_id))""")
def _(spark, sf):
    d = view(spark, sf, "cards").join(view(spark, sf, "evaluations"), "card_id")
    return d.select("card_id", funnel.category(F.col("veteran_bonus"), text.mentions_disability(F.col("snippet"))).alias("category"))


@query("w6_undated_cap", ctes("cards", "evaluations") + """SELECT card_id, NOT date_undetermined OR r <= 2 AS passes FROM (
  SELECT *, row_number() OVER (PARTITION BY run_date, date_undetermined ORDER BY card_id) AS r FROM cards JOIN evaluations USING (card_id))""")
def _(spark, sf):
    """At most two undated cards per run here, so that the cap binds on a day's few cards."""
    d = view(spark, sf, "cards").select("card_id", "run_date").join(view(spark, sf, "evaluations").select("card_id", "date_undetermined"), "card_id")
    first = scale.first_k_per_group(d.where("date_undetermined"), ["run_date"], [F.col("card_id")], 2, "card_id", "ok").select("card_id", "ok")
    return d.join(first, "card_id", "left").select("card_id", (~F.col("date_undetermined") | F.col("ok")).alias("passes"))


@query("w8_nearest_misses", ctes("cards", "evaluations") + """SELECT card_id, CASE WHEN r <= 3 THEN 'майже' ELSE 'відсіяно' END AS result FROM (
  SELECT *, row_number() OVER (PARTITION BY date_trunc('month', run_date) ORDER BY coalesce(posted_date, '') DESC, card_id) AS r FROM cards JOIN evaluations USING (card_id) WHERE near_miss)""")
def _(spark, sf):
    d = view(spark, sf, "cards").select("card_id", F.trunc("run_date", "month").alias("run")).join(view(spark, sf, "evaluations").where("near_miss"), "card_id")
    top = scale.first_k_per_group(d, ["run"], [F.desc(F.coalesce("posted_date", F.lit(""))), F.col("card_id")], 3, "card_id", "kept")
    return top.select("card_id", F.when(F.col("kept"), "майже").otherwise("відсіяно").alias("result"))


# the cost of a call in micro-dollars, and the budget of a run in the query that has one
USD_CARD, USD_FULL, BUDGET = "(400 + card_id % 7 * 100)", "(500 + card_id % 5 * 400)", 1500


def decided_sql(budget: int) -> list:
  before = "coalesce(sum({}) OVER (PARTITION BY run_date ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
  return [
    "cards", "applied", "shown_log", "evaluations", KNOWN, PRE,
    ("bg", f"SELECT *, pre_code IS NULL AND {before.format(f'CASE WHEN pre_code IS NULL THEN {USD_CARD} END', 'card_id')} >= {budget} AS over1 FROM pre"),
    ("e1", f"SELECT pre.*, sum(CASE WHEN pre_code IS NULL AND NOT over1 THEN {USD_CARD} ELSE 0 END) OVER (PARTITION BY run_date) AS spent1, e.* EXCLUDE (card_id), NOT e.omitted AND NOT over1 AS has1, price > 200000 AS full_text, pre_code IS NULL AND NOT over1 AND NOT e.omitted AND NOT e.failed AND e.passes_criteria AS passed1, {level_sql('false')} AS level1 FROM bg pre JOIN evaluations e USING (card_id)"),
    ("rk", "SELECT *, passed1 AND level1 <> 'Low' AS ranked, row_number() OVER (PARTITION BY run_date, passed1 AND level1 <> 'Low' ORDER BY CASE level1 WHEN 'High' THEN 0 ELSE 1 END, card_id) AS rr FROM e1"),
    ("st1", "SELECT *, ranked AND rr <= 20 AS stage2 FROM rk"),
    ("st2", f"SELECT *, stage2 AND spent1 + {before.format(f'CASE WHEN stage2 THEN {USD_FULL} END', 'CASE WHEN stage2 THEN rr END NULLS LAST, card_id')} >= {budget} AS over2, CASE WHEN posted_date <> 'скоро' THEN CAST(posted_date AS DATE) END AS d FROM st1"),
    ("und", "SELECT *, date_undetermined OR (posted_date IS NOT NULL AND d IS NULL) AS undated FROM st2"),
    ("st", f"""SELECT *, CASE WHEN pre_code IS NOT NULL THEN 'pre' WHEN over1 OR over2 THEN 'budget' WHEN ranked AND NOT stage2 THEN 'cap' WHEN (NOT stage2 AND NOT has1) OR failed THEN 'failed' WHEN passed1 AND level1 = 'Low' THEN 'low'
       WHEN NOT passes_criteria THEN CASE WHEN near_miss AND ({_INW}) THEN 'near' ELSE 'rejected' END WHEN NOT undated AND d IS NOT NULL AND NOT datediff('day', d, run_date) BETWEEN 0 AND 1 THEN 'date' ELSE 'final' END AS state FROM und"""),
    ("dups", _DUP_IDS), ("app", _APPLIED), ("rep", _REPOST),
    ("oc", """SELECT st.*, app.verdict, app.status AS app_status, repost_date, CASE WHEN state <> 'final' THEN state WHEN dups.card_id IS NOT NULL THEN 'dup' WHEN verdict = 'дубль' THEN 'applied'
       WHEN datediff('day', repost_date, run_date) < 7 THEN 'repost' ELSE 'shown' END AS o FROM st LEFT JOIN dups USING (card_id) LEFT JOIN app USING (card_id) LEFT JOIN rep USING (card_id)"""),
    ("uc", "SELECT *, CASE WHEN o = 'shown' AND undated AND row_number() OVER (PARTITION BY run_date, o, undated ORDER BY card_id) > 5 THEN 'undated' ELSE o END AS o2 FROM oc"),
    ("nr", "SELECT *, CASE WHEN o2 = 'repost' THEN 'near' ELSE o2 END AS s, o2 = 'repost' AS rp FROM uc"),
    ("nk", "SELECT *, row_number() OVER (PARTITION BY run_date, s ORDER BY coalesce(posted_date, '') DESC, card_id) AS nrank FROM nr"),
    ("fin", f"SELECT *, CASE WHEN cap_medium AND lv = 'High' THEN 'Medium' ELSE lv END AS flevel FROM (SELECT *, {level_sql('NOT full_text')} AS lv FROM nk)"),
    ("decided", """SELECT card_id, strftime(run_date, '%Y-%m-%d') AS run_date, source, coalesce(url, '') AS url, title || ' — ' || company AS label,
  CASE WHEN s = 'shown' THEN 'показано' WHEN s = 'near' AND nrank <= 5 THEN 'майже' WHEN s = 'cap' THEN 'не оцінено (ліміт етапу 2)' WHEN s = 'failed' THEN 'не оцінено (помилка Claude)' WHEN s = 'budget' THEN 'не оцінено (ліміт бюджету)' ELSE 'відсіяно' END AS result,
  CASE WHEN s = 'pre' THEN pre_code WHEN s = 'cap' THEN 'ліміт_етапу_2' WHEN s = 'budget' THEN 'ліміт_бюджету' WHEN s = 'failed' THEN 'помилка_Claude' WHEN s = 'low' THEN 'інше' WHEN s = 'dup' OR rp THEN 'дубль' WHEN s = 'applied' THEN 'подано' WHEN s = 'date' THEN 'дата'
       WHEN s = 'undated' THEN 'ліміт_невизначеної_дати' WHEN s = 'shown' THEN '—' ELSE coalesce(reject_code, 'інше') END AS code,
  CASE WHEN s = 'pre' THEN pre_detail WHEN s = 'cap' THEN 'ліміт етапу 2: 20' WHEN s = 'budget' THEN CASE WHEN over2 THEN 'етап 2' ELSE 'етап 1' END WHEN s = 'failed' THEN CASE WHEN stage2 THEN 'етап 2' WHEN NOT has1 THEN 'модель не повернула оцінку' ELSE 'етап 1' END WHEN s = 'low' THEN 'Low на етапі 1 (картка)'
       WHEN s = 'dup' THEN 'після оцінки' WHEN s = 'applied' THEN 'таблиця відгуків' WHEN s = 'date' THEN 'поза вікном сьогодні/вчора' WHEN s = 'undated' THEN ''
       WHEN rp THEN 'репост вакансії, показаної ' || strftime(repost_date, '%d.%m') || ' (менше 7 днів тому)' WHEN s = 'shown' THEN flevel || ' · ' || CASE WHEN full_text THEN 'сторінка' ELSE 'лише картка' END ELSE reject_reason END AS detail,
  CASE WHEN vet AND dis THEN 'обидві' WHEN vet THEN 'ветеран' WHEN dis THEN 'інвалідність' ELSE '—' END AS category,
  CASE WHEN s = 'shown' THEN flevel END AS level, CASE WHEN s = 'shown' AND verdict = 'прапорець' THEN 'Компанія вже в таблиці: ' || coalesce(nullif(app_status, ''), 'без статусу') ELSE '' END AS company_flag,
  s = 'shown' AND undated AS undated,
  coalesce(CASE WHEN s = 'pre' THEN CASE WHEN pre_code = 'дата' THEN strftime(run_date - age, '%Y-%m-%d') END WHEN s NOT IN ('cap', 'failed', 'budget', 'undated') THEN posted_date END, '') AS posted_date,
  CASE WHEN s = 'undated' OR s = 'shown' AND undated THEN 'невідома' WHEN s NOT IN ('pre', 'cap', 'failed', 'budget') AND posted_date <> '' AND NOT date_undetermined THEN CASE WHEN full_text AND stage2 THEN 'сторінка' ELSE 'картка' END
       WHEN posted_raw <> '' THEN 'картка' ELSE 'невідома' END AS date_source,
  CASE WHEN s = 'pre' THEN '' WHEN over1 THEN 'не оцінено (ліміт бюджету)' ELSE """ + _VERDICT_TEXT + """ END AS verdict, CASE WHEN s = 'pre' THEN '' WHEN card_id % 12 = 0 THEN 'не оцінено' ELSE """ + _VERDICT_TEXT.replace("omitted", "false") + """ END AS shadow_verdict
FROM (SELECT *, veteran_bonus AND (stage2 OR has1) AND NOT over2 AS vet, contains(lower(snippet), 'people with disabilities') AS dis FROM fin)""")]


DECIDED = decided_sql(10 ** 15)


def decided(spark, sf, **budget):
    cards, ev = view(spark, sf, "cards"), view(spark, sf, "evaluations")
    texts = cards.where("price > 200000").select("card_id", F.concat(F.lit("page "), "snippet").alias("full_text"))
    return funnel.decide(cards, ev.where("NOT omitted").select(*EV), ev.select(*EV), texts, view(spark, sf, "shown_log"), view(spark, sf, "applied"),
                         shadow=ev.where("card_id % 12 <> 0").select(*EV), **budget)


@query("f24_w11_budget_decisions", ctes(*decided_sql(BUDGET)) + "SELECT * FROM decided")
def _(spark, sf):
    """A budget that most runs use up: of later cards the decision says that they were not evaluated."""
    spending = view(spark, sf, "cards").select("card_id", F.expr(f"CAST({USD_CARD} AS BIGINT)").alias("usd_card"), F.expr(f"CAST({USD_FULL} AS BIGINT)").alias("usd_full"))
    return decided(spark, sf, spending=spending, budget=BUDGET).withColumn("run_date", dates.day_text(F.col("run_date")))


@query("f23_f24_j24_decisions", ctes(*DECIDED) + "SELECT * FROM decided")
def _(spark, sf):
    d = decided(spark, sf)
    return d.withColumn("run_date", dates.day_text(F.col("run_date")))


@query("a17_decision_summary", ctes(*DECIDED) + """SELECT run_date, count(*) AS found, count(*) FILTER (result = 'показано') AS shown, count(*) FILTER (result = 'відсіяно') AS rejected,
  count(*) FILTER (result = 'майже') AS near, count(*) FILTER (starts_with(result, 'не оцінено')) AS not_evaluated FROM decided GROUP BY ALL""")
def _(spark, sf):
    from jobstrata.operators.monitor import decision_summary
    return decision_summary(decided(spark, sf), "run_date").withColumn("run_date", dates.day_text(F.col("run_date")))
