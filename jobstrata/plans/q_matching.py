"""Queries: the site's cards against the feed's unique postings."""
from __future__ import annotations

from pyspark.sql import functions as F

from jobstrata.functions import dates, text
from jobstrata.functions.numbers import half_even
from jobstrata.operators import dedup, funnel, market, matching
from jobstrata.plans.bindings import ctes, table, view
from jobstrata.plans.q_funnel import LOGGED, STATUS, logged
from jobstrata.plans.q_market import GAP_DAYS, IMPUTE_DAYS, mentions, postings
from jobstrata.plans.registry import query
from jobstrata.plans.sqlparts import norm_title, pct, r1, uniques
from jobstrata.session import cut_lineage


def site(spark, sf):
    d = logged(spark, sf).withColumn("status", funnel.log_status(F.col("result"), F.col("code"))).where(F.col("status").isNotNull())
    d = d.select("card_id", "title", "company", "url", F.col("run_date").alias("day"), "status")
    return matching.site_entities(d, F.col("card_id"))


def feed(spark, sf, *columns):
    """The feed's postings with what they are matched by and the given columns."""
    matched_by = ("title", "company", "first_seen", "last_seen", "link")
    return matching.feed_entities(cut_lineage(postings(spark, sf, fixed=False, columns=(*matched_by, *columns)).select(*matched_by, *columns, "ord")), F.col("ord"))


def _tok(t):
    return f"list_sort(list_distinct(list_filter(string_split({norm_title(t)}, ' '), lambda x: x <> '')))"


_CK = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(lower(coalesce(company, '')), 'т', 't'), 'о', 'o'), 'в', 'v'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\b(tov|llc)\b', ' ', 'g'), '\s+', '', 'g')"
_UK = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({u}, ''))), '^https?://(www\.)?', ''), '[?#].*$', ''), '/+$', '')"


def _pairs(fixed=False):
    return [*uniques(fixed), "cards", LOGGED,
            ("s", f"SELECT card_id AS sid, title, company, url, run_date AS day, status, {_tok('title')} AS tk, {_CK} AS ck, {_UK.format(u='url')} AS uk FROM (SELECT *, {STATUS} AS status FROM logged) WHERE status IS NOT NULL"),
            ("f", f"SELECT row_number() OVER (ORDER BY gpos, cstart) AS fid, *, CAST(first_seen AS DATE) - 30 AS lo, CAST(last_seen AS DATE) + 30 AS hi, {_tok('title')} AS tk, {_CK} AS ck, {_UK.format(u='link')} AS uk FROM uniq"),
            ("prs", """SELECT sid, fid, max(lv) AS lv FROM (
  SELECT sid, fid, 3 AS lv FROM s JOIN f ON s.uk = f.uk WHERE s.uk <> ''
  UNION ALL SELECT sid, fid, CASE WHEN s.tk = f.tk THEN 2 ELSE 1 END FROM s JOIN f ON s.ck = f.ck WHERE s.ck <> '' AND s.day BETWEEN f.lo AND f.hi
    AND (s.tk = f.tk OR CAST(len(list_intersect(s.tk, f.tk)) AS DOUBLE) / len(list_distinct(list_concat(s.tk, f.tk))) >= 0.6)
  UNION ALL SELECT sid, fid, 0 FROM s JOIN f ON s.tk = f.tk WHERE (s.ck = '' OR f.ck = '') AND s.day BETWEEN f.lo AND f.hi) GROUP BY ALL"""),
            ("best", "SELECT sid, arg_min(fid, (-lv, fid)) AS fid, max(lv) AS lv FROM prs GROUP BY sid")]


_NAME = "['title_only', 'fuzzy', 'exact', 'url'][lv + 1]"


@query("j10_w9_best_matches", ctes(*_pairs()) + f"SELECT sid AS card_id, {_NAME} AS level, title AS tg_title, first_seen AS tg_first_seen FROM best JOIN f USING (fid)")
def _(spark, sf):
    f = feed(spark, sf)
    m = matching.best_matches(site(spark, sf), f)
    return m.join(f.select(F.col("idx").alias("ridx"), F.col("title").alias("tg_title"), F.col("first_seen").alias("tg_first_seen")), "ridx").select(
        F.col("lidx").alias("card_id"), "level", "tg_title", "tg_first_seen")


_AUDIT = f"""SELECT p.sid AS card_id, {_NAME.replace('lv', 'p.lv')} AS level, coalesce(p.fid = b.fid, false) AS is_best, CASE WHEN p.lv > 0 THEN 'low+high' ELSE 'high_only' END AS counted_in, status AS site_status,
  f.title AS tg_title, first_seen AS tg_first_seen, array_to_string(channels, '; ') AS tg_channels, s.tk = f.tk AS title_equal, {'round_even(CAST(len(list_intersect(s.tk, f.tk)) AS DOUBLE) / len(list_distinct(list_concat(s.tk, f.tk))), 2)'} AS title_jaccard,
  CAST(abs(datediff('day', CAST(first_seen AS DATE), day)) AS INTEGER) AS date_gap_days,
  CASE WHEN p.lv = 3 THEN 1.0 ELSE round_even(0.6 * round_even(CAST(len(list_intersect(s.tk, f.tk)) AS DOUBLE) / len(list_distinct(list_concat(s.tk, f.tk))), 2) + CASE WHEN p.lv > 0 THEN 0.4 ELSE 0 END, 2) END::DOUBLE AS score
FROM prs p JOIN best b USING (sid) JOIN s USING (sid) JOIN f ON p.fid = f.fid"""


@query("j11_match_audit", ctes(*_pairs()) + _AUDIT)
def _(spark, sf):
    a = matching.audit_pairs(site(spark, sf), feed(spark, sf, "channels"))
    return a.select(F.col("lidx").alias("card_id"), "level", "is_best", "counted_in", "site_status", "tg_title", "tg_first_seen", "tg_channels", "title_equal",
                    "title_jaccard", "date_gap_days", "score")


@query("o2_audit_places", ctes(*_pairs(), ("audit", _AUDIT)) + """SELECT card_id, level, is_best, score, rank() OVER (
  ORDER BY CASE level WHEN 'url' THEN 3 WHEN 'exact' THEN 2 WHEN 'fuzzy' THEN 1 ELSE 0 END DESC, is_best DESC, score) AS place FROM audit""")
def _(spark, sf):
    a = matching.audit_pairs(site(spark, sf), feed(spark, sf, "channels")).select(F.col("lidx").alias("card_id"), "level", "is_best", "score")
    return matching.audit_places(a).select("card_id", "level", "is_best", "score", "place")


@query("z1_x27_company_similarity")
def _(spark, sf):
    return matching.audit_companies(site(spark, sf), feed(spark, sf))


def _cov(group):
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    lo, hi = "count(*) FILTER (lv > 0)", "count(lv)"
    rng = lambda a, b: f"CASE WHEN {a} = {b} THEN printf('%.1f', {a}) ELSE printf('%.1f', {a}) || '–' || printf('%.1f', {b}) END"
    return (f"SELECT {g}n, low, high, {rng(r1('100.0 * low / n'), r1('100.0 * high / n'))} AS coverage, {rng(r1('100.0 - 100.0 * high / n'), r1('100.0 - 100.0 * low / n'))} AS loss, n < 30 AS small_sample "
            f"FROM (SELECT {g}count(*) AS n, {lo} AS low, {hi} AS high FROM base LEFT JOIN best USING (sid) {gb})")


@query("a8_coverage_bounds", ctes(*_pairs(), ("base", "SELECT sid, unnest(CASE WHEN status IN ('shown', 'applied') THEN ['strict', 'wide'] WHEN status = 'personal_reject' THEN ['wide'] ELSE [] END) AS base FROM s")) + _cov("base"))
def _(spark, sf):
    s = site(spark, sf)
    bases = F.array_compact(F.array(F.when(F.col("status").isin(*funnel.STRICT), "strict"), F.when(F.col("status").isin(*funnel.WIDE), "wide")))
    return matching.coverage(s.withColumn("base", F.explode(bases)), matching.best_matches(s, feed(spark, sf)), [F.col("base")])


_DIR = r"CASE WHEN regexp_matches(lower(title), 'analyst|sql|tableau') THEN 'analytics' WHEN regexp_matches(lower(title), 'test') THEN 'qa' WHEN regexp_matches(lower(title), 'developer|engineer') THEN 'dev' ELSE 'other' END"


@query("a9_loss_by_direction", ctes(*_pairs(), ("base", f"SELECT sid, {_DIR} AS direction FROM s WHERE status IN ('shown', 'applied')")) + _cov("direction"))
def _(spark, sf):
    s = site(spark, sf)
    base = s.where(F.col("status").isin(*funnel.STRICT))
    return matching.coverage(base, matching.best_matches(base, feed(spark, sf)), [text.guess_direction(F.col("title")).alias("direction")])


@query("a10_x18_skill_demand", ctes(*uniques(), ("e", "SELECT gpos, cstart, list_distinct(list_transform(skills, lambda s: CASE lower(s) WHEN 'postgres' THEN 'postgresql' WHEN 'powerbi' THEN 'power bi' WHEN 'ms excel' THEN 'excel' ELSE lower(s) END)) AS sk FROM uniq "
                                             "WHERE is_it AND direction = 'analytics' AND level IN ('intern', 'junior', 'unspecified')")) + f"""SELECT skill, {pct('c', 'n')} AS share_pct, n AS n_with_skills,
  CASE WHEN skill IN ('sql', 'postgresql', 'excel') THEN 'мій' WHEN skill = 'power bi' THEN 'вчу' ELSE 'прогалина' END AS state FROM (
  SELECT skill, count(*) AS c, (SELECT count(*) FROM e WHERE len(sk) > 0) AS n, min((gpos, cstart)) AS f FROM (SELECT gpos, cstart, unnest(sk) AS skill FROM e) GROUP BY skill ORDER BY c DESC, f, skill LIMIT 30)""")
def _(spark, sf):
    u = postings(spark, sf, skills=True, columns=("is_it", "direction", "level"))
    return matching.skill_demand(cut_lineage(u.where(F.col("is_it") & (F.col("direction") == "analytics") & F.col("level").isin("intern", "junior", "unspecified")).select("ord", "skills")))


@query("j9_posting_details", ctes(*uniques(False), ("det", """SELECT gpos, cstart, min(m.experience_years_min) AS experience, arg_min((m.salary_min, m.salary_max, m.salary_currency), (m.post_id, m.vacancy_idx, m.part_id, m.supp_id)) FILTER (m.salary_min IS NOT NULL OR m.salary_max IS NOT NULL) AS pay
  FROM uniq u JOIN ident m ON u.k_title = m.k_title AND u.k_company = m.k_company AND strftime(m.ts, '%Y-%m-%d') BETWEEN u.first_seen AND u.last_seen GROUP BY ALL""")) +
       "SELECT title, company, first_seen, work_format, link, experience, pay[1] AS salary_min, pay[2] AS salary_max, pay[3] AS salary_currency FROM uniq LEFT JOIN det USING (gpos, cstart)")
def _(spark, sf):
    ident = cut_lineage(dedup.impute_company(mentions(spark, sf, "ts", "experience_years_min", "salary_min", "salary_max", "salary_currency", "salary_period"), IMPUTE_DAYS))
    d = matching.posting_details(ident, cut_lineage(dedup.unique_postings(ident, GAP_DAYS, skills=False)))
    return d.select("title", "company", "first_seen", "work_format", "link", "experience", "salary_min", "salary_max", "salary_currency")


@query("a14_two_source_months", ctes(*uniques(), "cards", LOGGED,
    ("feed", "SELECT substr(first_seen, 1, 7) AS month, count(*) FILTER (is_it AND direction = 'analytics') AS tg_analytics, count(*) FILTER (is_it AND direction = 'analytics' AND level IN ('intern', 'junior', 'unspecified')) AS tg_analytics_junior_or_unspecified FROM uniq GROUP BY ALL"),
    ("site", f"""SELECT strftime(run_date, '%Y-%m') AS month, count(*) FILTER (d = 'analytics' AND status <> 'personal_reject') AS repo_analytics_shown_applied, count(*) FILTER (d = 'analytics') AS repo_analytics_wide, count(*) AS repo_all_wide
    FROM (SELECT *, {STATUS} AS status, {_DIR} AS d FROM logged) WHERE status IN ('shown', 'applied', 'personal_reject') GROUP BY ALL"""),
    ("ends", "SELECT min(month) AS a, max(month) AS b FROM (SELECT month FROM feed UNION ALL SELECT month FROM site)"),
    ("months", "SELECT strftime(unnest(generate_series(CAST(a || '-01' AS DATE), CAST(b || '-01' AS DATE), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM ends"))
  + """SELECT month, coalesce(tg_analytics, 0) AS tg_analytics, coalesce(tg_analytics_junior_or_unspecified, 0) AS tg_analytics_junior_or_unspecified, repo_analytics_shown_applied, repo_analytics_wide, repo_all_wide
  FROM months LEFT JOIN feed USING (month) LEFT JOIN site USING (month)""")
def _(spark, sf):
    s = site(spark, sf).withColumn("direction", text.guess_direction(F.col("title")))
    return market.two_source_months(postings(spark, sf, columns=("first_seen", "level")), s)


_PRECISION = """SELECT level, n_checked, n_correct, round_even(100.0::DOUBLE * n_correct / n_checked, 1) AS precision_pct,
  round_even(100 * greatest(0.0, (p + 3.8416 / (2 * n_checked)) / d - h), 1) AS ci95_low_pct, round_even(100 * least(1.0, (p + 3.8416 / (2 * n_checked)) / d + h), 1) AS ci95_high_pct FROM (
  SELECT *, CAST(1.96 AS DOUBLE) * sqrt(p * (1 - p) / n_checked + 3.8416 / (4.0 * n_checked * n_checked)) / d AS h FROM (SELECT *, CAST(n_correct AS DOUBLE) / n_checked AS p, CAST(1 + 3.8416 / n_checked AS DOUBLE) AS d FROM (
    SELECT level, count(*) AS n_checked, count(*) FILTER (ok) AS n_correct FROM (SELECT unnest(CASE WHEN lv <> 'title_only' THEN [lv, 'low+high (url/exact/fuzzy)'] ELSE [lv] END) AS level, passes_criteria AS ok FROM (
      SELECT * FROM checked)) GROUP BY ALL)))"""


@query("a23_match_precision", ctes("evaluations", ("checked", "SELECT *, CASE card_id % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'exact' WHEN 2 THEN 'fuzzy' ELSE 'title_only' END AS lv FROM evaluations WHERE NOT near_miss")) + _PRECISION)
def _(spark, sf):
    """The verdicts are those of the evaluations: a level per card, best pairs where it is no near miss."""
    lv = F.element_at(F.array(*[F.lit(x) for x in ("url", "exact", "fuzzy", "title_only")]), (F.col("card_id") % 4 + 1).cast("int"))
    d = view(spark, sf, "evaluations").select(lv.alias("level"), (~F.col("near_miss")).alias("is_best"), F.when(F.col("passes_criteria"), "y").otherwise(" N ").alias("verdict"))
    return matching.match_precision(d)


@query("a23_audited_precision", ctes(*_pairs(), ("audit", _AUDIT), ("checked", "SELECT level AS lv, card_id % 5 <> 0 AS passes_criteria FROM audit WHERE is_best AND card_id % 7 <> 0")) + _PRECISION)
def _(spark, sf):
    """Levels and best pairs of the audit itself; a verdict stands for the one a reader would enter, some pairs have none."""
    v = F.when(F.col("lidx") % 7 == 0, "").when(F.col("lidx") % 5 == 0, " N ").otherwise("y")
    return matching.match_precision(matching.audit_pairs(site(spark, sf), feed(spark, sf, "channels"), best_only=True).withColumn("verdict", v))


@query("j17_daily_agreement", ctes("cards", "evaluations", ("x", """SELECT coalesce(a.url, b.url) AS url, a.r AS reason_a, b.r AS reason_b FROM
  (SELECT url, run_date AS day, min(coalesce(reject_code, 'ok')) AS r FROM cards JOIN evaluations USING (card_id) WHERE url IS NOT NULL AND passes_criteria GROUP BY ALL) a FULL JOIN
  (SELECT url, run_date AS day, min(CASE WHEN mark = 'F' THEN 'роль' WHEN mark = 'O' THEN 'досвід' ELSE 'ok' END) AS r FROM cards WHERE url IS NOT NULL AND price < 400000 GROUP BY ALL) b ON a.url = b.url AND a.day = b.day""")) +
       "SELECT reason_a, reason_b, count(*) AS n, coalesce(reason_a = reason_b, false) AS same FROM x GROUP BY ALL")
def _(spark, sf):
    c = view(spark, sf, "cards").where("url IS NOT NULL").withColumn("day", F.col("run_date"))
    a = c.join(view(spark, sf, "evaluations").where("passes_criteria"), "card_id").withColumn("reason", F.coalesce("reject_code", F.lit("ok")))
    b = c.where("price < 400000").withColumn("reason", F.when(F.col("mark") == "F", "роль").when(F.col("mark") == "O", "досвід").otherwise("ok"))
    return matching.daily_agreement(a, b)


@query("u2_url_overlap", ctes("cards", ("x", "SELECT coalesce(a.day, b.day) AS day, a.url AS l, b.url AS r FROM (SELECT DISTINCT run_date AS day, url FROM cards WHERE url IS NOT NULL AND mark <> 'F') a FULL JOIN (SELECT DISTINCT run_date AS day, url FROM cards WHERE url IS NOT NULL AND price < 300000) b ON a.day = b.day AND a.url = b.url")) +
       "SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS in_both, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right FROM x GROUP BY ALL")
def _(spark, sf):
    c = view(spark, sf, "cards").withColumn("day", dates.day_text(F.col("run_date")))
    return matching.overlap(c.where("mark <> 'F'"), c.where("price < 300000"), "url", ["day"])


@query("x8_title_jaccard", ctes("cards", ("t", f"SELECT card_id, client_id, {_tok('title')} AS tk FROM cards"), ("w", "SELECT c_custkey AS client_id, string_split('blue bolt widget', ' ') AS wk FROM customer")) +
       "SELECT card_id, round_even(CASE WHEN len(tk) > 0 THEN CAST(len(list_intersect(tk, wk)) AS DOUBLE) / len(list_distinct(list_concat(tk, wk))) ELSE 0 END, 4) AS jaccard FROM t JOIN w USING (client_id)")
def _(spark, sf):
    wanted = F.array(*[F.lit(w) for w in ("blue", "bolt", "widget")])
    c = view(spark, sf, "cards").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("client_id")), "client_id")
    return c.select("card_id", half_even(text.jaccard(text.title_tokens(F.col("title")), wanted), 4).alias("jaccard"))


@query("x17_guessed_directions", f"SELECT {_DIR.replace('title', 'text')} AS direction, count(*) AS n FROM documents GROUP BY ALL".replace("analyst|sql|tableau", r"analyst|\\bbi\\b|\\bdata\\b|sql|tableau|power bi|looker").replace("\\\\b", "\\b").replace("'test'", r"'\bqa\b|test'")
       .replace("developer|engineer", "developer|engineer|backend|frontend").replace(" ELSE 'other'", r" WHEN regexp_matches(lower(text), 'project manager|product manager|\bpm\b|scrum') THEN 'pm' ELSE 'other'"))
def _(spark, sf):
    return table(spark, sf, "documents").groupBy(text.guess_direction(F.col("text")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query("j21_site_postings")
def _(spark, sf):
    """Every card of one client carries the client's url here, so urls tie different companies together."""
    from jobstrata.operators import board
    d = logged(spark, sf).withColumn("status", funnel.log_status(F.col("result"), F.col("code"))).where(F.col("status").isNotNull())
    d = d.withColumn("url", F.when(F.col("url").isNotNull(), F.concat(F.lit("https://site.example/vacancy"), F.col("client_id").cast("string"))))
    u = board.unique_postings(d.withColumn("day", F.col("run_date")), F.col("card_id"))
    return u.select("title", "company", "url", dates.day_text(F.col("first_day")).alias("first_day"), dates.day_text(F.col("day")).alias("day"), "status", "rows", "superseded")
