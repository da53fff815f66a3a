"""Queries: unique postings and the market tables over them."""
from __future__ import annotations

from pyspark.sql import functions as F

from jobstrata.functions import dates, text
from jobstrata.functions.text import company_key, norm_company, norm_title
from jobstrata.operators import dedup, market
from jobstrata.plans.bindings import ctes, view
from jobstrata.plans.registry import query

from jobstrata.plans.sqlparts import clustered, identified, iso_week, norm_title as sql_norm_title, over_uniques, pct, r1
from jobstrata.session import cut_lineage

# Many suppliers share a title in these tables, so the imputation window is 3 days; the gap is 30.
IMPUTE_DAYS, GAP_DAYS = 3, 30


def mentions(spark, sf, *columns, made_into=dedup.POSTING_COLUMNS):
    """The mentions with their keys, joined and normalised once: the operators below pass over them several times.

    Only the keys, what postings with the columns `made_into` are made of and the given columns are written."""
    return cut_lineage(dedup.with_keys(view(spark, sf, "mentions")).select("_title", "_stated", "_us", *dedup.mention_columns(made_into), *columns))


def postings(spark, sf, fixed=True, skills=False, columns=dedup.POSTING_COLUMNS):
    """Unique postings with the given columns; skills are carried (and spelled canonically) only where a query needs them.

    Corrections ask for title, direction and whether it is IT, whatever else is wanted."""
    wanted = {*columns, *(("title", "direction", "is_it") if fixed else ())}
    u = dedup.unique_postings(mentions(spark, sf, *(["skills"] if skills else []), made_into=wanted), GAP_DAYS, IMPUTE_DAYS, skills=skills, columns=wanted)
    if not fixed:
        return u
    u = dedup.reclassify(u)
    return dedup.normalize_skills(u, columns=[*wanted, "skills", "ord"]) if skills else u


def joined(col):
    return F.array_join(col, "; ").alias(col)


@query("x1_x2_normal_names", ctes("mentions") + f"SELECT {sql_norm_title('title')} AS title_key, lower(coalesce(company, '')) AS company_norm, count(*) AS n FROM mentions GROUP BY ALL")
def _(spark, sf):
    m = view(spark, sf, "mentions")
    return m.groupBy(norm_title(F.col("title")).alias("title_key"), norm_company(F.col("company")).alias("company_norm")).agg(F.count(F.lit(1)).alias("n"))


@query("j8_w2_company_imputation", ctes(*identified()) + "SELECT post_id, vacancy_idx, part_id, supp_id, k_company AS company_found, company_source FROM ident")
def _(spark, sf):
    d = dedup.impute_company(mentions(spark, sf), IMPUTE_DAYS)
    return d.select("pos.*", F.col("_company").alias("company_found"), "company_source")


@query("w1_gap_clusters", ctes(*clustered()) + "SELECT post_id, vacancy_idx, part_id, supp_id, epoch_us(min(ts) OVER (PARTITION BY k_title, k_company, k_extra, cl)) AS cluster_start FROM clus")
def _(spark, sf):
    d = dedup.assign_clusters(dedup.impute_company(mentions(spark, sf), IMPUTE_DAYS), GAP_DAYS)
    return d.select("pos.*", "cluster_start")


@query("a1_unique_postings", over_uniques(
    "SELECT title, company, company_source, first_seen, last_seen, mentions, array_to_string(channels, '; ') AS channels, first_channel, is_it, direction, level, "
    "work_format, salary_stated, array_to_string(skills, '; ') AS skills, link FROM uniq", fixed=False))
def _(spark, sf):
    return postings(spark, sf, fixed=False, skills=True).select(
        "title", "company", "company_source", "first_seen", "last_seen", "mentions", joined("channels"), "first_channel", "is_it",
        "direction", "level", "work_format", "salary_stated", joined("skills"), "link")


@query("a1_company_sources", over_uniques("SELECT company_source, count(*) AS n FROM uniq GROUP BY ALL", fixed=False))
def _(spark, sf):
    return market.company_sources(postings(spark, sf, fixed=False, columns=("company_source",)))


@query("a2_mode_first_seen", ctes("mentions") + """SELECT channel, arg_min(v, (-n, f)) AS mode FROM (
  SELECT channel, work_format AS v, count(*) AS n, min((ts, post_id, vacancy_idx, part_id, supp_id)) AS f FROM mentions WHERE work_format <> 'unspecified' GROUP BY ALL) GROUP BY channel""")
def _(spark, sf):
    m = view(spark, sf, "mentions")
    return dedup.mode_first_seen(m, ["channel"], F.col("work_format"), F.struct("ts", "pos"))


@query("f11_reclassified", over_uniques("SELECT coalesce(fix, 'none') AS fix, direction, is_it, count(*) AS n FROM uniq GROUP BY ALL"))
def _(spark, sf):
    u = dedup.reclassify(postings(spark, sf, fixed=False, columns=("title", "direction", "is_it")))
    return u.groupBy(F.coalesce("fix", F.lit("none")).alias("fix"), "direction", "is_it").agg(F.count(F.lit(1)).alias("n"))


@query("a29_canonical_skills", over_uniques("SELECT title, company, first_seen, array_to_string(skills, '; ') AS skills, work_format, link FROM uniq"))
def _(spark, sf):
    return postings(spark, sf, skills=True, columns=("title", "company", "first_seen", "work_format", "link")).select("title", "company", "first_seen", joined("skills"), "work_format", "link")


def _weekly(value):
    return over_uniques(
        f"SELECT \"group\", value, {pct('cnt', 'n')} AS share_pct, n, n < 30 AS small_sample FROM (SELECT *, CAST(sum(cnt) OVER (PARTITION BY \"group\") AS BIGINT) AS n FROM ("
        f"SELECT {iso_week('CAST(first_seen AS DATE)')} AS \"group\", {value} AS value, count(*) AS cnt FROM it WHERE date_trunc('week', CAST(first_seen AS DATE)) >= (SELECT min(CAST(first_seen AS DATE)) FROM it) "
        "AND date_trunc('week', CAST(first_seen AS DATE)) + INTERVAL 6 DAY <= (SELECT max(CAST(first_seen AS DATE)) FROM it) GROUP BY ALL))",
        ("it", "SELECT * FROM uniq WHERE is_it"))


for _name, _value in (("a3_f15_weekly_direction", "direction"), ("a3_f15_weekly_level", "level"), ("a3_f15_weekly_format", "work_format")):
    @query(_name, _weekly(_value))
    def _(spark, sf, value=_value):
        it = cut_lineage(postings(spark, sf, columns=("first_seen", value)).where("is_it").select("first_seen", value))
        return market.shares(market.full_weeks(it, "first_seen"), dates.iso_week(F.col("first_seen")), F.col(value))


for _name, _value in (("a3_z3_direction_level_shares", "level"), ("a3_direction_format_shares", "work_format"), ("a3_direction_salary_shares", "salary_stated")):
    @query(_name, over_uniques(
        f"SELECT \"group\", value, {pct('cnt', 'n')} AS share_pct, n, n < 30 AS small_sample FROM (SELECT *, CAST(sum(cnt) OVER (PARTITION BY \"group\") AS BIGINT) AS n FROM ("
        f"SELECT direction AS \"group\", CAST({_value} AS STRING) AS value, count(*) AS cnt FROM uniq WHERE is_it GROUP BY ALL))"))
    def _(spark, sf, value=_value):
        return market.shares(postings(spark, sf, columns=(value,)).where("is_it"), F.col("direction"), F.col(value).cast("string"))


@query("a4_skills_by_direction", over_uniques(f"""SELECT direction, skill, {pct('c', 'n')} AS share_pct, n, n_with_skills, n < 30 AS small_sample FROM (
  SELECT *, row_number() OVER (PARTITION BY direction ORDER BY c DESC, f, skill) AS r FROM (SELECT direction, s AS skill, count(*) AS c, min((gpos, cstart)) AS f FROM (SELECT direction, gpos, cstart, unnest(list_distinct(skills)) AS s FROM uniq WHERE is_it) GROUP BY ALL))
  JOIN (SELECT direction, count(*) AS n, count(*) FILTER (len(skills) > 0) AS n_with_skills FROM uniq WHERE is_it GROUP BY ALL) USING (direction) WHERE r <= 20"""))
def _(spark, sf):
    return market.skills_by_direction(postings(spark, sf, skills=True, columns=("direction", "is_it")).where("is_it"), 20)


@query("a5_channel_scorecard", over_uniques(f"""
SELECT channel, posts, unclassified AS unclassified_posts, {pct('vac', 'done')} AS vacancy_post_share_pct, coalesce(mentions, 0) AS mentions, {pct('coalesce(itm, 0)', 'coalesce(mentions, 0)')} AS it_share_pct,
  coalesce(u, 0) AS unique_it_vacancies, {r1('coalesce(u, 0) / greatest(1, weeks)')} AS unique_it_per_week, CASE WHEN u > 0 THEN round_even(CAST(coalesce(itm, 0) AS DOUBLE) / u, 2) END AS repeat_ratio,
  coalesce(pf, 0) AS published_first, {pct('coalesce(ex, 0)', 'coalesce(u, 0)')} AS exclusive_share_pct, avg_views FROM led LEFT JOIN men USING (channel) LEFT JOIN inch USING (channel) LEFT JOIN fst USING (channel)""",
    "posts", ("led", f"SELECT channel, count(*) AS posts, count(*) FILTER (classified = 'False') AS unclassified, count(*) FILTER (classified <> 'False') AS done, count(*) FILTER (classified <> 'False' AND is_vacancy) AS vac, "
              f"count(DISTINCT {iso_week('ts')}) AS weeks, CAST(round_even(avg(views), 0) AS BIGINT) AS avg_views FROM posts GROUP BY ALL"),
    ("men", "SELECT channel, count(*) AS mentions, count(*) FILTER (is_it) AS itm FROM mentions GROUP BY ALL"),
    ("inch", "SELECT channel, count(*) AS u, count(*) FILTER (single) AS ex FROM (SELECT unnest(channels) AS channel, len(channels) = 1 AS single FROM uniq WHERE is_it) GROUP BY ALL"),
    ("fst", "SELECT first_channel AS channel, count(*) AS pf FROM uniq WHERE is_it GROUP BY ALL")))
def _(spark, sf):
    return market.channel_metrics(view(spark, sf, "posts"), view(spark, sf, "mentions"), postings(spark, sf, columns=("channels", "first_channel")))


_GROUPED = ("grouped", "SELECT uniq.*, CASE WHEN g THEN 'general' ELSE 'junior-only' END AS grp FROM uniq JOIN (SELECT k_title, k_company, k_extra, cl, bool_or(coalesce(nullif(orientation, ''), 'general') = 'general') AS g "
            "FROM (SELECT k_title, k_company, k_extra, cl, unnest(channels) AS handle FROM uniq) LEFT JOIN channels USING (handle) GROUP BY ALL) USING (k_title, k_company, k_extra, cl) WHERE is_it")


@query("a6_j19_control_group", over_uniques(f"""SELECT grp AS "group", count(*) AS n_it_unique, count(*) FILTER (level IN ('intern', 'junior')) AS junior_intern_n,
  {pct("count(*) FILTER (level IN ('intern', 'junior'))", 'count(*)')} AS junior_share_of_all_pct, count(*) FILTER (level <> 'unspecified') AS n_level_stated,
  {pct("count(*) FILTER (level IN ('intern', 'junior'))", "count(*) FILTER (level <> 'unspecified')")} AS junior_share_of_stated_pct, count(*) < 30 AS small_sample FROM grouped GROUP BY grp""", "channels", _GROUPED))
def _(spark, sf):
    return market.control_group(postings(spark, sf, columns=("channels", "level")), market.load_channels(view(spark, sf, "channels")))


@query("a6_control_levels", over_uniques(
    f"SELECT \"group\", value, {pct('cnt', 'n')} AS share_pct, n, n < 30 AS small_sample FROM (SELECT *, CAST(sum(cnt) OVER (PARTITION BY \"group\") AS BIGINT) AS n FROM ("
    "SELECT grp AS \"group\", level AS value, count(*) AS cnt FROM grouped GROUP BY ALL))", "channels", _GROUPED))
def _(spark, sf):
    it = market.orientation_group(postings(spark, sf, columns=("channels", "level")).where("is_it"), market.load_channels(view(spark, sf, "channels")))
    return market.shares(it, F.col("group"), F.col("level"))


_MONTH = "substr(first_seen, 1, 7)"


@query("a11_direction_by_month", over_uniques(f"""SELECT coalesce(direction, 'total') AS direction, coalesce(month, 'total') AS month, n, j AS junior_intern FROM (
  SELECT direction, {_MONTH} AS month, count(*) AS n, count(*) FILTER (level IN ('intern', 'junior')) AS j FROM uniq WHERE is_it AND direction <> 'non-it' GROUP BY CUBE (direction, {_MONTH}))"""))
def _(spark, sf):
    return market.direction_by_month(postings(spark, sf, columns=("first_seen", "level")))


_LV = ("intern", "junior", "middle", "senior", "lead", "unspecified")


@query("a12_direction_level_by_month", over_uniques(
    f"SELECT month, coalesce(direction, 'total') AS direction, {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in (*_LV, 'total'))} FROM filled GROUP BY GROUPING SETS ((month, direction), (month))",
    ("grid", f"SELECT DISTINCT {_MONTH} AS month, unnest(['analytics', 'ai-ml', 'devops', 'qa', 'pm', 'dev', 'design', 'marketing', 'other-it']) AS direction FROM uniq"),
    ("cnt", f"SELECT {_MONTH} AS month, direction, {', '.join(f'count(*) FILTER (level = {chr(39)}{x}{chr(39)}) AS {x}' for x in _LV)}, count(*) AS total FROM uniq WHERE is_it GROUP BY ALL"),
    ("filled", f"SELECT month, direction, {', '.join(f'coalesce({x}, 0) AS {x}' for x in (*_LV, 'total'))} FROM grid LEFT JOIN cnt USING (month, direction)")))
def _(spark, sf):
    return market.direction_level_by_month(postings(spark, sf, columns=("first_seen", "level")))


@query("a13_level_buckets", over_uniques(f"""SELECT {_MONTH} AS month, count(*) FILTER (m) AS total, count(*) FILTER (m AND level IN ('intern', 'junior')) AS junior_intern,
  count(*) FILTER (m AND level = 'unspecified') AS unspecified, count(*) FILTER (m AND level IN ('middle', 'senior', 'lead')) AS middle_up FROM (SELECT *, is_it AND direction = 'analytics' AS m FROM uniq) GROUP BY ALL"""))
def _(spark, sf):
    return market.level_buckets(postings(spark, sf, columns=("first_seen", "level")))


@query("w15_first_channel", over_uniques("SELECT first_channel, count(*) AS published_first, min(first_seen) AS earliest FROM uniq GROUP BY ALL", fixed=False))
def _(spark, sf):
    return postings(spark, sf, fixed=False, columns=("first_channel", "first_seen")).groupBy("first_channel").agg(F.count(F.lit(1)).alias("published_first"), F.min("first_seen").alias("earliest"))


@query("s14_channels", ctes("channels") + "SELECT handle, panel, coalesce(max_pages, 40) AS max_pages, coalesce(nullif(orientation, ''), 'general') AS orientation FROM channels")
def _(spark, sf):
    return market.load_channels(view(spark, sf, "channels"))


@query("x3_x4_matching_keys", ctes("cards") + r"""SELECT card_id, array_to_string(list_sort(list_distinct(list_filter(string_split(t, ' '), lambda x: x <> ''))), ' ') AS tokens,
  regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(lower(company), 'т', 't'), 'о', 'o'), 'в', 'v'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\b(tov|llc)\b', ' ', 'g'), '\s+', '', 'g') AS company_key
FROM (SELECT *, """ + sql_norm_title("title") + " AS t FROM cards)")
def _(spark, sf):
    c = view(spark, sf, "cards")
    return c.select("card_id", F.array_join(text.title_tokens(F.col("title")), " ").alias("tokens"), company_key(F.col("company")).alias("company_key"))
