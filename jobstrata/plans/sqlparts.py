"""SQL building blocks of the oracle queries, written from the definitions (plain windows, no bucketing)."""
from __future__ import annotations

from jobstrata.functions.text import LEVEL_WORDS
from jobstrata.plans.bindings import ctes

DAY_US = 86_400_000_000
ORD = "(ts, post_id, vacancy_idx, part_id, supp_id)"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def norm_title(e: str) -> str:
    cleaned = rf"trim(regexp_replace(regexp_replace(lower({e}), '\(.*?\)', ' ', 'g'), '[^\p{{L}}\p{{N}}_+#.]+', ' ', 'g'))"
    return f"array_to_string(list_filter(string_split({cleaned}, ' '), lambda x: x NOT IN ({quoted(LEVEL_WORDS)})), ' ')"


def norm_company(e: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({e}, '')), '\s+', ' ', 'g'))"


def r1(e: str) -> str:
    return f"round_even(CAST({e} AS DOUBLE), 1)"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round_even(CAST(100.0 * {part} AS DOUBLE) / {whole}, 1) END"


def iso_week(d: str) -> str:
    return f"printf('%d-W%02d', isoyear({d}), weekofyear({d}))"


def identified(impute_days: int = 3) -> list:
    return ["mentions",
            ("keyed", f"SELECT *, {norm_title('title')} AS k_title, nullif({norm_company('company')}, '') AS k_stated FROM mentions"),
            ("near", "SELECT *, min(k_stated) OVER w AS lo, max(k_stated) OVER w AS hi FROM keyed WINDOW w AS (PARTITION BY k_title ORDER BY ts "
                     f"RANGE BETWEEN INTERVAL {impute_days} DAY PRECEDING AND INTERVAL {impute_days} DAY FOLLOWING)"),
            ("sourced", "SELECT *, CASE WHEN k_stated IS NOT NULL THEN k_stated WHEN lo = hi THEN lo ELSE '' END AS k_company, "
                        "CASE WHEN k_stated IS NOT NULL THEN 'stated' WHEN lo = hi THEN 'imputed' ELSE 'unknown' END AS company_source FROM near"),
            ("ident", "SELECT *, CASE WHEN k_company = '' THEN work_format ELSE '' END AS k_extra FROM sourced")]


def clustered(impute_days: int = 3, gap_days: int = 30) -> list:
    key = "k_title, k_company, k_extra"
    return [*identified(impute_days),
            ("flagged", f"SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {key} ORDER BY {ORD[1:-1]}) <= {gap_days * DAY_US} THEN 0 ELSE 1 END AS opens FROM ident"),
            ("clus", f"SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY {ORD[1:-1]} ROWS UNBOUNDED PRECEDING) AS cl, "
                     f"min((post_id, vacancy_idx, part_id, supp_id)) OVER (PARTITION BY {key}) AS gpos FROM flagged")]


def _mode(col: str, skip: bool) -> tuple[str, str]:
    where = f"WHERE {col} <> 'unspecified'" if skip else ""
    return (f"m_{col}", f"SELECT k_title, k_company, k_extra, cl, arg_min(v, (-n, f)) AS v FROM (SELECT k_title, k_company, k_extra, cl, {col} AS v, count(*) AS n, "
                        f"min({ORD}) AS f FROM clus {where} GROUP BY ALL) GROUP BY ALL")


def uniques(fixed: bool = True) -> list:
    """…, uniq: one row per posting. `fixed` adds reclassification and canonical skills."""
    join = " ".join(f"LEFT JOIN m_{c} USING (k_title, k_company, k_extra, cl)" for c in ("direction", "level", "work_format", "is_it"))
    parts = [*clustered(), *[_mode(c, c != "is_it") for c in ("direction", "level", "work_format", "is_it")],
             ("spelled", f"SELECT k_title, k_company, k_extra, cl, trim(s) AS skill, ({ORD}, i) AS spos FROM (SELECT *, unnest(string_split(skills, ';')) AS s, "
                         "generate_subscripts(string_split(skills, ';'), 1) AS i FROM clus) WHERE trim(s) <> ''"),
             ("m_skills", "SELECT k_title, k_company, k_extra, cl, list(skill ORDER BY (-n, f)) AS skills FROM (SELECT k_title, k_company, k_extra, cl, skill, count(*) AS n, "
                          "min(spos) AS f FROM spelled GROUP BY ALL) GROUP BY ALL"),
             ("agg", f"SELECT k_title, k_company, k_extra, cl, arg_min(title, {ORD}) AS title, k_company AS company, "
                     f"CASE WHEN bool_or(company_source = 'stated') THEN 'stated' ELSE arg_min(company_source, {ORD}) END AS company_source, "
                     "strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen, count(*) AS mentions, "
                     f"list_sort(list(DISTINCT channel)) AS channels, arg_min(channel, {ORD}) AS first_channel, bool_or(salary_stated) AS salary_stated, "
                     f"coalesce(arg_min(link, {ORD}) FILTER (link IS NOT NULL AND link <> ''), '') AS link, min(gpos) AS gpos, min(ts) AS cstart FROM clus GROUP BY ALL"),
             ("uniq0", f"SELECT agg.*, m_is_it.v AS is_it0, coalesce(m_direction.v, 'unspecified') AS direction0, coalesce(m_level.v, 'unspecified') AS level, "
                       f"coalesce(m_work_format.v, 'unspecified') AS work_format, coalesce(m_skills.skills, []) AS skills0 FROM agg {join} "
                       "LEFT JOIN m_skills USING (k_title, k_company, k_extra, cl)")]
    if not fixed:
        return [*parts, ("uniq", "SELECT *, is_it0 AS is_it, direction0 AS direction, skills0 AS skills FROM uniq0")]
    creative = ("direction0 = 'design' AND regexp_matches(lower(title), 'graphic|motion|smm|art ?director') AND NOT regexp_matches(lower(title), 'ui|ux|product designer|web designer|game designer')")
    nondata = "direction0 = 'analytics' AND regexp_matches(lower(title), 'meal|osint')"
    return [*parts,
            ("fixed", f"SELECT *, CASE WHEN {creative} THEN 'creative-design→marketing' WHEN {nondata} THEN 'non-data-analyst→non-it' "
                      "WHEN direction0 IN ('marketing', 'non-it') AND is_it0 THEN 'marketing/non-it is_it→False' END AS fix FROM uniq0"),
            ("forms", "SELECT lower(s) AS lk, arg_min(s, (-n, f)) AS canon FROM (SELECT s, count(*) AS n, min((gpos, cstart, i)) AS f FROM (SELECT gpos, cstart, unnest(skills0) AS s, "
                      "generate_subscripts(skills0, 1) AS i FROM uniq0) GROUP BY s) GROUP BY lower(s)"),
            ("canon", "SELECT k_title, k_company, k_extra, cl, list(c ORDER BY i) AS skills FROM (SELECT k_title, k_company, k_extra, cl, canon AS c, min(i) AS i FROM (SELECT k_title, k_company, k_extra, cl, "
                      "unnest(skills0) AS s, generate_subscripts(skills0, 1) AS i FROM uniq0) JOIN forms ON lower(s) = lk GROUP BY ALL) GROUP BY ALL"),
            ("uniq", "SELECT fixed.*, CASE fix WHEN 'creative-design→marketing' THEN 'marketing' WHEN 'non-data-analyst→non-it' THEN 'non-it' ELSE direction0 END AS direction, "
                     "is_it0 AND fix IS NULL AS is_it, coalesce(canon.skills, []) AS skills FROM fixed LEFT JOIN canon USING (k_title, k_company, k_extra, cl)")]


def over_uniques(select: str, *extra: tuple[str, str] | str, fixed: bool = True) -> str:
    return ctes(*uniques(fixed), *extra) + select


