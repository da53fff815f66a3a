"""Unique postings: golden cases and equality with a row-by-row pass on random mentions."""
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from jobstrata.operators import board, dedup, market

SCHEMA = ("title string, company string, ts timestamp_ntz, channel string, is_it boolean, direction string, level string, work_format string, "
          "salary_stated boolean, skills string, link string, n long")


def mention(n, title, day, company=None, channel="a", **kw):
    row = dict(title=title, company=company, ts=datetime(2026, 8, 1) + timedelta(days=day), channel=channel, is_it=True, direction="analytics", level="junior",
               work_format="remote", salary_stated=False, skills="SQL", link=None, n=n)
    return tuple({**row, **kw}[c.split()[0]] for c in SCHEMA.split(", "))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.struct("n"))


def test_three_mentions_two_channels_are_one_posting(spark):
    d = frame(spark, [mention(0, "Junior Data Analyst", 0, "Acme"), mention(1, "Data Analyst (remote)", 3, "ACME", "b", direction="dev"), mention(2, "data analyst", 5, None)])
    u = dedup.unique_postings(d).collect()
    assert len(u) == 1 and u[0]["mentions"] == 3 and u[0]["channels"] == ["a", "b"] and u[0]["direction"] == "analytics" and u[0]["company_source"] == "stated"


def test_fifty_day_gap_makes_two(spark):
    d = frame(spark, [mention(0, "QA", 0, "Acme"), mention(1, "QA", 50, "Acme")])
    assert dedup.unique_postings(d).count() == 2


def test_gap_is_inclusive(spark):
    d = frame(spark, [mention(0, "QA", 0, "Acme"), mention(1, "QA", 30, "Acme"), mention(2, "QA", 61, "Acme")])
    assert sorted(r["mentions"] for r in dedup.unique_postings(d).collect()) == [1, 2]


def test_two_employers_nearby_leave_company_unknown(spark):
    one = frame(spark, [mention(0, "QA", 0, "Acme"), mention(1, "QA", 30)])
    two = frame(spark, [mention(0, "QA", 0, "Acme"), mention(1, "QA", 2, "Beta"), mention(2, "QA", 1)])
    far = frame(spark, [mention(0, "QA", 0, "Acme"), mention(1, "QA", 31)])
    source = lambda d: {r["n"]: r["company_source"] for r in dedup.impute_company(d).collect()}
    assert source(one)[1] == "imputed" and source(two)[2] == "unknown" and source(far)[1] == "unknown"


def test_reclassify(spark):
    d = spark.createDataFrame([("Graphic Designer", "design", True), ("UI motion designer", "design", True), ("OSINT analyst", "analytics", True), ("SMM", "marketing", True), ("Dev", "dev", True)], "title string, direction string, is_it boolean")
    got = {r["title"]: (r["direction"], r["is_it"]) for r in dedup.reclassify(d).collect()}
    assert got == {"Graphic Designer": ("marketing", False), "UI motion designer": ("design", True), "OSINT analyst": ("non-it", False), "SMM": ("marketing", False), "Dev": ("dev", True)}


def brute_force(rows, gap, window):
    """The definition, one row at a time."""
    norm = lambda t: t.lower()
    out = {}
    for r in rows:
        if r["company"]:
            r["c"] = r["company"].lower()
        else:
            near = {o["company"].lower() for o in rows if o["company"] and norm(o["title"]) == norm(r["title"]) and abs(o["ts"] - r["ts"]) <= window}
            r["c"] = next(iter(near)) if len(near) == 1 else ""
        out.setdefault((norm(r["title"]), r["c"], "" if r["c"] else r["work_format"]), []).append(r)
    found = []
    for (title, company, extra), group in out.items():
        group.sort(key=lambda r: (r["ts"], r["n"]))
        cluster = [group[0]]
        for r in group[1:]:
            if r["ts"] - cluster[-1]["ts"] <= gap:
                cluster.append(r)
            else:
                found.append((title, company, extra, cluster))
                cluster = [r]
        found.append((title, company, extra, cluster))

    def mode(values):
        values = [v for v in values if v != "unspecified"]
        return max(dict.fromkeys(values), key=values.count) if values else "unspecified"

    return sorted((t, c, len(cl), str(cl[0]["ts"])[:10], str(cl[-1]["ts"])[:10], mode([x["level"] for x in cl]), mode([x["direction"] for x in cl])) for t, c, _e, cl in found)


def test_random_mentions_equal_the_definition(spark):
    rnd = random.Random(7)
    rows = [mention(n, rnd.choice(["qa", "dev", "pm"]), 0, rnd.choice([None, None, "Acme", "Beta", "Gamma"]), level=rnd.choice(["junior", "middle", "unspecified"]),
                    direction=rnd.choice(["qa", "dev"]), work_format=rnd.choice(["remote", "office"]), ts=datetime(2026, 1, 1) + timedelta(hours=6 * rnd.randrange(0, 1400))) for n in range(400)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    want = brute_force([dict(zip(names, r)) for r in rows], timedelta(days=9), timedelta(days=4))
    for skills in (False, True):
        got = dedup.unique_postings(frame(spark, rows), 9, 4, skills=skills).collect()
        assert sorted((r["_title"], r["company"], r["mentions"], r["first_seen"], r["last_seen"], r["level"], r["direction"]) for r in got) == want


def test_skills_by_frequency_and_canonical_spelling(spark):
    d = frame(spark, [mention(0, "QA", 0, "A", skills="git; SQL"), mention(1, "QA", 1, "A", skills="Git; SQL"), mention(2, "Dev", 0, "B", skills="Git; sql; Git")])
    u = {r["_title"]: r["skills"] for r in dedup.normalize_skills(dedup.unique_postings(d)).collect()}
    assert u == {"qa": ["SQL", "Git"], "dev": ["Git", "SQL"]}


def test_shares_and_full_weeks(spark):
    d = spark.createDataFrame([("g", "x"), ("g", "x"), ("g", "y")], "g string, v string")
    got = {r["value"]: (r["share_pct"], r["n"], r["small_sample"]) for r in market.shares(d, F.col("g"), F.col("v")).collect()}
    assert got == {"x": (66.7, 3, True), "y": (33.3, 3, True)}
    days = spark.createDataFrame([("2026-08-05",), ("2026-08-10",), ("2026-08-16",), ("2026-08-18",)], "d string")
    assert sorted(r["d"] for r in market.full_weeks(days, "d").collect()) == ["2026-08-10", "2026-08-16"]


def board_brute_force(rows, window):
    """Row by row in date order, with the two lookup tables of the definition."""
    groups, by_url, all_groups = {}, {}, []
    for r in sorted(rows, key=lambda r: (r["day"], r["n"])):
        g = by_url.get(r["url"]) if r["url"] else None
        if g is None:
            g = groups.get((r["title"], r["company"]))
            if g is not None and (r["day"] - g["last"]).days > window:
                g = None
        if g is None:
            g = {"title": r["title"], "company": r["company"], "url": r["url"], "first": r["day"], "last": r["day"], "rank": r["rank"], "rows": 1}
            groups[(r["title"], r["company"])] = g
            all_groups.append(g)
            if r["url"]:
                by_url[r["url"]] = g
        else:
            g["last"], g["rank"], g["rows"] = r["day"], max(g["rank"], r["rank"]), g["rows"] + 1
    current = {id(g) for g in groups.values()}
    return sorted((g["title"], g["company"], g["url"], str(g["first"]), str(g["last"]), g["rank"], g["rows"], id(g) not in current) for g in all_groups)


def test_site_postings_equal_the_ordered_replay(spark):
    for seed in (1, 2):
        rnd = random.Random(seed)
        rows = [{"n": n, "title": rnd.choice(["qa", "dev"]), "company": rnd.choice(["acme", "beta"]), "url": rnd.choice(["", "x/1", "x/2", "x/3", "x/4", "x/5", "x/6"]),
                 "day": (datetime(2026, 1, 1) + timedelta(days=rnd.randrange(0, 400))).date(), "rank": rnd.randrange(0, 4)} for n in range(90)]
        names = sorted(board.RANK, key=board.RANK.get)
        d = spark.createDataFrame([(r["n"], r["title"], r["company"], r["url"], r["day"], names[r["rank"]]) for r in rows], "n long, title string, company string, url string, day date, status string")
        got = board.unique_postings(d, F.col("n"), 10).collect()
        assert sorted((r["title"], r["company"], r["url"], str(r["first_day"]), str(r["day"]), board.RANK[r["status"]], r["rows"], r["superseded"]) for r in got) == board_brute_force(rows, 10)


def test_one_unknown_company_title_of_a_third_of_all_mentions(spark):
    """The hot identity is reduced to its buckets and attributes before any window or list sees it."""
    n = 90_000
    hot = F.col("id") % 3 == 0
    d = spark.range(n).select(
        F.when(hot, "QA").otherwise(F.concat(F.lit("Role "), (F.col("id") % 5000).cast("string"))).alias("title"), F.when(hot, None).otherwise(F.lit("Acme")).alias("company"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 900 * 86_400).alias("ts"), F.lit("ch").alias("channel"), F.lit(True).alias("is_it"), F.lit("qa").alias("direction"),
        F.when(F.col("id") % 2 == 0, "junior").otherwise("middle").alias("level"), F.lit("remote").alias("work_format"), F.lit(False).alias("salary_stated"),
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string"), F.lit("; s"), (F.col("id") % 11).cast("string")).alias("skills"), F.lit("").alias("link"), F.struct("id").alias("pos"))
    u = dedup.unique_postings(d, 30, 30, skills=True).where("_title = 'qa'").collect()
    assert [(r["mentions"], r["level"], len(r["skills"]), r["company"]) for r in u] == [(n // 3, "junior", 11, "")]
    months = dedup.unique_postings(d.where(F.dayofmonth("ts") == 1), 10, 10, skills=False).where("_title = 'qa'")
    assert months.count() >= 9


def test_months_of_either_source_and_between_stand_side_by_side(spark):
    feed = spark.createDataFrame([("2026-02-03", True, "analytics", "junior"), ("2026-02-04", True, "dev", "junior")], "first_seen string, is_it boolean, direction string, level string")
    site = spark.createDataFrame([("2026-04-01", "analytics", "shown"), ("2026-02-01", "analytics", "personal_reject"), ("2026-01-01", "dev", "other")], "day string, direction string, status string")
    got = [tuple(r) for r in market.two_source_months(feed, site).orderBy("month").collect()]
    assert got == [("2026-02", 1, 1, 0, 1, 1), ("2026-03", 0, 0, None, None, None), ("2026-04", 0, 0, 1, 1, 1)]
    assert [r["month"] for r in market.two_source_months(feed, site, start="2026-01", end="2026-02").orderBy("month").collect()] == ["2026-01", "2026-02"]
    assert market.two_source_months(feed.limit(0), site.limit(0)).count() == 0


def test_a_chain_of_dependent_openings_looks_only_at_its_own_keys(spark):
    day = lambda n: (datetime(2026, 1, 1) + timedelta(days=n)).date()
    rows = [(f"role {'abcdefghijklm'[k]}", "acme", f"x/{k - 1 + i}", day(2 * k + i)) for k in range(13) for i in (0, 1) if k or i]  # each row but the last of its role is bound only if the role before opened by its last
    rows += [(f"other {a}{b}", "beta", f"y/{a}{b}", day(d)) for a in "abcdefghijklmnopqrst" for b in "abcdefghij" for d in (0, 5)]
    rows = [{"n": n, "title": t, "company": c, "url": u, "day": d, "rank": n % 4} for n, (t, c, u, d) in enumerate(rows)]
    names = sorted(board.RANK, key=board.RANK.get)
    d = spark.createDataFrame([(r["n"], r["title"], r["company"], r["url"], r["day"], names[r["rank"]]) for r in rows], "n long, title string, company string, url string, day date, status string")
    got = board.unique_postings(d, F.col("n"), 10).collect()
    assert sorted((r["title"], r["company"], r["url"], str(r["first_day"]), str(r["day"]), board.RANK[r["status"]], r["rows"], r["superseded"]) for r in got) == board_brute_force(rows, 10)
    _, looked_at = board.settled_openings(board._keyed(d, F.col("n")), 10)
    assert len(looked_at) > 3 and looked_at[-1] == 0 and max(looked_at) <= 13


def test_site_postings_of_rows_without_title_or_company(spark):
    d = spark.createDataFrame([(0, None, None, "x/1", datetime(2026, 1, 1).date(), "shown"), (1, None, None, "x/2", datetime(2026, 1, 2).date(), "applied"), (2, "QA", None, "x/1", datetime(2026, 1, 3).date(), "shown")],
                              "n long, title string, company string, url string, day date, status string")
    got = board.unique_postings(d, F.col("n"), 10).collect()
    assert [(r["url"], r["rows"], r["status"]) for r in got] == [("x/1", 3, "shown")]
    assert board.unique_postings(d.limit(0), F.col("n"), 10).count() == 0


def test_postings_follow_from_one_dealing_by_identity(spark):
    """Facts, modes and skills need no join and no table in between; mentions already imputed give the same postings."""
    rows = [mention(0, "QA", 0, "Acme", skills="SQL; Python", link="u"), mention(1, "QA", 3, "Acme", "b", skills="Python", direction="dev"), mention(2, "QA", 4, None, skills=None),
            mention(3, "Dev", 0, None, level="unspecified", skills="Go; Go"), mention(4, "Dev", 40, "Beta", skills="", salary_stated=True)]
    d = frame(spark, rows)
    plan = dedup.unique_postings(d, impute=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    u = dedup.unique_postings(dedup.impute_company(d)).orderBy("title", "first_seen").collect()
    assert u == dedup.unique_postings(d).orderBy("title", "first_seen").collect()
    assert [(r["title"], r["mentions"], r["direction"], r["level"], r["skills"], r["first_seen"], r["last_seen"], r["channels"]) for r in u] == [
        ("Dev", 1, "analytics", "unspecified", ["Go"], "2026-08-01", "2026-08-01", ["a"]), ("Dev", 1, "analytics", "junior", [], "2026-09-10", "2026-09-10", ["a"]),
        ("QA", 3, "analytics", "junior", ["Python", "SQL"], "2026-08-01", "2026-08-05", ["a", "b"])]


def test_postings_of_some_columns_carry_only_these(spark):
    """Asked for some columns, postings have the values they have anyway, and nothing else travels; also where times and positions repeat."""
    rnd = random.Random(3)
    rows = [mention(n // 3, rnd.choice(["QA (a)", "qa", "Dev"]), rnd.randrange(60), rnd.choice([None, "Acme", "Beta"]), rnd.choice("abc"), level=rnd.choice(["junior", "lead", None]),
                    direction=rnd.choice(["qa", "dev"]), is_it=rnd.random() < .6, work_format=rnd.choice(["remote", "office"]), link=rnd.choice([None, "u", "v"])) for n in range(60)]
    d = frame(spark, rows + rows[:9])
    key = ["_title", "_company", "_extra", "cluster_start"]
    whole = dedup.unique_postings(d, 9, 4, skills=False).orderBy(*key).collect()
    for columns in (("first_seen", "level"), ("title", "direction", "is_it"), ("channels", "first_channel"), ("company_source", "mentions"), ("link", "last_seen", "company")):
        got = dedup.unique_postings(d, 9, 4, skills=False, columns=columns)
        assert set(got.columns) == {*columns, "ord", *key}
        assert [[r[c] for c in got.columns] for r in got.orderBy(*key).collect()] == [[r[c] for c in got.columns] for r in whole]
        assert set(dedup.mention_columns(columns)) >= {"pos", "work_format"}
    plan = dedup.unique_postings(d, skills=False, columns=("first_seen", "level"))._jdf.queryExecution().optimizedPlan().toString()
    read = [line for line in plan.split("\n") if "Aggregate [_title" in line]
    assert read and not any(c in line for line in read for c in ("channel", "link", "salary", "direction", "votes_title"))
    assert dedup.mention_columns(("level",)) == ["level", "work_format", "pos"]


def test_rows_that_are_dealt_out_carry_the_first_mention_once(spark):
    """Votes name the first mention, so a row of a posting has its time, position and title once."""
    plan = dedup.unique_postings(frame(spark, [mention(0, "QA", 0, "Acme")]), skills=False)._jdf.queryExecution().optimizedPlan()
    last = next(line for line in plan.toString().split("\n") if "collect_list(_votes" in line)
    assert "_first#" not in last and "_group_pos" in last


def test_skills_are_ranked_inside_the_row(spark):
    """No row is made for each skill: the ranks equal counting mention by mention, also for skills named twice and for ties."""
    rnd = random.Random(21)
    skills = ["SQL", "sql", "Git", "Excel", "Go", "Дані"]
    rows = [mention(n, rnd.choice(["qa", "dev", "pm", "none"]), rnd.randrange(3), "Acme", channel=rnd.choice(["a", "b"]), level=rnd.choice(["junior", "middle"])) for n in range(120)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [dict(zip(names, r)) for r in rows]
    for r in rows:
        r["skills"] = None if r["title"] == "none" else rnd.choice(["", "; ", "; ".join(rnd.choice(skills) for _ in range(rnd.randrange(1, 5)))])
    made = dedup.unique_postings(frame(spark, [tuple(r[c] for c in names) for r in rows]), skills=True, columns=("title",))
    want = {}
    for title in {r["title"] for r in rows}:
        count, first = {}, {}
        for r in sorted((r for r in rows if r["title"] == title), key=lambda r: (r["ts"], r["n"])):
            for i, s in enumerate(x.strip() for x in (r["skills"] or "").split(";") if x.strip()):
                count[s] = count.get(s, 0) + 1
                first.setdefault(s, (r["ts"], r["n"], i))
        want[title] = sorted(count, key=lambda s: (-count[s], first[s], s))
    assert {r["title"]: r["skills"] for r in made.collect()} == want and want["none"] == [] and max(map(len, want.values())) == 6
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def test_spelling_writes_only_what_is_asked_for(spark):
    from unittest import mock
    d = dedup.unique_postings(frame(spark, [mention(0, "QA", 0, "A", skills="git; SQL"), mention(1, "Dev", 0, "B", skills="Git; sql; Git")]))
    written, write = [], dedup.cut_lineage
    with mock.patch.object(dedup, "cut_lineage", side_effect=lambda df, *n: (written.append(set(df.columns)), write(df, *n))[1]):
        got = dedup.normalize_skills(d, columns=("title", "skills"))
    assert got.columns == ["title", "skills"] and {tuple(sorted(r["skills"])) for r in got.collect()} == {("SQL", "git")}
    assert not any({"_title", "channels", "link"} & c for c in written)
