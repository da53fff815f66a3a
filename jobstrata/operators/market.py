"""Shares, skill demand, channel scorecards and monthly tables over unique postings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.functions import dates
from jobstrata.functions.numbers import half_even, pct, small_sample
from jobstrata.operators.dedup import DIRECTIONS, LEVELS

JUNIOR = ("intern", "junior")
MIDDLE_UP = ("middle", "senior", "lead")
IT_DIRECTIONS = tuple(d for d in DIRECTIONS if d != "non-it")


def shares(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """Share of each value inside its group, with n; callers pass any two expressions."""
    counts = df.groupBy(group.alias("group"), value.alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    n = F.sum("cnt").over(Window.partitionBy("group"))
    return (counts.withColumn("n", n)
            .select("group", "value", pct(F.col("cnt"), F.col("n")).alias("share_pct"), "n",
                    small_sample(F.col("n")).alias("small_sample")))


def full_weeks(df: DataFrame, day: str) -> DataFrame:
    """Rows of complete ISO weeks inside the period the data covers."""
    d = F.col(day).cast("date")
    span = df.agg(F.min(d).alias("lo"), F.max(d).alias("hi"))
    monday = F.trunc(d, "week")
    return df.where((monday >= span.select("lo").scalar()) & (F.date_add(monday, 6) <= span.select("hi").scalar()))


def skills_by_direction(uniques: DataFrame, k: int = 20) -> DataFrame:
    """Most wanted skills per direction; the share is over all postings of the direction.

    Ties go to the skill of the earlier posting (`ord`); those first seen in one posting, whose skills are a set, by name."""
    have = F.array_distinct("skills")
    totals = uniques.groupBy("direction").agg(F.count(F.lit(1)).alias("n"),
                                              F.sum((F.size("skills") > 0).cast("long")).alias("n_with_skills"))
    counts = (uniques.select("direction", "ord", F.explode(have).alias("skill"))
              .groupBy("direction", "skill").agg(F.count(F.lit(1)).alias("c"), F.min("ord").alias("first")))
    w = Window.partitionBy("direction").orderBy(F.desc("c"), "first", "skill")
    top = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return (top.join(totals, "direction")
            .select("direction", "skill", pct(F.col("c"), F.col("n")).alias("share_pct"), "n", "n_with_skills",
                    small_sample(F.col("n")).alias("small_sample")))


def channel_metrics(posts: DataFrame, mentions: DataFrame, uniques: DataFrame) -> DataFrame:
    """Scorecard per channel of the post ledger: four grouped aggregates joined on the channel."""
    done = F.coalesce(F.nullif(F.col("classified"), F.lit("")), F.lit("True")) == "True"
    ledger = posts.groupBy("channel").agg(
        F.count(F.lit(1)).alias("posts"), F.count_if(~done).alias("unclassified_posts"), F.count_if(done).alias("_done"),
        F.count_if(done & F.col("is_vacancy")).alias("_vacancy"), F.count_distinct(dates.iso_week(F.col("ts"))).alias("_weeks"),
        F.bround(F.avg("views"), 0).cast("long").alias("avg_views"))
    said = mentions.groupBy("channel").agg(F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("is_it")).alias("_it"))
    it = uniques.where("is_it")
    in_channel = it.select("first_channel", F.explode("channels").alias("channel"), (F.size("channels") == 1).alias("_only"))
    found = in_channel.groupBy("channel").agg(
        F.count(F.lit(1)).alias("unique_it_vacancies"), F.count_if(F.col("_only")).alias("_excl"),
        F.count_if(F.col("first_channel") == F.col("channel")).alias("published_first"))
    j = ledger
    for other in (said, found):
        j = j.join(other, "channel", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    uniq = zero("unique_it_vacancies")
    return j.select(
        "channel", "posts", "unclassified_posts", pct(F.col("_vacancy"), F.col("_done")).alias("vacancy_post_share_pct"),
        zero("mentions").alias("mentions"), pct(zero("_it"), zero("mentions")).alias("it_share_pct"),
        uniq.alias("unique_it_vacancies"), half_even(uniq / F.greatest(F.lit(1), F.col("_weeks")), 1).alias("unique_it_per_week"),
        F.when(uniq > 0, half_even(zero("_it") / uniq, 2)).alias("repeat_ratio"), zero("published_first").alias("published_first"),
        pct(zero("_excl"), uniq).alias("exclusive_share_pct"), "avg_views")


def load_channels(channels: DataFrame, panel: str = "all") -> DataFrame:
    """One panel or all; orientation defaults to general, depth to 40 pages."""
    rows = channels if panel == "all" else channels.where(F.col("panel") == panel)
    return (rows.withColumn("orientation", F.coalesce(F.nullif(F.col("orientation"), F.lit("")), F.lit("general")))
            .withColumn("max_pages", F.coalesce(F.col("max_pages"), F.lit(40))))


def orientation_group(uniques: DataFrame, channels: DataFrame) -> DataFrame:
    """Adds `group`: general when any channel is not junior-only. The registry of channels is one array in the plan."""
    junior = channels.where(F.col("orientation") == "junior").agg(F.collect_set("handle").alias("s")).scalar()
    general = F.exists("channels", lambda c: ~F.array_contains(F.col("_junior"), c))
    return uniques.withColumn("_junior", junior).withColumn("group", F.when(general, "general").otherwise("junior-only")).drop("_junior")


def control_group(uniques: DataFrame, channels: DataFrame) -> DataFrame:
    it = orientation_group(uniques.where("is_it"), channels)
    both = it.agg(*[F.struct(F.lit(g).alias("group"), *[
        F.count_if((F.col("group") == g) & cond).alias(name) for name, cond in (
            ("n_it_unique", F.lit(True)), ("junior_intern_n", F.col("level").isin(*JUNIOR)),
            ("n_level_stated", F.col("level") != "unspecified"))]).alias(a)
        for g, a in (("general", "a"), ("junior-only", "b"))])
    rows = both.select(F.explode(F.array("a", "b")).alias("r")).select("r.*")
    return rows.select("group", "n_it_unique", "junior_intern_n",
                       pct(F.col("junior_intern_n"), F.col("n_it_unique")).alias("junior_share_of_all_pct"), "n_level_stated",
                       pct(F.col("junior_intern_n"), F.col("n_level_stated")).alias("junior_share_of_stated_pct"),
                       small_sample(F.col("n_it_unique")).alias("small_sample"))


def direction_by_month(uniques: DataFrame, months: list[str] | None = None) -> DataFrame:
    """IT postings by direction and month of first appearance, with totals ("total" on either side).

    With `months` the result is a table with one column per month."""
    it = (uniques.where(F.col("is_it") & F.col("direction").isin(*IT_DIRECTIONS))
          .withColumn("month", dates.year_month(F.col("first_seen"))))
    junior = F.count_if(F.col("level").isin(*JUNIOR)).alias("junior_intern")
    if months:
        return it.rollup("direction").pivot("month", months).count().withColumn("direction", F.coalesce("direction", F.lit("total"))).na.fill(0)
    cube = it.cube("direction", "month").agg(F.count(F.lit(1)).alias("n"), junior)
    return cube.select(F.coalesce("direction", F.lit("total")).alias("direction"), F.coalesce("month", F.lit("total")).alias("month"), "n", "junior_intern")


def direction_level_by_month(uniques: DataFrame) -> DataFrame:
    """Month × direction × level with zero rows kept and a total row per month."""
    it = uniques.where(F.col("is_it")).withColumn("month", dates.year_month(F.col("first_seen")))
    grid = (uniques.select(dates.year_month(F.col("first_seen")).alias("month")).distinct()
            .select("month", F.explode(F.array(*[F.lit(d) for d in IT_DIRECTIONS])).alias("direction")))
    levels = [F.count_if(F.col("level") == lv).alias(lv) for lv in LEVELS]
    counts = it.groupBy("month", "direction").agg(*levels, F.count(F.lit(1)).alias("total"))
    filled = grid.join(counts, ["month", "direction"], "left").na.fill(0)
    sums = [F.sum(c).alias(c) for c in (*LEVELS, "total")]
    return filled.rollup("month", "direction").agg(*sums).where(F.col("month").isNotNull()).withColumn(
        "direction", F.coalesce("direction", F.lit("total")))


def level_buckets(uniques: DataFrame, direction: str = "analytics") -> DataFrame:
    """Junior / unspecified / middle and above per month for one direction; months without any stay as zeros."""
    mine = F.col("is_it") & (F.col("direction") == direction)
    return uniques.groupBy(dates.year_month(F.col("first_seen")).alias("month")).agg(
        F.count_if(mine).alias("total"), F.count_if(mine & F.col("level").isin(*JUNIOR)).alias("junior_intern"),
        F.count_if(mine & (F.col("level") == "unspecified")).alias("unspecified"),
        F.count_if(mine & F.col("level").isin(*MIDDLE_UP)).alias("middle_up"))


def two_source_months(feed: DataFrame, site: DataFrame, direction: str = "analytics", start: str | None = None, end: str | None = None) -> DataFrame:
    """Feed and site side by side for every calendar month from `start` to `end` (yyyy-MM; else all that either has).

    A month without postings in the feed is zero, one without site logs null."""
    mine = F.col("is_it") & (F.col("direction") == direction)
    left = feed.groupBy(dates.year_month(F.col("first_seen")).alias("month")).agg(
        F.count_if(mine).alias("tg_analytics"),
        F.count_if(mine & F.col("level").isin(*JUNIOR, "unspecified")).alias("tg_analytics_junior_or_unspecified"))
    strict = F.col("status").isin("shown", "applied")
    wide = site.where(F.col("status").isin("shown", "applied", "personal_reject"))
    right = wide.groupBy(dates.year_month(F.col("day")).alias("month")).agg(
        F.count_if((F.col("direction") == direction) & strict).alias("repo_analytics_shown_applied"),
        F.count_if(F.col("direction") == direction).alias("repo_analytics_wide"), F.count(F.lit(1)).alias("repo_all_wide"))
    # one row per month from here on
    both = left.join(right, "month", "full")
    first, last = (F.to_date(F.concat(F.lit(given) if given else ends, F.lit("-01"))) for given, ends in ((start, F.min("month")), (end, F.max("month"))))
    months = both.agg(first.alias("a"), last.alias("b")).where("a <= b").select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return months.select(dates.year_month(F.col("m")).alias("month")).join(both, "month", "left").select(
        "month", zero("tg_analytics"), zero("tg_analytics_junior_or_unspecified"), "repo_analytics_shown_applied", "repo_analytics_wide", "repo_all_wide")


def company_sources(uniques: DataFrame) -> DataFrame:
    return uniques.groupBy("company_source").agg(F.count(F.lit(1)).alias("n"))
