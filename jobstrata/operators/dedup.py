"""Mentions → unique postings: company imputation, gap clusters, aggregates, canonical skills, reclassification.

A mention row has: title, company (null = unknown), ts, channel, is_it, direction, level, work_format, salary_stated,
skills (`;`-joined), link and `pos`, a struct giving the total order of the input file.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.functions import dates, text
from jobstrata.operators.scale import bucket_of, gap_segments
from jobstrata.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------------------
DIRECTIONS = ("analytics", "ai-ml", "devops", "qa", "pm", "dev", "design", "marketing", "other-it", "non-it")
LEVELS = ("intern", "junior", "middle", "senior", "lead", "unspecified")
FORMATS = ("remote", "hybrid", "office", "unspecified")
NON_IT_DIRECTIONS = ("marketing", "non-it")
CREATIVE_TITLE = ("graphic|графічн|motion|моушн|art ?director|арт-директор|smm|video editor|storyboard|"
                  "2d artist|3d designer|creative designer|marketing design|brand designer|монтаж|creative lead")
KEPT_DESIGN_TITLE = "ui|ux|product designer|web designer|game designer"
NON_DATA_ANALYST_TITLE = "meal|monitoring, (evaluation|reporting)|osint|національна безпека|розслідувач"
# ----------------------------------------------------------------------------------------------------------

IDENTITY = ["_title", "_company", "_extra"]


def with_keys(mentions: DataFrame) -> DataFrame:
    """Normalised title and company and the time in microseconds; left alone when the mentions carry them already."""
    if "_title" in mentions.columns:
        return mentions
    company = text.norm_company(F.col("company"))
    return (mentions.withColumn("_title", text.norm_title(F.col("title")))
            .withColumn("_stated", F.nullif(company, F.lit("")))
            .withColumn("_us", dates.micros(F.col("ts"))))


def nearby_companies(keyed: DataFrame, window_us: int) -> DataFrame:
    """Per (title, window-wide time bucket): everything a mention of that bucket needs to know about its neighbours.

    The window around a mention covers its own bucket whole, a tail of the one before and a head of the one after.
    "Exactly one company" is decided by the two latest companies of a bucket (for itself and the next one) and its two
    earliest (for the one before), so the summary is of constant size however many mentions a title has. All of it
    comes from one pass over the named mentions."""
    named = keyed.where(F.col("_stated").isNotNull())
    per_company = (named.groupBy("_title", bucket_of(F.col("_us"), window_us).alias("_b"), F.col("_stated").alias("_c"))
                   .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last")))
    ends = per_company.select("_title", "_b", "_c", F.explode(F.array(
        F.struct(F.lit("late").alias("end"), F.col("_last").alias("at"), (-F.col("_last")).alias("by")),
        F.struct(F.lit("early").alias("end"), F.col("_first").alias("at"), F.col("_first").alias("by")))).alias("e"))
    # rank <= 2 becomes a limit per group inside each task: a hot bucket is never gathered whole
    w = Window.partitionBy("_title", "_b", "e.end").orderBy("e.by", "_c")
    top2 = ends.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2)
    role = lambda shift, name: F.struct((F.col("_b") + shift).alias("b"), F.lit(name).alias("side"))
    roles = F.when(F.col("e.end") == "late", F.array(role(1, "before"), role(0, "own"))).otherwise(F.array(role(-1, "after")))
    facts = top2.select("_title", "_c", "_r", F.col("e.at").alias("_at"), F.explode(roles).alias("t"))
    pick = lambda side, r: F.max(F.when((F.col("t.side") == side) & (F.col("_r") == r), F.struct("_c", "_at")))
    return facts.groupBy("_title", F.col("t.b").alias("_b")).agg(
        *[pick(s, r).alias(f"_{s}{r}") for s in ("before", "own", "after") for r in (1, 2)])


def impute_company(mentions: DataFrame, window_days: int = 30, enabled: bool = True) -> DataFrame:
    """Adds `_company` and `company_source` (stated / imputed / unknown)."""
    keyed = with_keys(mentions)
    window_us = window_days * dates.DAY_US
    stated = keyed.where(F.col("_stated").isNotNull())
    missing = keyed.where(F.col("_stated").isNull())
    if not enabled:
        found = missing.withColumn("_found", F.lit(None).cast("string"))
    else:
        probe = missing.withColumn("_b", bucket_of(F.col("_us"), window_us))
        joined = probe.join(nearby_companies(keyed, window_us), ["_title", "_b"], "left")
        lo, hi = F.col("_us") - window_us, F.col("_us") + window_us
        seen = F.array(
            F.col("_own1._c"), F.col("_own2._c"),
            *[F.when(F.col(f"_before{r}._at") >= lo, F.col(f"_before{r}._c")) for r in (1, 2)],
            *[F.when(F.col(f"_after{r}._at") <= hi, F.col(f"_after{r}._c")) for r in (1, 2)])
        distinct = F.array_distinct(F.filter(seen, lambda c: c.isNotNull()))
        found = joined.withColumn("_found", F.when(F.size(distinct) == 1, distinct[0])).select(*keyed.columns, "_found")
    out = stated.withColumn("_found", F.col("_stated")).unionByName(found)
    source = (F.when(F.col("_stated").isNotNull(), "stated").when(F.col("_found").isNotNull(), "imputed").otherwise("unknown"))
    company = F.coalesce(F.col("_found"), F.lit(""))
    extra = F.when(company == "", F.coalesce(F.col("work_format"), F.lit(""))).otherwise("")
    return (out.withColumn("company_source", source).withColumn("_company", company)
            .withColumn("_extra", extra).drop("_found", "_stated"))


def assign_clusters(identified: DataFrame, gap_days: int = 30) -> DataFrame:
    """Every mention with `cluster_start` and `_group_pos`, the file position of its identity's first mention."""
    gap_us = gap_days * dates.DAY_US
    seg = gap_segments(identified, IDENTITY, "_us", gap_us, F.min("pos").alias("_first_pos"))
    seg = seg.withColumn("_group_pos", F.min("_first_pos").over(Window.partitionBy(*IDENTITY)))
    return (identified.withColumn("bucket", bucket_of(F.col("_us"), gap_us))
            .join(seg.select(*IDENTITY, "bucket", "cluster_start", "_group_pos"), [*IDENTITY, "bucket"]).drop("bucket"))


def ranked_values(df: DataFrame, group: list[str], value: Column, order: Column) -> DataFrame:
    """(group, value) with its count and first position: the input of a mode or of a list by frequency."""
    return df.groupBy(*group, value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at"))


def mode_first_seen(df: DataFrame, group: list[str], value: Column, order: Column, out: str = "mode") -> DataFrame:
    """Most frequent value per group, blanks and "unspecified" ignored, ties to the first seen."""
    kept = df.where(value.isNotNull() & ~value.isin("", "unspecified"))
    counts = ranked_values(kept, group, value, order)
    return counts.groupBy(*group).agg(
        F.min(F.struct((-F.col("n")).alias("k"), "first_at", "value"))["value"].alias(out))


#: what a posting is made of, beside the keys that `with_keys` adds
MENTION_COLUMNS = ("title", "channel", "is_it", "direction", "level", "work_format", "salary_stated", "link", "pos")
ATTRIBUTES = ("direction", "level", "work_format", "is_it")
POSTING_COLUMNS = ("title", "company", "company_source", "first_seen", "last_seen", "mentions", "channels", "first_channel", *ATTRIBUTES, "salary_stated", "link")


def _first_told(wanted: Sequence[str]) -> list[str]:
    """What the first mention of a posting has to tell. Equal times and positions go by these in turn, so each brings those before it."""
    told = {"title": "title", "first_channel": "channel", "company_source": "company_source"}
    return list(told.values())[:max((i for i, c in enumerate(told, 1) if c in wanted), default=0)]


def mention_columns(wanted: Sequence[str] = POSTING_COLUMNS) -> list[str]:
    """The columns of a mention, beside its keys, that postings with the given columns are made of."""
    used = {"pos", "work_format", *_first_told(wanted), *wanted, *(["channel"] if "channels" in wanted else [])}
    return [c for c in (*MENTION_COLUMNS, "skills") if c in used]


def unique_postings(mentions: DataFrame, gap_days: int = 30, impute_days: int = 30, impute: bool = True,
                    skills: bool = True, columns: Sequence[str] = POSTING_COLUMNS) -> DataFrame:
    """One row per unique posting; `ord` is the order in which the postings are listed.

    Mentions are aggregated map-side per (identity, gap-wide bucket, enumerated attributes, skills), and those rows are dealt out
    by identity once: the window that gives each bucket its cluster, the facts, the modes and the ranks of skills all follow in
    that dealing. A row carries each time and position once: the vote of such a row for its attributes names the first mention too.
    The votes are as many as a cluster has buckets and combinations of attributes and skills, and the ranks of skills are made of
    them inside the row (`_by_use`): no fact is sorted once more for each skill. With `columns` only what those (beside the keys and `ord`) are made of travels.
    Mentions that have been through `impute_company` are taken as they are."""
    gap_us = gap_days * dates.DAY_US
    wanted = [c for c in POSTING_COLUMNS if c in columns]
    said = mentions if "_company" in mentions.columns else impute_company(mentions, impute_days, impute)
    attributes = [c for c in ATTRIBUTES if c in wanted]
    listed = ["_skills"] if skills else []
    told = _first_told(wanted)
    measures = [  # name, the column it is for (none: always), aggregate over mentions, how partial results merge
        ("_hi", None, lambda: F.max("_us"), F.max), ("_first_pos", None, lambda: F.min("pos"), F.min), ("mentions", None, lambda: F.count(F.lit(1)), F.sum),
        ("_channels", "channels", lambda: F.collect_set("channel"), lambda c: F.array_distinct(F.flatten(F.collect_list(c)))),
        ("_salary", "salary_stated", lambda: F.max(F.coalesce(F.col("salary_stated"), F.lit(False))), F.max),
        ("_any_stated", "company_source", lambda: F.max(F.col("company_source") == "stated"), F.max),
        ("_link", "link", lambda: F.min(F.when(F.col("link").isNotNull(), F.struct("_us", "pos", "link"))), F.min)]
    measures = [(name, agg(), merge) for name, of, agg, merge in measures if of is None or of in wanted]
    read = dict.fromkeys([*told, *attributes, *[c for c, of in (("channel", "channels"), ("salary_stated", "salary_stated")) if of in wanted]])
    rows = said.select(*IDENTITY, bucket_of(F.col("_us"), gap_us).alias("bucket"), "_us", "pos", *read,
                       *([F.nullif(F.col("link"), F.lit("")).alias("link")] if "link" in wanted else []), *[F.coalesce("skills", F.lit("")).alias(c) for c in listed])
    key = [*IDENTITY, "cluster_start"]
    part = rows.groupBy(*IDENTITY, "bucket", *attributes, *listed).agg(F.min(F.struct("_us", "pos", *told)).alias("_first"), *[agg.alias(name) for name, agg, _ in measures])
    if skills:      # wide rows: what was shuffled to make them goes before they are dealt out by identity
        part = cut_lineage(part)
    w = Window.partitionBy(*IDENTITY).orderBy("bucket")
    before = F.max("_hi").over(w.rangeBetween(Window.unboundedPreceding, -1))
    lo = F.min("_first._us").over(w.rangeBetween(0, 0))
    part = part.withColumn("_opens", F.when(before.isNull() | (lo - before > gap_us), lo))
    part = (part.withColumn("cluster_start", F.max("_opens").over(w.rangeBetween(Window.unboundedPreceding, 0)))
            .withColumn("_group_pos", F.min("_first_pos").over(Window.partitionBy(*IDENTITY))).drop("_opens", "_first_pos"))
    facts = [(name, merge) for name, _, merge in measures if name != "_first_pos"] + [("_group_pos", F.min)]
    at = F.struct("_first._us", "_first.pos")
    vote = F.struct(at.alias("at"), *[F.col(f"_first.{c}").alias(f"first_{c}") for c in told], F.col("mentions").alias("n"), *[F.col(c).cast("string").alias(c) for c in attributes],
                    *[F.col(c).alias("skills") for c in listed])
    part = part.select(*key, *[name for name, _ in facts], vote.alias("_votes"))
    out = part.groupBy(*key).agg(*[merge(name).alias(name) for name, merge in facts], F.collect_list("_votes").alias("_votes"))
    out = out.withColumn("_first", F.array_min("_votes"))
    known = lambda c: F.coalesce(_voted(F.col("_votes"), c), F.lit("unspecified"))
    day = lambda us: F.date_format(F.date_from_unix_date(((us - F.pmod(us, F.lit(dates.DAY_US))) / dates.DAY_US).cast("int")), "yyyy-MM-dd")
    made = {
        "title": lambda: F.col("_first.first_title"), "company": lambda: F.col("_company"),
        "company_source": lambda: F.when(F.col("_any_stated"), "stated").otherwise(F.col("_first.first_company_source")),
        "first_seen": lambda: day(F.col("_first.at._us")), "last_seen": lambda: day(F.col("_hi")), "mentions": lambda: F.col("mentions"),
        "channels": lambda: F.array_sort("_channels"), "first_channel": lambda: F.col("_first.first_channel"),
        **{c: lambda c=c: known(c) for c in ATTRIBUTES[:3]}, "is_it": lambda: _voted(F.col("_votes"), "is_it") == "true",
        "salary_stated": lambda: F.col("_salary"), "skills": lambda: _by_use(F.col("_votes")), "link": lambda: F.coalesce("_link.link", F.lit(""))}
    listed_as = [c for c in made if c in wanted or (skills and c == "skills")]
    return out.select(*[made[c]().alias(c) for c in listed_as], F.struct("_group_pos", "cluster_start").alias("ord"), *IDENTITY, "cluster_start")


def _voted(votes: Column, name: str) -> Column:
    """The value with most votes, blanks and "unspecified" ignored, ties to the first seen."""
    cast = F.filter(votes, lambda v: v[name].isNotNull() & (v[name] != "unspecified"))

    def result(value: Column) -> Column:
        its = F.filter(cast, lambda v: v[name] == value)
        n = F.aggregate(its, F.lit(0).cast("long"), lambda a, v: a - v["n"])
        return F.struct(n.alias("k"), F.array_min(F.transform(its, lambda v: v["at"])).alias("at"), value.alias("value"))

    return F.array_min(F.transform(F.array_distinct(F.transform(cast, lambda v: v[name])), result))["value"]


def _by_use(votes: Column) -> Column:
    """The skills that the votes name, most mentions first, ties to the first named.

    They are sorted once; equal ones lie beside each other then and each such slice is read once, however many differ."""
    uses = F.flatten(F.transform(votes, lambda v: F.transform(text.split_list(v["skills"]), lambda s, i: F.struct(s.alias("skill"), v["at"].alias("at"), i.alias("i"), v["n"].alias("n")))))
    uses = F.array_sort(F.filter(uses, lambda u: u["skill"].isNotNull()))
    with_ = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731 - evaluates `value` once for all of `then`

    def begins(u: Column) -> Column:
        return F.filter(F.transform(u, lambda x, i: F.when((i == 0) | (x["skill"] != F.get(u, i - 1)["skill"]), i)), lambda i: i.isNotNull())

    def rank(u: Column, at: Column, a: Column, j: Column) -> Column:
        n = F.aggregate(F.slice(u, a + 1, F.coalesce(F.get(at, j + 1), F.size(u)) - a), F.lit(0).cast("long"), lambda k, x: k - x["n"])
        return F.struct(n.alias("k"), F.get(u, a)["at"].alias("at"), F.get(u, a)["i"].alias("i"), F.get(u, a)["skill"].alias("skill"))

    return F.array_sort(with_(uses, lambda u: with_(begins(u), lambda at: F.transform(at, lambda a, j: rank(u, at, a, j)))))["skill"]


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right; null keys count as equal."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, on, "left").drop(*[f"_r_{k}" for k in keys])


def reclassify(uniques: DataFrame) -> DataFrame:
    """Deterministic corrections; `fix` names the rule that fired, null when none did."""
    t, d = F.lower(F.col("title")), F.col("direction")
    creative = (d == "design") & t.rlike(CREATIVE_TITLE) & ~t.rlike(KEPT_DESIGN_TITLE)
    non_data = (d == "analytics") & t.rlike(NON_DATA_ANALYST_TITLE)
    stale = d.isin(*NON_IT_DIRECTIONS) & F.col("is_it")
    fix = (F.when(creative, "creative-design→marketing").when(non_data, "non-data-analyst→non-it")
           .when(stale, "marketing/non-it is_it→False"))
    return (uniques.withColumn("fix", fix)
            .withColumn("direction", F.when(creative, "marketing").when(non_data, "non-it").otherwise(d))
            .withColumn("is_it", F.col("is_it") & F.col("fix").isNull()))


def canonical_forms(uniques: DataFrame, order: str = "ord") -> DataFrame:
    """(key, canonical): the most frequent spelling of each skill, case ignored, ties to the first seen."""
    spelled = uniques.select(order, F.posexplode("skills").alias("_i", "_skill"))
    counts = ranked_values(spelled, [], F.col("_skill"), F.struct(order, "_i")).withColumn("key", F.lower("value"))
    return counts.groupBy("key").agg(
        F.min(F.struct((-F.col("n")).alias("k"), "first_at", "value"))["value"].alias("canonical"))


def normalize_skills(uniques: DataFrame, id_cols: list[str] | None = None, order: str = "ord", columns: Sequence[str] | None = None) -> DataFrame:
    """Replaces every skill by its canonical spelling and drops repeats, order kept.

    The postings are read three times, so they are written first, numbered: skills travel with a number, not with the keys, and
    with `columns` only those are written and returned. The vocabulary grows with the data: it is joined by key, not broadcast
    by hand. A posting without one of its ids has no skills."""
    ids = id_cols or [*IDENTITY, "cluster_start"]
    identified = F.lit(True)
    for c in ids:
        identified = identified & F.col(c).isNotNull()
    kept = [c for c in uniques.columns if columns is None or c in columns]
    uniques = cut_lineage(uniques.select(*dict.fromkeys([*kept, order, "skills"]), identified.alias("_identified"), F.monotonically_increasing_id().alias("_row")))
    forms = canonical_forms(uniques, order)
    long = uniques.where("_identified").select("_row", F.posexplode("skills").alias("_i", "_skill")).withColumn("key", F.lower("_skill"))
    fixed = long.join(forms, "key").groupBy("_row").agg(
        F.array_distinct(F.array_sort(F.collect_list(F.struct("_i", "canonical")))["canonical"]).alias("_canon"))
    return uniques.select(*[c for c in kept if c != "skills"], "_row").join(fixed, "_row", "left").select(
        *[F.coalesce("_canon", F.array().cast("array<string>")).alias(c) if c == "skills" else c for c in kept])
