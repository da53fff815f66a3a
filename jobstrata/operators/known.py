"""Is this card already known? Equi-joins on identity keys against the shown log and the table of applications."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.functions import dates, urls
from jobstrata.functions.text import label_of, norm_company, strip
from jobstrata.session import cut_lineage

REPOST_DUP_DAYS = 7


def dedup_key(url: Column, title: Column, company: Column) -> Column:
    named = F.concat(F.lower(strip(title)), F.lit("|"), F.lower(strip(company)))
    return F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(named)


def parse_pipe_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """`date | id | label` lines; only the first two pipes separate, incomplete lines are ignored."""
    parts = F.transform(F.split(strip(F.col(column)), r"\|", 3), lambda p: strip(p))
    return (lines.select(parts.alias("p")).where(F.size("p") == 3)
            .select(F.col("p")[0].alias("shown_date"), F.col("p")[1].alias("identifier"), F.col("p")[2].alias("label")))


def with_ids(log: DataFrame) -> DataFrame:
    """The log with the identity of each entry; left alone when it carries them already."""
    return log if "_id" in log.columns else log.withColumn("_id", urls.identity(F.col("identifier")))


def prefilter_known(cards: DataFrame, log: DataFrame | None, applied: DataFrame | None) -> DataFrame:
    """Adds `known`: "подано" (applied, outranks) / "дубль" (shown) / null. An unavailable source (None) is skipped."""
    def ids(rows: DataFrame, url: Column, weight: int) -> DataFrame:
        """Rows without a url go first, so that no filter has to work out the identity again."""
        own = F.col("_id") if "_id" in rows.columns else urls.identity(F.col("_url"))
        return rows.withColumn("_url", url).where("_url <> ''").select(F.coalesce(own, F.lit("")).alias("_id"), F.lit(weight).alias("_w"))

    facts = []
    if log is not None:
        facts.append(ids(log, F.col("identifier"), 1))
    if applied is not None:
        facts.append(ids(applied, strip(F.col("url")), 2))
    if not facts:
        return cards.withColumn("known", F.lit(None).cast("string"))
    keys = facts[0] if len(facts) == 1 else facts[0].unionByName(facts[1])
    keys = keys.groupBy("_id").agg(F.max("_w").alias("_w"))
    out = cards.withColumn("_id", urls.identity(F.col("url"))).join(keys, "_id", "left")
    return out.withColumn("known", F.when(F.col("_w") == 2, "подано").when(F.col("_w") == 1, "дубль")).drop("_id", "_w")


def shown_duplicates(cards: DataFrame, log: DataFrame, id_col: str = "card_id") -> DataFrame:
    """Ids of cards already shown: same identity, or, when the url has no id, same dedup key or same label.

    The log is first reduced to the keys that a card asks for: with few cards it is not shuffled."""
    kind = lambda k, c: F.struct(F.lit(k).alias("k"), c.alias("v"))
    no_id = urls.posting_id(F.col("url")).isNull()
    label = F.lower(label_of(F.col("title"), F.col("company")))
    mine = F.array(kind("i", urls.identity(F.col("url"))),
                   F.when(no_id, kind("d", dedup_key(F.col("url"), F.col("title"), F.col("company")))), F.when(no_id, kind("l", label)))
    theirs = F.array(kind("i", F.col("_id")), kind("d", F.col("identifier")), kind("l", F.lower("label")))
    usable = lambda c: F.explode(F.filter(c, lambda x: x["v"].isNotNull())).alias("key")
    left = cut_lineage(cards.select(id_col, usable(mine)))
    right = with_ids(log).select(usable(theirs)).join(left.select("key").distinct(), "key", "left_semi").distinct()
    return left.join(right, "key", "left_semi").select(id_col).distinct()


def repost_dates(cards: DataFrame, log: DataFrame, id_col: str = "card_id") -> DataFrame:
    """(id, repost_date): latest showing of the same "title — company" under another identity.

    Each label keeps its two latest identities: enough to leave out the card's own, whatever the label's size. Labels that no
    card has are left out first."""
    mine = cut_lineage(cards.select(id_col, norm_company(label_of(F.col("title"), F.col("company"))).alias("_label"), urls.identity(F.col("url")).alias("_own")))
    asked = log.withColumn("_label", norm_company(F.col("label"))).join(mine.select("_label").distinct(), "_label", "left_semi")
    entries = (with_ids(asked).select("_label", "_id", dates.date_cell(F.col("shown_date")).alias("_d")).where(F.col("_d").isNotNull())
               .groupBy("_label", "_id").agg(F.max("_d").alias("_d")))
    w = Window.partitionBy("_label").orderBy(F.desc("_d"), "_id")
    two = (entries.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2).groupBy("_label")
           .agg(*[F.max(F.when(F.col("_r") == r, F.struct("_id", "_d"))).alias(f"_e{r}") for r in (1, 2)]))
    own = F.col("_own").eqNullSafe(F.col("_e1._id")) & F.col("_own").isNotNull()
    day = F.when(own, F.col("_e2._d")).otherwise(F.col("_e1._d"))
    return mine.join(two, "_label").select(id_col, day.alias("repost_date")).where(F.col("repost_date").isNotNull())


def repost_state(run_date: Column, repost_date: Column) -> Column:
    return F.when(F.datediff(run_date, repost_date) < REPOST_DUP_DAYS, "near").when(repost_date.isNotNull(), "flag")


def contained(needles: DataFrame, haystacks: DataFrame, group: list[str], needle: str, text: str, carry: list[str]) -> DataFrame:
    """(group, needle, carry…): needles that occur inside a text of the same group, without comparing all pairs.

    Texts are cut into the substrings whose lengths some needle of the group has, then joined by equality; the work is
    linear in the texts. Both sides are reduced to distinct values first."""
    wanted = needles.select(*group, needle).where(F.length(needle) > 0).distinct()
    lengths = wanted.groupBy(*group).agg(F.collect_set(F.length(needle)).alias("_len"))
    texts = haystacks.select(*group, text, *carry)
    texts = texts.join(lengths, group) if group else texts.withColumn("_len", lengths.select("_len").scalar())
    pieces = F.array_distinct(F.flatten(F.transform(F.filter("_len", lambda n: n <= F.length(text)), lambda n: F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(F.col(text), i, n)))))
    cut = texts.select(*group, *carry, F.explode(pieces).alias(needle))
    return cut.join(wanted, [*group, needle])


def application_check(cards: DataFrame, applied: DataFrame, id_col: str = "card_id") -> DataFrame:
    """(id, verdict, status): "дубль" when already applied to, "прапорець" when only the company is known.

    A duplicate is the same identity, or the same company with no url in the table or with the title in the notes; the
    first row of the table decides. The table is reduced per key before every join."""
    rows = applied.select("row_no", "status", urls.identity(F.nullif(strip(F.col("url")), F.lit(""))).alias("_id"),
                          F.nullif(norm_company(F.col("company")), F.lit("")).alias("_company"), norm_company(F.col("notes")).alias("_notes"))
    at = F.struct("row_no", "status")
    by_id = rows.where(F.col("_id").isNotNull()).groupBy("_id").agg(F.min(at).alias("_by_id"))
    by_company = rows.where(F.col("_company").isNotNull()).groupBy("_company").agg(
        F.min(at).alias("_any"), F.min(F.when(F.col("_id").isNull(), at)).alias("_no_url"))
    mine = cards.select(id_col, urls.identity(F.col("url")).alias("_id"), F.nullif(norm_company(F.col("company")), F.lit("")).alias("_company"),
                        norm_company(F.col("title")).alias("_title"))
    # of rows that say the same of a company the first one counts
    said = rows.where((F.col("_company").isNotNull()) & (F.col("_notes") != "")).groupBy("_company", "_notes").agg(F.min(at).alias("_at"))
    noted = contained(mine.where(F.col("_company").isNotNull()), said, ["_company"], "_title", "_notes", ["_at"])
    noted = noted.groupBy("_company", "_title").agg(F.min("_at").alias("_noted"))
    j = mine.join(by_id, "_id", "left").join(by_company, "_company", "left").join(noted, ["_company", "_title"], "left")
    dup = F.array_min(F.array("_by_id", "_no_url", "_noted"))
    return j.select(id_col, F.when(dup.isNotNull(), "дубль").when(F.col("_any").isNotNull(), "прапорець").alias("verdict"),
                    F.coalesce(dup["status"], F.col("_any.status")).alias("status")).where(F.col("verdict").isNotNull())


def dedup_level(log_available: bool, applied_available: bool) -> tuple[int, str]:
    """1 with the shown log, 2 with the table of applications only, 0 without either; and the note for the report."""
    if log_available:
        note = "" if applied_available else "Таблиця відгуків недоступна в цьому запуску — дедублікація лише за логом показаних."
        return 1, note
    if applied_available:
        return 2, ("Лог дублів недоступний; дедублікацію виконано по таблиці відгуків "
                   "(охоплює лише вакансії, на які подано, — показані-але-не-подані могли пройти повторно).")
    return 0, ("Обидва рівні дедублікації (лог і таблиця відгуків) виявились "
               "недоступні в цьому запуску — показ вакансій без дедублікації.")
