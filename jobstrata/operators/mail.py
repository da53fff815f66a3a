"""Mails: candidates, relevance, companies they are about and the table of applications they update."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.functions import dates, text
from jobstrata.operators.known import contained

# --- fixed values -----------------------------------------------------------------------------------------
KEYWORDS = ("вакансія", "співбесіда", "candidate", "interview", "resume", "application")
NOISE_TOKENS = ("cv", "resume", "cover", "cover_letter", "cover letter", "data", "analyst", "business", "marketing", "junior", "middle", "senior", "product")
REJECTION, INVITATION = "відмова", "запрошення на співбесіду"
WINDOW_DAYS, MAX_THREADS, MIN_TOKEN = 2, 50, 3
# ----------------------------------------------------------------------------------------------------------


def company_names(files: DataFrame, name: str = "name", mime: str = "mime", noise: tuple[str, ...] = NOISE_TOKENS) -> DataFrame:
    """Company names out of file names: (name, company); company is null when it cannot be told (0 or over 3 words)."""
    stem = F.regexp_replace(F.col(name), r"(?i)\.(pdf|docx?|xlsx?)$", "")
    words = F.filter(F.split(stem, r"(?U)[_\-\s]+"), lambda t: (t != "") & ~F.lower(t).isin(*noise) & ~t.rlike(r"(?i)^v?\d+([.,]\d+)*$"))
    own = files.where(~F.coalesce(F.col(mime), F.lit("")).startswith("application/vnd.google-apps."))
    return own.select(name, F.when(F.size(words).between(1, 3), F.array_join(words, " ")).alias("company"))


def candidate(body: Column, sender: Column, from_company: Column, sent: Column, now: Column) -> Column:
    """Worth loading: a keyword, an hr@ sender or a known company, and recent."""
    keyword = F.coalesce(body, F.lit("")).rlike("(?iu)" + "|".join(KEYWORDS))
    return (keyword | text.from_hr(sender) | from_company) & (sent >= now - F.make_dt_interval(F.lit(WINDOW_DAYS)))


def relevant(evaluated: Column, sender: Column, from_company: Column) -> Column:
    return F.coalesce(evaluated, F.lit(False)) | text.from_hr(sender) | from_company


def known_senders(mails: DataFrame, companies: DataFrame, sender: str = "sender", company: str = "company") -> DataFrame:
    """Distinct senders whose address contains a company name (the domain is part of the address)."""
    names = companies.select(F.lower(company).alias("_c"))
    senders = mails.select(sender).distinct().withColumn("_s", F.lower(sender))
    return contained(names, senders, [], "_c", "_s", [sender]).select(sender).distinct()


def company_matches(mails: DataFrame, companies: DataFrame, mail_id: str = "mail_id", company: str = "company") -> DataFrame:
    """(mail, company): the main name occurs in sender or subject, or its first word is a label of the sender's domain.

    Both ways are equi-joins: on the substrings of the wanted lengths and on the exploded domain labels."""
    main = F.lower(F.trim(F.regexp_replace(company, r"\(.*?\)", "")))
    names = companies.select(company).distinct().withColumn("_main", main).where(F.length("_main") >= MIN_TOKEN)
    names = names.withColumn("_first", F.split("_main", r"[\s,.\-]+")[0])
    texts = mails.select(mail_id, F.lower(F.concat_ws(" ", "sender", "subject")).alias("_t"))
    by_name = contained(names, texts, [], "_main", "_t", [mail_id]).join(names.select("_main", company), "_main").select(mail_id, company)
    labels = F.split(text.sender_domain(F.col("sender")), r"\.")
    inner = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0)))
    by_domain = mails.select(mail_id, F.explode(F.array_distinct(inner)).alias("_first")).join(names.where(F.length("_first") >= MIN_TOKEN).select("_first", company), "_first").select(mail_id, company)
    return by_name.union(by_domain).distinct()


def plan_updates(applied: DataFrame, mails: DataFrame) -> DataFrame:
    """What each actionable mail does: (mail_id, action, row_no, note).

    `applied`: row_no, company, status, notes; `mails`: mail_id (their order), sender, subject, date, status. A mail about
    several companies, or about a company with several rows of which not exactly one is still open, is left to a human.
    A company with one open row among several takes mails up to its first rejection. A subject already noted changes
    nothing. The state a sequential pass would carry is thereby a few aggregates per company and row."""
    act = mails.where(F.col("status").isin(REJECTION, INVITATION))
    hits = company_matches(act, applied.where(F.trim("company") != ""), "mail_id")
    per_mail = hits.groupBy("mail_id").agg(F.count(F.lit(1)).alias("_n"), F.min("company").alias("company"))
    open_ = F.coalesce(F.trim("status"), F.lit("")) != REJECTION
    rows = applied.groupBy("company").agg(F.count(F.lit(1)).alias("_rows"), F.count_if(open_).alias("_open"), F.min("row_no").alias("_only"), F.min(F.when(open_, F.col("row_no"))).alias("_first_open"))
    j = act.join(per_mail, "mail_id").join(rows, "company")
    several = F.col("_n") > 1
    target = F.when(~several & (F.col("_rows") == 1), F.col("_only")).when(~several & (F.col("_open") == 1), F.col("_first_open"))
    j = j.withColumn("row_no", target).withColumn("_subject", F.trim("subject"))
    notes = applied.select("row_no", F.coalesce("notes", F.lit("")).alias("_notes"))
    placed = j.where(F.col("row_no").isNotNull()).join(notes, "row_no")
    # the subject of this mail inside the subject of an earlier one about the same row
    earlier = contained(placed.select("row_no", "_subject"), placed.select("row_no", F.col("_subject").alias("_text"), "mail_id"), ["row_no"], "_subject", "_text", ["mail_id"])
    first_said = earlier.groupBy("row_no", "_subject").agg(F.min("mail_id").alias("_said"))
    placed = placed.join(first_said, ["row_no", "_subject"], "left")
    noted = (F.col("_subject") != "") & (F.col("_notes").contains(F.col("_subject")) | (F.coalesce(F.col("_said"), F.col("mail_id")) < F.col("mail_id")))
    placed = placed.withColumn("_noted", noted)
    closed = placed.where(~F.col("_noted") & (F.col("status") == REJECTION) & (F.col("_rows") > 1)).groupBy("row_no").agg(F.min("mail_id").alias("_closed_by"))
    placed = placed.join(closed, "row_no", "left")
    after = F.coalesce(F.col("mail_id") > F.col("_closed_by"), F.lit(False))
    kind = F.when(F.col("status") == REJECTION, "Відмова").otherwise("Запрошення на співбесіду")
    note = F.concat(kind, F.lit(" "), dates.mail_date(F.col("date")), F.lit(" (автопайплайн, лист: «"), F.col("_subject"), F.lit("»)"))
    done = placed.select("mail_id", F.when(after, "ambiguous").when(F.col("_noted"), "noted").when(F.col("status") == REJECTION, "reject").otherwise("invite").alias("action"),
                         "row_no", F.when(~after & ~F.col("_noted"), note).alias("note"))
    none = F.lit(None)
    left = j.where(F.col("row_no").isNull()).select("mail_id", F.when(several, "several companies").otherwise("ambiguous").alias("action"),
                                                    none.cast("long").alias("row_no"), none.cast("string").alias("note"))
    return done.unionByName(left)


def apply_updates(applied: DataFrame, plan: DataFrame) -> DataFrame:
    """The table after the updates: notes appended in mail order, result set by a rejection."""
    per_row = plan.where(F.col("note").isNotNull()).groupBy("row_no").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("mail_id", "note")))["note"], "; ").alias("_add"), F.max(F.col("action") == "reject").alias("_rejected"))
    j = applied.join(per_row, "row_no", "left")
    notes = F.concat_ws("; ", F.nullif(F.col("notes"), F.lit("")), F.col("_add"))
    return j.select(*[c for c in applied.columns if c not in ("notes", "status")],
                    F.when(F.coalesce("_rejected", F.lit(False)), REJECTION).otherwise(F.col("status")).alias("status"), notes.alias("notes"))
