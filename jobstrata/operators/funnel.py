"""The funnel of one run: every card leaves with exactly one decision and its reason."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.functions import dates, text
from jobstrata.functions.numbers import budget_uah, competition_level
from jobstrata.operators import known
from jobstrata.operators.scale import first_k_per_group, running_total
from jobstrata.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------------------
DATE_WINDOW_DAYS, UNDATED_LIMIT, NEAR_LIMIT, STAGE2_LIMIT = 2, 5, 5, 20
LEVEL_RANK = ("High", "Medium", "Low")
SENIORITY_WORDS = ("senior", "middle", "lead", "head", "principal", "staff", "director", "chief", "сеньйор", "мідл",
                   "керівник", "начальник", "провідний", "старший")
JUNIOR_WORDS = ("junior", "джуніор", "джун", r"strong\s+junior")
REJECTED, SHOWN, NEAR = "відсіяно", "показано", "майже"
NOT_EVALUATED = {"error": ("не оцінено (помилка Claude)", "помилка_Claude"), "budget": ("не оцінено (ліміт бюджету)", "ліміт_бюджету"),
                 "cap": ("не оцінено (ліміт етапу 2)", "ліміт_етапу_2")}
SPECIFIC_SYSTEM = (r"(?iu){b}bas{e}|{b}1\s?[сc]{e}|{b}1\s?[сc][:\-]|{b}m\.?\s?e\.?\s?doc{e}|{b}м\.?\s?е\.?\s?док")
ERP_PLANNING = (r"(?iu){b}erp{e}|автоматичн[{w}]*\s+планув|автоматическ[{w}]*\s+планир|планування\s+виробництва|планирование\s+производства")
SMALL_BUDGET_UAH = 10_000
FIT_DIRECTIONS, ACCEPT_LEVELS, ACCEPT_FORMATS = ("analytics",), ("intern", "junior", "unspecified"), ("remote", "unspecified")
MAX_EXPERIENCE_YEARS = 1
SALARY_FLOOR_MONTH = {"UAH": 30_000, "USD": 700, "EUR": 650}
REJECT_SKILLS = ("bpmn", "uml", "1c", "1с", "oracle", "oracle sql", "dax")
EXCLUDED = (r"(?iu)yandex|яндекс|mail\.ru|{b}vk{e}|вк{e}|russia|росі|belarus|білорус|casino|казино|betting|"
            r"гембл|gambl|букмекер|adult|forex|форекс|binary option")
PERSONAL_CODES = ("роль", "досвід", "формат", "зп", "англійська", "військова служба")
STRICT, WIDE = ("shown", "applied"), ("shown", "applied", "personal_reject")
# ----------------------------------------------------------------------------------------------------------

EVALUATION = (
    "struct<raw_index:int,passes_criteria:boolean,reject_reason:string,reject_code:string,normalized_title:string,normalized_company:string,"
    "match_level:string,match_scores:struct<skills:int,duties:int,expectations:int>,match_reasoning:string,veteran_bonus:boolean,"
    "posted_date:string,date_undetermined:boolean,flags:array<string>,near_miss:boolean,near_miss_reason:string>")


def _rx(pattern: str) -> str:
    return pattern.replace("{b}", text.BOUND_L).replace("{e}", text.BOUND_R).replace("{w}", text.WORD)


def level_rank(level: Column) -> Column:
    return F.when(level == "High", 0).when(level == "Medium", 1).when(level == "Low", 2).otherwise(3)


def seniority(title: Column) -> Column:
    """The seniority marker of a title, "" when there is none."""
    rx = rf"(?iu)({text.whole_words(SENIORITY_WORDS)}|{text.BOUND_L}sr{text.BOUND_R}\.?{text.BOUND_L}|{text.BOUND_L}team\s*lead)"
    return F.regexp_extract(F.coalesce(title, F.lit("")), rx, 0)


def junior_marked(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(rf"(?iu){text.whole_words(JUNIOR_WORDS)}")


def prefilter(cards: DataFrame) -> DataFrame:
    """Rules before any evaluation, over `known`, `posted_raw`, `title`, `url` and `run_date`.

    Adds age, pre_code, pre_detail and cap_medium (a junior marker next to a seniority word)."""
    senior, junior = F.col("_senior") != "", F.col("_junior")
    old = F.col("age") >= DATE_WINDOW_DAYS
    code = (F.when(F.col("known").isNotNull(), F.col("known")).when(old, "дата").when(senior & ~junior, "досвід")
            .when(F.coalesce(F.col("url"), F.lit("")) == "", "інше"))
    detail = (F.when(F.col("known").isNotNull(), "відомий ID вакансії до оцінки")
              .when(old, F.concat(F.lit("поза вікном сьогодні/вчора (картка, "), F.col("age").cast("string"), F.lit(" дн.)")))
              .when(senior & ~junior, F.concat(F.lit("рівень у назві: "), F.col("_senior")))
              .when(F.coalesce(F.col("url"), F.lit("")) == "", "немає URL вакансії"))
    return (cards.withColumn("age", dates.age_days(F.col("posted_raw"), F.col("run_date"))).withColumn("_senior", seniority(F.col("title"))).withColumn("_junior", junior_marked(F.col("title")))
            .withColumn("pre_code", code).withColumn("pre_detail", detail).withColumn("cap_medium", senior & junior).drop("_senior", "_junior"))


def match_level(model: Column, a: Column, b: Column, c: Column, card_only: Column) -> Column:
    """Level from three scores 0–2, never better than the evaluator's own level nor, without the full text, than Medium."""
    valid = F.lit(True)
    for s in (a, b, c):
        valid = valid & s.isNotNull() & s.between(0, 2)
    total = a + b + c
    computed = F.when((a == 0) | (b == 0) | (total <= 2), "Low").when(total >= 5, "High").otherwise("Medium")
    said = F.when(model.isin(*LEVEL_RANK), model)
    worse = F.when(said.isNull() | (level_rank(computed) >= level_rank(said)), computed).otherwise(said)
    level = F.when(valid, worse).otherwise(F.coalesce(said, F.lit("Low")))
    return F.when(card_only & (level == "High"), "Medium").otherwise(level)


def verdict(evaluated: Column, failed: Column, passes: Column, code: Column, reason: Column, level: Column) -> Column:
    """Stage-one verdict: struct(passed — null when not evaluated, text)."""
    why = F.concat(F.lit("відсіяно · "), F.coalesce(F.nullif(code, F.lit("")), F.lit("інше")),
                   F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit(": "), reason)).otherwise(""))
    none = F.lit(None).cast("boolean")
    s = lambda p, t: F.struct(p.alias("passed"), t.alias("text"))
    return (F.when(~evaluated, s(none, F.lit("не оцінено"))).when(failed, s(none, F.lit(NOT_EVALUATED["error"][0])))
            .when(~F.coalesce(passes, F.lit(False)), s(F.lit(False), why))
            .when(level == "Low", s(F.lit(False), F.lit("відсіяно · Low на етапі 1 (картка) · Match Low")))
            .otherwise(s(F.lit(True), F.concat(F.lit("пройшла · Match "), level))))


def in_window(posted: Column, today: Column) -> Column:
    """Today or yesterday; an unknown or unreadable date is no obstacle."""
    d = dates.iso_or_null(posted)
    return d.isNull() | F.datediff(today, d).between(0, 1)


def gig_hard_reject(source: Column, title: Column, snippet: Column, budget_raw: Column, bids: Column) -> Column:
    """First hard reason against a gig of the board; null for other sources."""
    body = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(snippet, F.lit("")))
    budget = budget_uah(budget_raw)
    reason = (F.when(body.rlike(_rx(SPECIFIC_SYSTEM)), "специфічна система (BAS/1С)")
              .when(body.rlike(_rx(ERP_PLANNING)) & (budget.isNull() | (budget <= SMALL_BUDGET_UAH)),
                    "ERP / автоматичне планування з малим бюджетом або без бюджету")
              .when(budget.isNull() & (competition_level(bids) == "висока"), "бюджет не вказано, висока конкуренція"))
    return F.when(source == "gig-board", reason)


def profile_reject(p: dict[str, Column]) -> Column:
    """First reason why a posting does not fit the profile; null when it fits."""
    floor = F.create_map(*[F.lit(x) for k, v in SALARY_FLOOR_MONTH.items() for x in (k, float(v))])[F.upper(F.coalesce(p["salary_currency"], F.lit("")))]
    low = F.coalesce(p["salary_min"], p["salary_max"])
    said = F.concat_ws(" ", p["title"], p["company"], p["skills"])
    return (F.when(~p["is_it"] | ~p["direction"].isin(*FIT_DIRECTIONS), "роль")
            .when(~p["level"].isin(*ACCEPT_LEVELS) | F.coalesce(p["experience"] > MAX_EXPERIENCE_YEARS, F.lit(False)), "досвід")
            .when(~p["work_format"].isin(*ACCEPT_FORMATS), "формат")
            .when((p["salary_period"] == "month") & F.coalesce(low < floor, F.lit(False)), "ЗП")
            .when(said.rlike(_rx(EXCLUDED)), "виключення")
            .when(F.arrays_overlap(text.skill_set(p["skills"]), F.array(*[F.lit(s) for s in REJECT_SKILLS])), "стоп-навик"))


def log_status(result: Column, code: Column) -> Column:
    """What a log row says about a posting: shown / applied / personal_reject / technical; null for non-decisions."""
    r, c = F.lower(F.trim(F.coalesce(result, F.lit("")))), F.lower(F.trim(F.coalesce(code, F.lit(""))))
    rejected = F.when(c == "подано", "applied").when(c.isin(*PERSONAL_CODES), "personal_reject").otherwise("technical")
    return (F.when(r.contains("підсумок") | r.startswith("не оцінено"), F.lit(None).cast("string"))
            .when(r.startswith("майже"), "personal_reject").when(r.contains("відсі"), rejected).otherwise("shown"))


def category(veteran: Column, disability: Column) -> Column:
    return (F.when(veteran & disability, "обидві").when(veteran, "ветеран").when(disability, "інвалідність").otherwise("—"))


def date_source(posted_date: Column, undetermined: Column, posted_raw: Column, full_text: Column) -> Column:
    page = F.coalesce(posted_date, F.lit("")) != ""
    return (F.when(page & ~F.coalesce(undetermined, F.lit(False)), F.when(full_text, "сторінка").otherwise("картка"))
            .when(F.coalesce(posted_raw, F.lit("")) != "", "картка").otherwise("невідома"))


def parse_batches(batches: DataFrame) -> DataFrame:
    """Evaluator answers (batch_id, size, answer JSON) → one row per (batch_id, raw_index).

    The answer is an object with `evaluations`, or a bare list; anything else gives nothing. Items that are not objects
    or point outside the batch are dropped; of two answers for one card the later wins."""
    as_object = F.from_json("answer", "evaluations array<string>")["evaluations"]
    items = F.when(F.col("answer").rlike(r"^\s*\["), F.from_json("answer", "array<string>")).otherwise(as_object)
    # items are read one by one: a stray one does not spoil its batch
    rows = batches.select("batch_id", "size", F.posexplode(items).alias("_at", "_item"))
    rows = rows.withColumn("ev", F.from_json("_item", EVALUATION))
    valid = rows.where(F.col("ev.raw_index").between(0, F.col("size") - 1))
    return valid.groupBy("batch_id", F.col("ev.raw_index").alias("raw_index")).agg(F.max_by("ev", "_at").alias("ev"))


def missing_answers(asked: DataFrame, answered: DataFrame, key: str = "key") -> DataFrame:
    """Posts to ask about once more: asked without a valid answer."""
    return asked.join(answered.select(key).distinct(), key, "left_anti")


def valid_answers(answered: DataFrame, asked: DataFrame, key: str = "key") -> DataFrame:
    return answered.join(asked.select(key).distinct(), key, "left_semi")


def stage_two_cap(df: DataFrame, eligible: str, k: int = STAGE2_LIMIT, run: str = "run_date", id_col: str = "card_id") -> DataFrame:
    """Adds `stage2`: the strongest k eligible cards of each run, by level then position."""
    best = first_k_per_group(df.where(F.col(eligible)).select(run, id_col, "level1"), [run], [level_rank(F.col("level1")), F.col(id_col)], k, id_col, "stage2")
    return df.join(best.where("stage2").select(id_col, "stage2"), id_col, "left").withColumn("stage2", F.coalesce("stage2", F.lit(False)))


def agreement(a: Column, b: Column) -> list[Column]:
    """Counts of a two-evaluator comparison; null verdicts are not compared."""
    both = a.isNotNull() & b.isNotNull()
    return [F.count_if(both).alias("compared"), F.count_if(both & (a == b)).alias("agree"), F.count_if(both & (a != b)).alias("disagree"),
            F.count_if(both & a & ~b).alias("first_pass_second_reject"), F.count_if(both & b & ~a).alias("second_pass_first_reject"),
            F.count_if(~both).alias("not_compared")]


def _flat(evaluation: DataFrame, name: str) -> DataFrame:
    return evaluation.select("card_id", F.struct(*[c for c in evaluation.columns if c != "card_id"]).alias(name))


def _verdict_text(e: str, level: Column) -> Column:
    return verdict(F.col(e).isNotNull(), F.coalesce(F.col(f"{e}.failed"), F.lit(False)), F.col(f"{e}.passes_criteria"),
                   F.col(f"{e}.reject_code"), F.col(f"{e}.reject_reason"), level)["text"]


def _over_first(cards: DataFrame, spending: DataFrame, budget: int, stride: int = 10_000) -> DataFrame:
    """card_id, `_over1`, `_spent1`: calls for open cards go on, by position, while what was spent before is below the budget."""
    cost = F.coalesce(F.col("usd_card"), F.lit(0).cast("long"))
    d = running_total(cards.where("pre_code IS NULL").select("run_date", "card_id").join(spending.select("card_id", "usd_card"), "card_id", "left"),
                      ["run_date"], "card_id", cost, stride, "_spent").withColumn("_over1", F.col("_spent") >= budget)
    spent = d.where(~F.col("_over1")).groupBy("run_date").agg(F.sum(cost).alias("_spent1"))
    return d.select("run_date", "card_id", "_over1").join(spent, "run_date", "left").select("card_id", "_over1", F.coalesce("_spent1", F.lit(0).cast("long")).alias("_spent1"))


def _over_second(cards: DataFrame, spending: DataFrame, budget: int) -> DataFrame:
    """card_id, `_over2` of the cards of stage two, at most as many a run as its cap: the spending goes on from stage one."""
    before = Window.partitionBy("run_date").orderBy(level_rank(F.col("level1")), "card_id").rowsBetween(Window.unboundedPreceding, -1)
    d = cards.where("stage2").select("run_date", "card_id", "level1", "_spent1").join(spending.select("card_id", "usd_full"), "card_id", "left")
    spent = F.col("_spent1") + F.coalesce(F.sum(F.coalesce("usd_full", F.lit(0).cast("long"))).over(before), F.lit(0).cast("long"))
    return d.withColumn("_over2", spent >= budget).select("card_id", "_over2")


def decide(cards: DataFrame, first: DataFrame, second: DataFrame, texts: DataFrame, log: DataFrame | None, applied: DataFrame | None,
           stage_two: int = STAGE2_LIMIT, undated_most: int = UNDATED_LIMIT, near_most: int = NEAR_LIMIT,
           shadow: DataFrame | None = None, spending: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """cards × evaluations → one decision per card (rows out = rows in). The caps label rows of a run, they drop none.

    `first` / `second`: card_id and the flattened evaluation of the card and of the full text; `texts`: card_id, full_text.
    `shadow`: another evaluator's answers for the cards, for its verdict only. `spending`: card_id, usd_card, usd_full, the
    cost of a call in whole micro-dollars (null: none); a call is made while its run has spent less than `budget`, stage
    one by position, then stage two by level and position. Cards without a call are not evaluated and say so."""
    if log is not None:  # read three times
        log = cut_lineage(known.with_ids(log.select("identifier", "label", "shown_date")))
    base = prefilter(known.prefilter_known(cards, log, applied))
    j = base.join(_flat(first, "e1"), "card_id", "left").join(_flat(second, "e2"), "card_id", "left").join(texts, "card_id", "left")
    if shadow is not None:
        j = j.join(_flat(shadow, "e0"), "card_id", "left").withColumn("_shadow", _verdict_text("e0", match_level(
            F.col("e0.match_level"), F.col("e0.score_skills"), F.col("e0.score_duties"), F.col("e0.score_expectations"), F.lit(False)))).drop("e0")
    else:
        j = j.withColumn("_shadow", F.lit(""))
    full = F.coalesce(F.length("full_text") > 0, F.lit(False))
    j = j.withColumn("_full", full).withColumn("level1", match_level(
        F.col("e1.match_level"), F.col("e1.score_skills"), F.col("e1.score_duties"), F.col("e1.score_expectations"), F.lit(False)))
    open_ = F.col("pre_code").isNull()
    passed1 = F.coalesce(F.col("e1.passes_criteria"), F.lit(False)) & ~F.coalesce(F.col("e1.failed"), F.lit(False))
    # read several times below: written once to the shared folder instead of recomputed
    j = cut_lineage(j.withColumn("_ranked", open_ & passed1 & F.col("level1").isin("High", "Medium")))
    no = F.lit(False)
    if spending is not None and budget is not None:
        j = j.join(_over_first(j, spending, budget), "card_id", "left").withColumn("_over1", F.coalesce("_over1", no)).withColumn("_ranked", F.col("_ranked") & ~F.col("_over1"))
        j = stage_two_cap(j, "_ranked", stage_two)
        j = j.join(_over_second(j, spending, budget), "card_id", "left").withColumn("_over2", F.coalesce("_over2", no)).drop("_spent1")
    else:
        j = stage_two_cap(j, "_ranked", stage_two).withColumn("_over1", no).withColumn("_over2", no)
    over = F.col("_over1") | F.col("_over2")
    # the deciding evaluation: the full text for cards that got there, the card otherwise
    j = j.withColumn("ev", F.when(~over, F.when(F.col("stage2"), F.col("e2")).otherwise(F.col("e1"))))
    failed = F.col("ev").isNull() | F.coalesce(F.col("ev.failed"), F.lit(False))
    passes = F.coalesce(F.col("ev.passes_criteria"), F.lit(False))
    day = dates.iso_or_null(F.col("ev.posted_date"))
    undated = F.coalesce(F.col("ev.date_undetermined"), F.lit(False)) | (F.col("ev.posted_date").isNotNull() & day.isNull())
    outside = ~undated & day.isNotNull() & ~F.datediff(F.col("run_date"), day).between(0, 1)
    near1 = F.coalesce(F.col("ev.near_miss"), F.lit(False)) & in_window(F.col("ev.posted_date"), F.col("run_date"))
    low_gate = open_ & ~F.col("_over1") & passed1 & (F.col("level1") == "Low")
    state = (F.when(~open_, "pre").when(over, "budget").when(F.col("_ranked") & ~F.col("stage2"), "cap").when(failed, "failed").when(low_gate, "low")
             .when(~passes, F.when(near1, "near").otherwise("rejected")).when(outside, "date").otherwise("final"))
    j = j.withColumn("_undated", undated).withColumn("state", state)

    candidates = cut_lineage(j.where(F.col("state") == "final").select("card_id", "url", "title", "company", "run_date", "_undated"))
    checks = candidates.select("card_id", "run_date", "_undated")
    if log is not None:
        dup = known.shown_duplicates(candidates, log).withColumn("_dup", F.lit(True))
        checks = checks.join(dup, "card_id", "left").join(known.repost_dates(candidates, log), "card_id", "left")
    else:
        checks = checks.withColumn("_dup", F.lit(None).cast("boolean")).withColumn("repost_date", F.lit(None).cast("date"))
    if applied is not None:
        checks = checks.join(known.application_check(candidates, applied), "card_id", "left")
    else:
        checks = checks.withColumn("verdict", F.lit(None).cast("string")).withColumn("status", F.lit(None).cast("string"))
    outcome = (F.when(F.col("_dup"), "dup").when(F.col("verdict") == "дубль", "applied")
               .when(known.repost_state(F.col("run_date"), F.col("repost_date")) == "near", "repost").otherwise("shown"))
    checks = cut_lineage(checks.withColumn("outcome", outcome))
    undated_shown = checks.where(F.col("_undated") & (F.col("outcome") == "shown"))
    allowed = first_k_per_group(undated_shown.select("run_date", "card_id"), ["run_date"], [F.col("card_id")], undated_most, "card_id", "_ok").where(~F.col("_ok")).select("card_id", F.lit(True).alias("_over"))
    checks = checks.join(allowed, "card_id", "left").withColumn("outcome", F.when(F.col("_over"), "undated").otherwise(F.col("outcome")))
    j = j.join(checks.select("card_id", "outcome", "repost_date", F.col("status").alias("_status"), F.col("verdict").alias("_verdict")), "card_id", "left")
    s = F.when(F.col("state") == "final", F.col("outcome")).otherwise(F.col("state"))
    j = cut_lineage(j.withColumn("s", F.when(s == "repost", "near").otherwise(s)).withColumn("_repost", s == "repost"))

    near = j.where(F.col("s") == "near").select("run_date", "card_id", F.col("ev.posted_date").alias("d"))
    # known dates first, newest first; dateless last; ties by position
    kept = first_k_per_group(near, ["run_date"], [F.desc(F.coalesce("d", F.lit(""))), F.col("card_id")], near_most, "card_id", "_near")
    j = j.join(kept.where("_near").select("card_id", "_near"), "card_id", "left")
    reason = F.coalesce(F.col("ev.reject_reason"), F.lit(""))
    code = (F.when(F.col("s") == "pre", F.col("pre_code")).when(F.col("s") == "cap", NOT_EVALUATED["cap"][1]).when(F.col("s") == "budget", NOT_EVALUATED["budget"][1])
            .when(F.col("s") == "failed", NOT_EVALUATED["error"][1]).when(F.col("s") == "low", "інше")
            .when((F.col("s") == "dup") | F.col("_repost"), "дубль").when(F.col("s") == "applied", "подано").when(F.col("s") == "date", "дата")
            .when(F.col("s") == "undated", "ліміт_невизначеної_дати").when(F.col("s") == "shown", "—")
            .otherwise(F.coalesce(F.nullif(F.col("ev.reject_code"), F.lit("")), F.lit("інше"))))
    level = match_level(F.col("ev.match_level"), F.col("ev.score_skills"), F.col("ev.score_duties"), F.col("ev.score_expectations"), ~F.col("_full"))
    level = F.when(F.col("cap_medium") & (level == "High"), "Medium").otherwise(level)
    detail = (F.when(F.col("s") == "pre", F.col("pre_detail")).when(F.col("s") == "cap", f"ліміт етапу 2: {stage_two}")
              .when(F.col("s") == "budget", F.when(F.col("_over2"), "етап 2").otherwise("етап 1"))
              .when(F.col("s") == "failed", F.when(F.col("stage2"), F.when(F.col("ev").isNull(), "етап 2 без оцінки").otherwise("етап 2"))
                    .otherwise(F.when(F.col("ev").isNull(), "модель не повернула оцінку").otherwise("етап 1")))
              .when(F.col("s") == "low", "Low на етапі 1 (картка)").when(F.col("s") == "dup", "після оцінки")
              .when(F.col("s") == "applied", "таблиця відгуків").when(F.col("s") == "date", "поза вікном сьогодні/вчора")
              .when(F.col("s") == "undated", "").when(F.col("_repost"), F.concat(F.lit("репост вакансії, показаної "), F.date_format("repost_date", "dd.MM"), F.lit(f" (менше {known.REPOST_DUP_DAYS} днів тому)")))
              .when(F.col("s") == "shown", F.concat(level, F.lit(" · "), F.when(F.col("_full"), "сторінка").otherwise("лише картка"))).otherwise(reason))
    result = (F.when(F.col("s") == "shown", SHOWN).when((F.col("s") == "near") & F.col("_near"), NEAR)
              .when(F.col("s") == "cap", NOT_EVALUATED["cap"][0]).when(F.col("s") == "failed", NOT_EVALUATED["error"][0])
              .when(F.col("s") == "budget", NOT_EVALUATED["budget"][0]).otherwise(REJECTED))
    evaluated = ~F.col("s").isin("pre", "cap", "failed", "budget", "undated")
    card_day = F.when((F.col("s") == "pre") & (F.col("pre_code") == "дата"), F.date_format(F.date_sub("run_date", F.col("age")), "yyyy-MM-dd"))
    posted = F.when(evaluated, F.col("ev.posted_date")).otherwise(card_day)
    from_card = date_source(F.lit(None).cast("string"), no, F.col("posted_raw"), no)
    found_on = (F.when((F.col("s") == "undated") | ((F.col("s") == "shown") & F.col("_undated")), "невідома")
                .when(evaluated, date_source(F.col("ev.posted_date"), F.col("ev.date_undetermined"), F.col("posted_raw"), F.col("_full") & F.col("stage2"))).otherwise(from_card))
    said = F.when(F.col("_over1"), NOT_EVALUATED["budget"][0]).otherwise(_verdict_text("e1", F.col("level1")))
    of_open = lambda c: F.when(F.col("s") == "pre", "").otherwise(c)
    body = F.coalesce(F.nullif("full_text", F.lit("")), F.concat(F.col("title"), F.lit("\n"), F.coalesce("snippet", F.lit(""))))
    flag = F.when((F.col("s") == "shown") & (F.col("_verdict") == "прапорець"), F.concat(F.lit("Компанія вже в таблиці: "), F.coalesce(F.nullif("_status", F.lit("")), F.lit("без статусу"))))
    return j.select("card_id", "run_date", "source", F.coalesce("url", F.lit("")).alias("url"), text.label_of(F.col("title"), F.col("company")).alias("label"),
                    result.alias("result"), code.alias("code"), detail.alias("detail"),
                    category(F.coalesce(F.col("ev.veteran_bonus"), F.lit(False)), text.mentions_disability(body)).alias("category"),
                    F.when(F.col("s") == "shown", level).alias("level"), F.coalesce(flag, F.lit("")).alias("company_flag"),
                    ((F.col("s") == "shown") & F.col("_undated")).alias("undated"), F.coalesce(posted, F.lit("")).alias("posted_date"), found_on.alias("date_source"),
                    of_open(said).alias("verdict"), of_open(F.col("_shadow")).alias("shadow_verdict"))
