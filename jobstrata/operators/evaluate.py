"""A classifier against labelled data: sample, precision and recall, kappa, matching inside a post."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobstrata.functions.numbers import half_even, wilson
from jobstrata.functions.text import norm_title, yes_no
from jobstrata.operators.matching import sequence_ratio
from jobstrata.operators.scale import running_position
from jobstrata.session import cut_lineage

MATCH_RATIO = 0.6


def stratified_sample(posts: DataFrame, n: int, seed: int, share: float = 0.7, key: str = "key", positive: str = "is_vacancy") -> DataFrame:
    """Exactly n posts, `share` of them positive; missing positives are not replaced beyond the negatives there are.

    The order is that of md5(seed-key), which any engine can repeat.

    The rank filter is a limit per class inside each task."""
    n_yes = round(n * share)
    w = Window.partitionBy(positive).orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key))), key)
    top = posts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    have = posts.where(F.col(positive)).limit(n_yes).agg(F.count(F.lit(1)).alias("c")).scalar()
    keep = F.when(F.col(positive), F.col("_r") <= n_yes).otherwise(F.col("_r") <= F.lit(n) - have)
    return top.where(keep).drop("_r")


def metric_rows(counts: DataFrame, metrics: list[tuple[str, str, str]]) -> DataFrame:
    """One wide row of counts → (metric, k, n, value, interval)."""
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(k).cast("long").alias("k"), F.col(n).cast("long").alias("n")) for name, k, n in metrics])
    d = counts.select(F.explode(rows).alias("m")).select("m.*")
    lo, hi = wilson(F.col("k"), F.col("n"))
    some = lambda c: F.when(F.col("n") > 0, half_even(c, 1))
    return d.select("metric", "k", "n", some(100.0 * F.col("k") / F.col("n")).alias("value_pct"), some(100 * lo).alias("ci95_low_pct"), some(100 * hi).alias("ci95_high_pct"))


def post_counts(labelled: DataFrame, truth: Column, pred: Column) -> DataFrame:
    tp, fp, fn = truth & pred, ~truth & pred, truth & ~pred
    return labelled.agg(F.count_if(tp).alias("tp"), F.count_if(tp | fp).alias("predicted"), F.count_if(tp | fn).alias("actual"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement beyond chance; null without pairs or when chance alone explains everything."""
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    both = cells.select(F.explode(F.array(F.struct(F.col(a).alias("v"), F.col("c").alias("ca"), F.lit(0).cast("long").alias("cb"), F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0).alias("hit")),
                                          F.struct(F.col(b).alias("v"), F.lit(0).cast("long").alias("ca"), F.col("c").alias("cb"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    m = both.groupBy("v").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"), F.sum("hit").alias("hit"))
    t = m.agg(F.sum("ca").cast("double").alias("n"), F.sum("hit").cast("double").alias("hit"), F.sum(F.col("ca").cast("double") * F.col("cb")).alias("dot"))
    po, pe = F.col("hit") / F.col("n"), F.col("dot") / (F.col("n") * F.col("n"))
    return t.select(F.col("n").cast("long").alias("n"), F.when((F.col("n") > 0) & (pe != 1), half_even((po - pe) / (1 - pe), 4)).alias("kappa"))


def _characters(title: Column) -> Column:
    """The characters of a title, each with the number of its occurrence: what two titles share of them bounds any common
    subsequence. A character and its number are one long, so that sets of them are compared by hash."""
    ordered = F.array_sort(F.filter(F.split(title, ""), lambda c: c != ""))
    return F.transform(F.array(ordered), lambda cs: F.transform(cs, lambda c, i: F.ascii(c).cast("long") * (1 << 32) + (i + 1 - F.array_position(cs, c))))[0]


def match_titles(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Greedy 1:1 matching of the titles inside one post: (key, gold_no, pred_no), null on the side without a pair.

    Inputs: key, no, title_norm. Pairs go by similarity, ties to the larger gold, then the larger prediction number.
    Equal titles (similarity 1) are paired by rank. Of the rest, the pairs that are the best of both their titles are
    exactly those a greedy pass takes next; they are removed and the rest is looked at again until none is left. No post
    is ever gathered in one place."""
    gold, pred = (cut_lineage(d.select("key", "no", "title_norm")) for d in (gold, pred))      # read several times, as are the ranks
    ranked = [cut_lineage(running_position(d.withColumn("_pos", -F.col("no")), ["key", "title_norm"], "_pos", 1_000, "_k").select("key", "title_norm", "_k", F.col("no").alias(n)))
              for d, n in ((gold, "gold_no"), (pred, "pred_no"))]
    equal = cut_lineage(ranked[0].join(ranked[1], ["key", "title_norm", "_k"]).select("key", "gold_no", "pred_no"))
    g = ranked[0].join(equal, ["key", "gold_no"], "left_anti").select("key", "gold_no", F.col("title_norm").alias("a"))
    p = ranked[1].join(equal, ["key", "pred_no"], "left_anti").select("key", "pred_no", F.col("title_norm").alias("b"))
    # each two titles of a post are looked at once, however many rows have them; similarity is at most what the lengths and
    # then the characters allow, and only pairs within both bounds reach the Python part
    titles = [d.select("key", c).distinct().select("key", c, _characters(F.col(c)).alias(f"_{c}")) for d, c in ((g, "a"), (p, "b"))]
    both = F.length("a") + F.length("b")
    enough = lambda shared: 2.0 * shared >= MATCH_RATIO * both - 1e-9
    near = titles[0].join(titles[1], "key").where(enough(F.least(F.length("a"), F.length("b")))).where(enough(F.size(F.array_intersect("_a", "_b"))))
    near = cut_lineage(near.select("key", "a", "b"))
    scored = near.select("a", "b").distinct().withColumn("r", sequence_ratio(F.col("a"), F.col("b"))).where(F.col("r") >= MATCH_RATIO)
    left = cut_lineage(g.join(near.join(scored, ["a", "b"]), ["key", "a"]).join(p, ["key", "b"]).select("key", "gold_no", "pred_no", "r"))
    chosen = equal
    while not left.isEmpty():
        rank = F.struct("r", "gold_no", "pred_no")
        of_gold = left.groupBy("key", "gold_no").agg(F.max(rank).alias("g"))
        of_pred = left.groupBy("key", "pred_no").agg(F.max(rank).alias("p"))
        taken = cut_lineage(of_gold.join(of_pred, (of_gold.key == of_pred.key) & (of_gold.g == of_pred.p)).select(of_gold.key, "gold_no", "pred_no"))
        left = cut_lineage(left.join(taken.select("key", "gold_no"), ["key", "gold_no"], "left_anti").join(taken.select("key", "pred_no"), ["key", "pred_no"], "left_anti"))
        chosen = chosen.unionByName(taken)
    none = F.lit(None).cast("long")
    missed = gold.select("key", F.col("no").alias("gold_no")).join(chosen, ["key", "gold_no"], "left_anti").withColumn("pred_no", none)
    extra = pred.select("key", F.col("no").alias("pred_no")).join(chosen, ["key", "pred_no"], "left_anti").withColumn("gold_no", none)
    return chosen.unionByName(missed).unionByName(extra)


FIELDS = (("is_it", "true_is_it"), ("direction", "true_direction"), ("level", "true_level"))


def labelled_posts(posts: DataFrame) -> DataFrame:
    """Posts whose true_is_vacancy says yes or no, with `truth`."""
    return posts.withColumn("truth", yes_no(F.col("true_is_vacancy"))).where(F.col("truth").isNotNull())


def truth_rows(rows: DataFrame, posts: DataFrame) -> DataFrame:
    """Labelled vacancies of labelled posts: at least one truth field filled, invented ones ("none") left out."""
    filled = F.lit(False)
    for c in ("true_title", "true_is_it", "true_direction", "true_level"):
        filled = filled | (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    real = F.lower(F.trim(F.coalesce("true_direction", F.lit("")))) != "none"
    return rows.where(filled & real).join(labelled_posts(posts).select("key").distinct(), "key", "left_semi")


def score(posts: DataFrame, rows: DataFrame, pred_posts: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics with intervals, and every disagreement as a row.

    `posts`: key, true_is_vacancy; `rows`: key, no, title_hint and the truth fields; `pred_posts`: keys predicted to hold
    vacancies; `pred`: key, no, title, is_it, direction, level."""
    said = pred_posts.select("key").distinct().withColumn("_pred", F.lit(True))
    labelled = labelled_posts(posts)
    counts = post_counts(labelled.join(said, "key", "left"), F.col("truth"), F.coalesce("_pred", F.lit(False)))
    name = F.coalesce(F.nullif("true_title", F.lit("")), "title_hint")
    gold = truth_rows(rows, posts)
    mine = pred.join(labelled.select("key").distinct(), "key", "left_semi")
    m = cut_lineage(match_titles(gold.select("key", "no", norm_title(name).alias("title_norm")), mine.select("key", "no", norm_title(F.col("title")).alias("title_norm"))))
    full = (m.join(gold.select("key", F.col("no").alias("gold_no"), name.alias("gold_title"), *[t for _, t in FIELDS]), ["key", "gold_no"], "left")
            .join(mine.select("key", F.col("no").alias("pred_no"), F.col("title").alias("pred_title"), *[F.lower(F.trim(F.col(f).cast("string"))).alias(f) for f, _ in FIELDS]), ["key", "pred_no"], "left"))
    both = F.col("gold_no").isNotNull() & F.col("pred_no").isNotNull()
    flag = lambda c: F.when(F.coalesce(yes_no(c), F.lit(False)), "y").otherwise("n")
    cells = []
    for f, t in FIELDS:
        g, p = F.lower(F.trim(F.coalesce(F.col(t), F.lit("")))), F.col(f)
        g, p = (F.when(g != "", flag(g)), flag(p)) if f == "is_it" else (F.nullif(g, F.lit("")), p)
        cells.append(F.struct(F.lit(f).alias("field"), g.alias("gold"), p.alias("pred")))
    compared = full.where(both).select("key", F.col("pred_title").alias("title"), F.explode(F.array(*cells)).alias("c")).select("key", "title", "c.*").where(F.col("gold").isNotNull())
    found = full.agg(F.count_if(both).alias("v_tp"), F.count_if(F.col("pred_no").isNotNull()).alias("v_pred"), F.count_if(F.col("gold_no").isNotNull()).alias("v_gold"))
    accuracy = compared.agg(*[F.count_if((F.col("field") == f) & cond).alias(f"{f}_{n}") for f, _ in FIELDS for n, cond in (("ok", F.col("gold") == F.col("pred")), ("n", F.lit(True)))])
    one = lambda d: d.withColumn("_row", F.lit(1))  # noqa: E731 - three one-row tables side by side
    wide = one(counts).join(one(found), "_row").join(one(accuracy), "_row")
    metrics = metric_rows(wide, [("post_is_vacancy_precision", "tp", "predicted"), ("post_is_vacancy_recall", "tp", "actual"), ("vacancy_extraction_precision", "v_tp", "v_pred"),
                                 ("vacancy_extraction_recall", "v_tp", "v_gold"), *[(f"{f}_accuracy", f"{f}_ok", f"{f}_n") for f, _ in FIELDS]])
    wrong = compared.where(F.col("gold") != F.col("pred")).select("key", "title", "field", "gold", "pred")
    alone = lambda cond, title, field, g, p: full.where(cond).select("key", F.col(title).alias("title"), F.lit(field).alias("field"), F.lit(g).alias("gold"), F.lit(p).alias("pred"))
    errors = (wrong.unionByName(alone(F.col("pred_no").isNull(), "gold_title", "vacancy_missed", "є", "немає"))
              .unionByName(alone(F.col("gold_no").isNull(), "pred_title", "vacancy_extra", "немає", "є")))
    return metrics, errors
