"""Cost accounting of the external evaluator's calls."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobstrata.functions.numbers import half_even
from jobstrata.operators.scale import running_total

# --- fixed values: USD per million tokens (input, output) per family, in order of preference ----------------
PRICES = (("haiku", 1.0, 5.0), ("sonnet", 3.0, 15.0), ("opus", 5.0, 25.0))
FALLBACK = (5.0, 25.0)
CACHE_WRITE, CACHE_READ = 1.25, 0.10
STAGES = ("cards", "fulltext", "freelance", "mail")
SHADOW_STAGES = ("cards_shadow",)
# ----------------------------------------------------------------------------------------------------------


def price(model: Column, side: int) -> Column:
    name, out = F.lower(F.coalesce(model, F.lit(""))), F.lit(FALLBACK[side])
    for family, *prices in reversed(PRICES):
        out = F.when(name.contains(family), prices[side]).otherwise(out)
    return out


def call_cost(model: Column, inp: Column, out: Column, written: Column, read: Column) -> Column:
    n = lambda c: F.coalesce(c, F.lit(0))
    p_in = price(model, 0)
    return (n(inp) * p_in + n(out) * price(model, 1) + n(written) * p_in * CACHE_WRITE + n(read) * p_in * CACHE_READ) / 1_000_000


def with_cost(usage: DataFrame) -> DataFrame:
    return usage.withColumn("usd", call_cost(*[F.col(c) for c in ("model", "input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")]))


def stage_costs(usage: DataFrame, *group: str) -> DataFrame:
    return with_cost(usage).groupBy(*group, "stage").agg(
        F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")],
        F.sum("usd").alias("usd"), F.array_join(F.array_sort(F.collect_set("model")), "+").alias("models"))


def cost_row(usage: DataFrame, group: str) -> DataFrame:
    """The wide ledger row of a run; the budget leaves the shadow stages out."""
    d = with_cost(usage)
    mine = lambda s: F.col("stage") == s
    aggs = []
    for s in STAGES:
        aggs += [F.count_if(mine(s)).alias(f"{s}_calls"), F.sum(F.when(mine(s), F.col("input_tokens")).otherwise(0)).alias(f"{s}_in"),
                 half_even(F.sum(F.when(mine(s), F.col("usd")).otherwise(0.0)), 5).alias(f"{s}_usd")]
    budget = F.sum(F.when(~F.col("stage").isin(*SHADOW_STAGES), F.col("usd")).otherwise(0.0))
    return d.groupBy(group).agg(*aggs, half_even(F.sum("usd"), 5).alias("total_usd"), half_even(budget, 5).alias("budget_usd"))


def budget_cutoff(usage: DataFrame, run: str, pos: str, limit_usd: float, stride: int = 10_000) -> DataFrame:
    """`made`: calls go on while the spending before them, shadow stages aside, is below the limit."""
    counted = F.when(F.col("stage").isin(*SHADOW_STAGES), F.lit(0).cast("decimal(20,9)")).otherwise(F.round("usd", 9).cast("decimal(20,9)"))
    d = running_total(with_cost(usage), [run], pos, counted, stride, "spent_before")
    return d.withColumn("made", F.col("spent_before") < F.lit(limit_usd).cast("decimal(20,9)"))
