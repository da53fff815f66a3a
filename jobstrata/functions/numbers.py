"""Numbers out of text, rounding, intervals and range strings."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL_N = 30
USD_TO_UAH = 41.0
LOW_BIDS_MAX, MEDIUM_BIDS_MAX = 14, 40


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x.cast("double"), digits)


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """100·part/whole, null for an empty whole."""
    return F.when(whole > 0, half_even(F.lit(100.0) * part / whole, digits))


def small_sample(n: Column) -> Column:
    return n < SMALL_N


def parse_views(raw: Column) -> Column:
    """"1.7K" / "2,3M" / "970" → number."""
    rx = r"^([\d.,]+)\s*([KkMm]?)$"
    t = F.trim(F.coalesce(raw, F.lit("")))
    num = F.replace(F.regexp_extract(t, rx, 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.lower(F.regexp_extract(t, rx, 2))
    return F.bround(num * F.when(unit == "k", 1000.0).when(unit == "m", 1000000.0).otherwise(1.0), 0).cast("long")


def budget_uah(raw: Column) -> Column:
    """First amount of a budget text in the local currency; null when there is none."""
    t = F.coalesce(raw, F.lit(""))
    amount = F.regexp_replace(F.regexp_extract(t, r"(\d[\d\s\u00a0\u202f]*(?:[.,]\d+)?)", 1), r"[\s\u00a0\u202f]", "")
    value = F.replace(amount, F.lit(","), F.lit(".")).try_cast("double")
    return value * F.when(t.rlike(r"(?i)usd|\$"), USD_TO_UAH).otherwise(1.0)


def card_budget(text: Column) -> Column:
    """"… 5 000 грн …" inside a card → "5000 UAH"."""
    rx = r"(?iu)(\d[\d\s\u00a0]{0,9})[\s\u00a0]*(UAH|грн|₴|USD|\$)"
    amount = F.regexp_replace(F.regexp_extract(text, rx, 1), r"[\s\u00a0]", "")
    currency = F.when(F.upper(F.regexp_extract(text, rx, 2)).isin("$", "USD"), "USD").otherwise("UAH")
    return F.when(amount != "", F.concat(amount, F.lit(" "), currency)).otherwise("")


def card_bids(text: Column) -> Column:
    return F.regexp_extract(text, r"(?iu)(\d+)\s*(?:ставок|ставк[аиу]|отклик[а-я]*)", 1).try_cast("int")


def competition_level(bids: Column) -> Column:
    return (F.when(bids.isNull(), F.lit(None).cast("string")).when(bids <= LOW_BIDS_MAX, "низька")
            .when(bids <= MEDIUM_BIDS_MAX, "середня").otherwise("висока"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % score interval of k/n; NaN for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p, zz = k / n, z * z
    d = 1 + zz / n
    centre = (p + zz / (2 * n)) / d
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / d
    empty = F.lit(float("nan"))
    return (F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(empty),
            F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(empty))


def _plain(x: Column) -> Column:
    """One decimal, always shown."""
    return F.format_string("%.1f", x)


def coverage_range(low: Column, high: Column, n: Column) -> Column:
    a, b = half_even(100.0 * low / n, 1), half_even(100.0 * high / n, 1)
    both = F.when(a == b, _plain(a)).otherwise(F.concat(_plain(a), F.lit("–"), _plain(b)))
    return F.when(n > 0, both).otherwise("—")


def loss_range(low: Column, high: Column, n: Column) -> Column:
    a, b = half_even(100.0 - 100.0 * high / n, 1), half_even(100.0 - 100.0 * low / n, 1)
    both = F.when(a == b, _plain(a)).otherwise(F.concat(_plain(a), F.lit("–"), _plain(b)))
    return F.when(n > 0, both).otherwise("—")


def pct_with_interval(k: Column, n: Column) -> Column:
    lo, hi = wilson(k, n)
    whole = lambda c: F.format_string("%d", F.bround(100.0 * c, 0).cast("long"))
    text = F.concat(whole(k / n), F.lit("% ["), whole(lo), F.lit("–"), whole(hi), F.lit("], n="), n.cast("long").cast("string"))
    return F.when(n > 0, text).otherwise("—")
