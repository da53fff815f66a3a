"""Stored pages → rows: cards, channel posts, main text, embedded JSON. All of it in built-in expressions."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobstrata.functions.numbers import card_bids, card_budget, parse_views

SNIPPET_CHARS, MIN_TEXT_CHARS, MAX_TEXT_CHARS = 600, 200, 6000

# --- fixed values -----------------------------------------------------------------------------------------
NOISE_TAGS = ("script", "style", "noscript", "nav", "header", "footer", "form", "svg", "iframe")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
# ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CardRule:
    """How the cards of one listing look: where a card starts and where its fields are (group 1 of each pattern)."""
    source: str
    block: str
    url: str
    base: str = ""
    title: str = ""
    fields: dict[str, str] = field(default_factory=dict)


CARD_RULES = (
    CardRule("board-a", r'(?i)<div[^>]*class="[^"]*\bjob-item\b', r'href="(/jobs/\d+-[^"#?]*)"', "https://board-a.example",
             r'(?is)<h[23][^>]*class="[^"]*position[^"]*"[^>]*>(.*?)</h[23]>',
             {"company": r'(?is)<span[^>]*class="[^"]*\bsmall\b[^"]*"[^>]*>(.*?)</span>', "posted_raw": r"(?i)((?:updated|оновлено)\s+[^<]*?(?:ago|тому))"}),
    CardRule("board-b", r'(?i)<li[^>]*class="[^"]*\bl-vacancy\b', r'href="([^"]*/companies/[\w-]+/vacancies/\d+/?)"', "https://board-b.example", "",
             {"company": r'(?is)<[^>]*class="[^"]*company[^"]*"[^>]*>(.*?)</', "posted_raw": r'(?is)<[^>]*class="[^"]*date[^"]*"[^>]*>(.*?)</'}),
    CardRule("board-c", r'(?i)(?=<a[^>]*href="[^"]*/company\d+/vacancy\d+)', r'href="([^"]*/company\d+/vacancy\d+)', "https://board-c.example", "",
             {"company": r'(?is)<[^>]*class="[^"]*company[^"]*"[^>]*>(.*?)</'}),
    CardRule("board-d", r'(?i)<div[^>]*class="[^"]*\bjob-link\b', r'href="(/jobs/\d+/)"', "https://board-d.example", "",
             {"posted_raw": r'title="[^"]*(?:вакансія від|вакансия от)\s+([^"]*)"', "company": r'(?is)glyphicon-company.*?<span[^>]*class="strong-600"[^>]*>(.*?)</span>',
              "salary_raw": r'(?is)glyphicon-hryvnia-fill.*?<span[^>]*class="strong-600"[^>]*>(.*?)</span>'}),
)


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_edges(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def visible_text(html: Column, sep: str = " ") -> Column:
    """Text between tags, each piece trimmed, blank pieces dropped."""
    pieces = F.transform(F.split(html, r"(?s)<!--.*?-->|<[^>]*>"), lambda p: strip_edges(unescape(p)))
    return F.array_join(F.filter(pieces, lambda p: p != ""), sep)


def one_line(c: Column) -> Column:
    return strip_edges(F.regexp_replace(c, r"(?U)\s+", " "))


def extract_cards(pages: DataFrame, rule: CardRule, page_id: str = "page_id") -> DataFrame:
    """One row per card; of two cards of a page with one url the first stays."""
    blocks = F.split(F.col("html"), rule.block)
    d = pages.select(page_id, F.posexplode(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("pos", "card"))
    href = F.regexp_extract("card", rule.url, 1)
    anchor = rf'(?is)<a[^>]*{rule.url}[^>]*>(.*?)</a>'
    title = F.regexp_extract("card", rule.title, 1) if rule.title else F.regexp_extract("card", anchor, 2)
    got = {name: one_line(visible_text(F.regexp_extract("card", rx, 1))) for name, rx in rule.fields.items()}
    d = d.where(href != "").select(
        page_id, "pos", F.lit(rule.source).alias("source"), one_line(visible_text(title)).alias("title"),
        F.when(href.startswith("/"), F.concat(F.lit(rule.base), href)).otherwise(href).alias("url"),
        *[got.get(n, F.lit("")).alias(n) for n in ("company", "posted_raw", "salary_raw")],
        F.substring(one_line(visible_text(F.concat(F.lit("<x "), F.col("card")))), 1, SNIPPET_CHARS).alias("snippet"))
    return first_per_url(d, [page_id], ["pos"])


def first_per_url(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*group, "url")]
    first = rows.groupBy(*group, "url").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*group, "url", "r.*")


def union_sources(found: dict[str, DataFrame | None]) -> tuple[DataFrame, dict[str, str]]:
    """Rows of all sources with query_no and pos, first of each (source, url); a failed source (None) only has a status."""
    out, status = None, {}
    for name, rows in found.items():
        status[name] = "недоступне" if rows is None else "OK"
        if rows is not None:
            out = rows if out is None else out.unionByName(rows)
    return first_per_url(out, ["source"], ["query_no", "pos"]), status


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "source") -> DataFrame:
    """Rows of the primary feed; sources it has nothing for come from the fallback."""
    have = primary.select(key).distinct()
    return primary.unionByName(fallback.join(have, key, "left_anti"))


def gig_cards(cards: DataFrame) -> DataFrame:
    """Bids and budget out of the text of a gig card."""
    return cards.withColumn("bids_count", card_bids(F.col("snippet"))).withColumn("budget_raw", card_budget(F.col("snippet")))


def channel_posts(pages: DataFrame, channel: str = "channel") -> DataFrame:
    """Posts of a stored channel page: id, time, views, text with line breaks and external links at the end."""
    blocks = F.split("html", r'<div[^>]*class="tgme_widget_message(?=[ "])')
    d = pages.select(channel, F.explode(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("b"))
    body = F.regexp_extract("b", r'(?s)<div[^>]*class="[^"]*tgme_widget_message_text[^"]*"[^>]*>(.*?)</div>', 1)
    hrefs = F.array_distinct(F.filter(F.regexp_extract_all(body, F.lit(r'<a[^>]*href="([^"]*)"'), F.lit(1)), lambda h: h.startswith("http") & ~h.contains("t.me/")))
    links = F.when(F.size(hrefs) > 0, F.concat(F.lit("\nПосилання: "), F.array_join(hrefs, " "))).otherwise("")
    views = F.regexp_extract("b", r'(?s)<span[^>]*class="[^"]*tgme_widget_message_views[^"]*"[^>]*>(.*?)</span>', 1)
    out = d.select(channel, F.regexp_extract("b", r'^[^>]*data-post="[^"]*/(\d+)"', 1).try_cast("long").alias("post_id"),
                   F.nullif(F.regexp_extract("b", r'<time[^>]*datetime="([^"]*)"', 1), F.lit("")).alias("datetime"),
                   parse_views(one_line(visible_text(views))).alias("views"), F.concat(visible_text(body, "\n"), links).alias("text"))
    return out.where(F.col("post_id").isNotNull() & F.col("datetime").isNotNull())


def main_text(html: Column) -> Column:
    """All text of the body without navigation, scripts and the like, on one line."""
    for tag in NOISE_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    # an unclosed body reaches to the end of the page
    body = F.regexp_replace(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)$", 1), r"(?is)</body\s*>.*$", "")
    return one_line(visible_text(F.when(body != "", body).otherwise(html)))


def page_text(html: Column, container: str | None = None, least: int = 0, most: int | None = None) -> Column:
    """The text of the container when it has more than 200 characters, else of the body. Null under `least` characters; cut
    after `most` only where that is given."""
    text = main_text(html)
    if container:
        inner = main_text(F.regexp_extract(html, container, 1))
        text = F.when(F.length(inner) > MIN_TEXT_CHARS, inner).otherwise(text)
    return F.when(F.length(text) >= least, text if most is None else F.substring(text, 1, most))


def embedded_objects(pages: DataFrame, keyword: str, schema: str, page_id: str = "page_id") -> DataFrame:
    """JSON objects with a title inside scripts that mention the keyword; malformed ones are skipped."""
    scripts = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), lambda s: F.lower(s).contains(keyword))
    found = pages.select(page_id, F.explode(scripts).alias("s"))
    # an object without objects inside lies between an opening brace and the next brace, which closes it
    after = F.transform(F.filter(F.split("s", r"\{"), lambda p: p.contains("}") & p.contains('"title"')), lambda p: F.concat(F.lit("{"), F.substring_index(p, "}", 1), F.lit("}")))
    objects = found.select(page_id, F.explode(after).alias("j")).where(F.contains("j", F.lit('"title"')))
    return objects.select(page_id, F.from_json("j", schema, {"mode": "PERMISSIVE"}).alias("o")).where(F.col("o.title").isNotNull()).select(page_id, "o.*")
