"""Queries: pages, JSON, files, grids, mails and table maintenance."""
from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobstrata.functions import dates, numbers, text
from jobstrata.operators import funnel, mail, tables
from jobstrata.operators.scale import running_position
from jobstrata.plans.bindings import ctes, table, view
from jobstrata.plans.registry import query
from jobstrata.session import scratch_path
from jobstrata.sources import documents as docs
from jobstrata.sources import pages

# ---- pages --------------------------------------------------------------------------------------------------
LINKS = pages.CardRule("pages", r"<li>", r'href="([^"]*)"')


@query("s1_listing_cards", r"""SELECT page_id, url, min(title) AS title FROM (SELECT page_id, url, first_value(title) OVER (PARTITION BY page_id, url ORDER BY pos) AS title FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)) AS url, trim(unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2))) AS title, generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1), 1) AS pos FROM pages)) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY page_id, url"))
def _(spark, sf):
    return pages.extract_cards(table(spark, sf, "pages"), LINKS).select("page_id", "url", "title")


_UN = "replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


def _main_sql(h):
    for t in pages.NOISE_TAGS:
        h = rf"regexp_replace({h}, '(?is)<{t}\b.*?</{t}\s*>', ' ', 'g')"
    body = rf"regexp_replace(regexp_replace({h}, '(?is)^.*?<body[^>]*>', ''), '(?is)</body>.*$', '')"
    return rf"trim(regexp_replace({_UN.format(x=f'''regexp_replace({body}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')''')}, '\s+', ' ', 'g'))"


@query("s3_z4_main_text", f"SELECT page_id, length(t) AS n_chars, CASE WHEN length(t) >= 200 THEN t[1:6000] END AS text, t AS full_text FROM (SELECT page_id, {_main_sql('html')} AS t FROM pages)")
def _(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.length(pages.main_text(F.col("html"))).cast("bigint").alias("n_chars"), pages.page_text(F.col("html"), least=pages.MIN_TEXT_CHARS, most=pages.MAX_TEXT_CHARS).alias("text"), pages.page_text(F.col("html")).alias("full_text"))


def feed_pages(spark, sf):
    """Every document as a post of a stored channel page."""
    d = table(spark, sf, "documents")
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    link = F.when(F.col("doc_id") % 3 == 0, F.format_string('<a href="https://apply.example/%s">Apply</a><a href="https://t.me/hr">HR</a>', F.col("doc_id"))).otherwise("")
    views = F.when(F.col("doc_id") % 2 == 0, F.concat((F.col("n_chars") / 1000).cast("decimal(10,1)").cast("string"), F.lit("K"))).otherwise(F.col("n_chars").cast("string"))
    html = F.concat(F.lit('<section><div class="tgme_widget_message js-widget_message" data-post="'), "source", F.lit("/"), F.when(F.col("doc_id") % 50 == 7, "none").otherwise(F.col("doc_id").cast("string")),
                    F.lit('"><div class="tgme_widget_message_text js-message_text" dir="auto">'), esc, link, F.lit('</div><span class="tgme_widget_message_views">'), views,
                    F.lit('</span><a class="tgme_widget_message_date"><time datetime="2026-09-26T14:00:00+00:00">14:00</time></a></div></section>'))
    return d.select(F.col("source").alias("channel"), html.alias("html"))


@query("s2_x13_channel_posts", r"""SELECT source AS channel, doc_id AS post_id, '2026-09-26T14:00:00+00:00' AS datetime, CASE WHEN doc_id % 2 = 0 THEN CAST(round_even(CAST(CAST(CAST(n_chars AS DOUBLE) / 1000 AS DECIMAL(10,1)) AS DOUBLE) * 1000, 0) AS BIGINT) ELSE n_chars END AS views,
  array_to_string(list_filter([regexp_replace(text, '^\s+|\s+$', '', 'g'), CASE WHEN doc_id % 3 = 0 THEN 'Apply' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN 'HR' ELSE '' END], lambda x: x <> ''), chr(10)) || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Посилання: https://apply.example/' || doc_id ELSE '' END AS text
FROM documents WHERE doc_id % 50 <> 7""")
def _(spark, sf):
    return pages.channel_posts(feed_pages(spark, sf))


@query("s4_job_documents", ctes("cards") + """SELECT title, company, 'https://board-c.example' || CASE WHEN card_id % 5 = 0 OR client_id = 0 THEN '' ELSE '/company' || client_id END || '/vacancy' || card_id AS url, CAST(run_date AS STRING) AS posted_raw,
  CASE WHEN card_id % 4 = 0 THEN '' ELSE CAST(CAST(floor(price) AS BIGINT) AS STRING) END AS salary_raw, 'Київ | ' || snippet AS snippet FROM cards WHERE card_id % 9 <> 4 AND card_id <> 0""")
def _(spark, sf):
    c = view(spark, sf, "cards")
    doc = F.struct(F.col("card_id").alias("id"), F.when(F.col("card_id") % 9 == 4, " ").otherwise(F.col("title")).alias("name"), F.col("company").alias("companyName"), F.when(F.col("card_id") % 5 == 0, 0).otherwise(F.col("client_id")).alias("notebookId"),
                   F.col("run_date").alias("date"), F.lit("Київ").alias("cityName"), F.when(F.col("card_id") % 4 == 0, 0).otherwise(F.floor("price")).alias("salary"), F.concat(F.lit("<p>"), "snippet", F.lit("</p>")).alias("shortDescription"))
    payload = F.when(F.col("card_id") % 2 == 0, F.to_json(F.struct(F.array(doc).alias("documents")))).otherwise(F.to_json(F.struct(F.array(doc).alias("vacancies"))))
    return docs.job_documents(c.select(payload.alias("payload")), "https://board-c.example")


@query("s5_gig_items", ctes("gigs") + """SELECT gig_id, title, CASE WHEN gig_id % 6 = 0 THEN 'https://gigs.example/project/' || gig_id || '.html' ELSE url END AS url, CAST(run_date AS STRING) AS posted_raw, CASE WHEN gig_id % 7 <> 0 THEN bids_count END AS bids_count,
  CASE WHEN gig_id % 4 = 1 THEN '' ELSE CAST(user_id AS STRING) || ' UAH' END AS budget_raw, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM gigs""")
def _(spark, sf):
    g = view(spark, sf, "gigs")
    attrs = F.struct(F.col("title").alias("name"), F.lit("d").alias("description"), F.when(F.col("gig_id") % 4 != 1, F.struct(F.col("user_id").alias("amount"), F.lit("UAH").alias("currency"))).alias("budget"),
                     F.when(F.col("gig_id") % 7 == 0, "many").otherwise(F.col("bids_count").cast("string")).alias("bid_count"), F.col("run_date").alias("published_at"))
    item = F.struct(F.col("gig_id").alias("id"), attrs.alias("attributes"), F.struct(F.struct(F.when(F.col("gig_id") % 6 != 0, F.col("url")).alias("web")).alias("self")).alias("links"))
    d = docs.gig_items(g.select("gig_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(item).alias("payload")), "https://gigs.example")
    return d.select("gig_id", "title", "url", "posted_raw", "bids_count", "budget_raw", "k")


@query("s6_embedded_objects", "SELECT p_partkey AS page_id, p_name AS title, 'https://x.example/' || p_partkey AS url FROM part WHERE p_size % 5 <> 0")
def _(spark, sf):
    p = table(spark, sf, "part")
    key = F.when(F.col("p_size") % 5 == 0, "news").otherwise("vacancies")
    html = F.concat(F.lit("<html><script>var a=1;</script><script>window."), key, F.lit('=[{"title":"'), "p_name", F.lit('","url":"https://x.example/'), F.col("p_partkey").cast("string"), F.lit('"},{"title":broken},{"name":"no title"}]</script></html>'))
    return pages.embedded_objects(p.select(F.col("p_partkey").alias("page_id"), html.alias("html")), "vacanc", "title string, url string").select("page_id", "title", "url")


@query("u1_union_first_url", ctes("gigs") + """SELECT source, url, count(*) OVER () AS total, gig_id AS first_gig FROM (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY q, gig_id) AS r FROM (SELECT *, CASE WHEN category = 'BI' THEN 0 ELSE 1 END AS q FROM gigs)) WHERE r = 1""")
def _(spark, sf):
    g = view(spark, sf, "gigs").select("source", "url", F.col("gig_id").alias("pos"), F.when(F.col("category") == "BI", 0).otherwise(1).alias("query_no"))
    d, _status = pages.union_sources({"a": g.where("query_no = 0"), "b": g.where("query_no = 1"), "c": None})
    n = d.agg(F.count(F.lit(1)).alias("n")).scalar()
    return d.select("source", "url", n.alias("total"), F.col("pos").alias("first_gig"))


@query("u5_fallback", "SELECT source, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'z' || source, doc_id FROM documents WHERE lang = 'fr'")
def _(spark, sf):
    d = table(spark, sf, "documents")
    primary = d.where("lang = 'en'").select("source", "doc_id")
    fallback = d.where("lang = 'fr'").select(F.col("source").alias("source"), "doc_id")
    return pages.with_fallback(primary, fallback.withColumn("source", F.concat(F.lit("z"), "source")).unionByName(fallback))


@query("x12_published_dates", r"""SELECT doc_id, strftime(CASE WHEN doc_id % 2 = 0 THEN DATE '2026-01-01' + CAST(doc_id % 300 AS INTEGER) ELSE CASE WHEN doc_id % 28 + 1 > 15 THEN DATE '2025-11-01' ELSE DATE '2026-11-01' END + CAST(doc_id % 28 AS INTEGER) END, '%Y-%m-%d') AS published FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    structured = F.concat(F.lit('<script>{"datePosted": "'), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string"), F.lit('T10:00"}</script>'), F.replace("text", F.lit("<"), F.lit(" ")))
    said = F.concat(F.lit("<p>Published "), (F.col("doc_id") % 28 + 1).cast("string"), F.when(F.col("doc_id") % 3 == 0, " листопада").otherwise(" November"), F.lit("</p>"), F.replace("text", F.lit("<"), F.lit(" ")))
    html = F.when(F.col("doc_id") % 2 == 0, structured).otherwise(said)
    return d.select("doc_id", dates.day_text(dates.published_date(html, F.lit("2026-11-15"))).alias("published"))


@query("x9_x10_x26_x29_cells", ctes("cards") + r"""SELECT card_id, strftime(run_date, '%Y-%m-%d') AS anywhere, strftime(run_date, '%Y-%m-%d') AS cell, strftime(run_date, '%d.%m.%Y') AS mailed, title, company FROM cards""")
def _(spark, sf):
    c = view(spark, sf, "cards")
    d = F.col("run_date")
    loose = F.when(F.col("card_id") % 2 == 0, F.concat(F.lit("до "), F.date_format(d, "dd.MM.yyyy"), F.lit(" включно"))).otherwise(F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00")))
    cell = F.when(F.col("card_id") % 3 == 0, F.date_format(d, "dd/MM/yyyy")).when(F.col("card_id") % 3 == 1, F.date_format(d, " dd.MM.yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd HH"))
    raw = F.date_format(d, "EEE, d MMM yyyy HH:mm:ss Z")
    label = text.label_of(F.concat(F.col("title"), F.lit("")), F.col("company"))
    return c.select("card_id", dates.day_text(dates.date_anywhere(loose)).alias("anywhere"), dates.day_text(dates.date_cell(cell)).alias("cell"), dates.mail_date(raw).alias("mailed"),
                    text.label_title(label).alias("title"), text.label_company(label).alias("company"))


# ---- files --------------------------------------------------------------------------------------------------
@query("s7_k9_csv_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "orders_csv")
    tables.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return docs.read_csv(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("s8_jsonl_last_record", "SELECT source AS channel, doc_id AS post_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS text FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "raw_posts")
    d = table(spark, sf, "documents").select(F.col("source").alias("channel"), F.col("doc_id").alias("post_id"))
    line = lambda v: F.to_json(F.struct("channel", "post_id", F.lit(v).alias("text")))
    d.select(line("old").alias("value")).unionByName(d.where("post_id % 10 = 0").select(F.lit('{"channel": broken').alias("value"))).write.text(f"{path}/1")
    d.where("post_id % 4 = 0").select(line("new").alias("value")).write.text(f"{path}/2")
    return docs.read_jsonl(spark, path, "channel string, post_id long, text string", ["channel", "post_id"])


@query("s9_pipe_log", ctes("shown_log") + "SELECT shown_date, identifier, label || ' | x' AS label, count(*) AS n FROM shown_log GROUP BY ALL")
def _(spark, sf):
    from jobstrata.operators.known import parse_pipe_log
    s = view(spark, sf, "shown_log")
    lines = s.select(F.explode(F.array(F.concat_ws(" | ", "shown_date", "identifier", "label", F.lit("x")), F.lit(""), F.lit("header without pipes"), F.concat("shown_date", F.lit(" | short")))).alias("value"))
    return parse_pipe_log(lines).groupBy("shown_date", "identifier", "label").agg(F.count(F.lit(1)).alias("n"))


@query("s10_daily_logs", ctes("cards") + "SELECT card_id, mark AS result FROM cards")
def _(spark, sf):
    root = scratch_path(spark, "logs")
    c = view(spark, sf, "cards").select("card_id", F.col("mark").alias("result"), F.year("run_date").alias("y"))
    c.write.partitionBy("y").options(header=True).csv(f"{root}/days")
    c.select("card_id").limit(0).write.options(header=True).csv(f"{root}/other")
    return docs.read_daily_logs(spark, root, "card_id long, result string", "result")


@query("s11_s16_rows_by_headers", ctes("applied") + "SELECT row_no + 2 AS row_no, url, company, status, '' AS nothing FROM applied")
def _(spark, sf):
    """The table of applications as a grid: a merged title row, the header row, then the data."""
    a = view(spark, sf, "applied").select((F.col("row_no") + 2).alias("row_no"), F.array(F.lit("x"), F.concat(F.lit(" "), "company"), "url", "status").alias("cells"))
    head = spark.sql("SELECT CAST(id AS BIGINT) AS row_no, CASE id WHEN 0 THEN array('Interview') ELSE array('№', 'company', ' url', 'status ') END AS cells FROM range(2)")
    return docs.rows_by_headers(head.unionByName(a), ["url", "company", "status", "nothing"])


@query("s12_last_rows", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def _(spark, sf):
    return docs.last_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 50)


@query("s13_latest_messages", ctes("mails") + "SELECT thread_id, max(message_no) AS message_no, arg_max(sender, message_no) AS sender, arg_max(subject, message_no) AS subject FROM mails GROUP BY ALL")
def _(spark, sf):
    m = view(spark, sf, "mails")
    headers = F.array(F.struct(F.lit("Date").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("FROM").alias("name"), F.col("sender").alias("value")), F.struct(F.lit("subject").alias("name"), F.col("subject").alias("value")))
    d = docs.latest_messages(m.select("thread_id", "message_no", headers.alias("h")))
    return d.select("thread_id", "message_no", docs.header_value(F.col("h"), "From").alias("sender"), docs.header_value(F.col("h"), "Subject").alias("subject"))


@query("s15_classified_baseline", ctes("posts", "mentions") + "SELECT channel, post_id, post_id IN (SELECT post_id FROM mentions) AS is_vacancy FROM posts WHERE classified <> 'False'")
def _(spark, sf):
    return docs.classified_baseline(view(spark, sf, "posts"), view(spark, sf, "mentions"))


@query("o1_o2_o5_source_order", ctes("cards") + "SELECT card_id, source, row_number() OVER (ORDER BY CASE source WHEN 'board-d' THEN 0 WHEN 'board-a' THEN 1 ELSE 2 END, source, card_id DESC) AS place FROM cards")
def _(spark, sf):
    """Every card with its place in the report order."""
    rank, _ = docs.source_order(F.col("source"), ["board-d", "board-a"])
    cards = view(spark, sf, "cards").select("card_id", "source", (-F.col("card_id")).alias("pos"))
    sizes = cards.groupBy("source").agg(F.count(F.lit(1)).alias("n"))  # one row per source
    before = Window.orderBy(rank, "source").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = running_position(cards, ["source"], "pos", 10_000, "inside")
    return placed.join(offsets, "source").select("card_id", "source", (F.col("offset") + F.col("inside")).cast("long").alias("place"))


@query("o4_newest_threads", ctes("mails") + "SELECT thread_id, true AS truncated FROM (SELECT DISTINCT thread_id FROM mails) ORDER BY thread_id DESC LIMIT 50")
def _(spark, sf):
    threads = view(spark, sf, "mails").select("thread_id").distinct()
    top, more = docs.newest(threads, [F.desc("thread_id")], 50)
    return top.withColumn("truncated", more)


@query("o3_top_skills", ctes("mentions") + "SELECT skill, n FROM (SELECT skill, count(*) AS n, min((ts, post_id, vacancy_idx, part_id, supp_id, i)) AS f FROM (SELECT ts, post_id, vacancy_idx, part_id, supp_id, trim(unnest(string_split(skills, ';'))) AS skill, "
       "generate_subscripts(string_split(skills, ';'), 1) AS i FROM mentions) WHERE skill <> '' GROUP BY skill) ORDER BY n DESC, f LIMIT 20")
def _(spark, sf):
    s = view(spark, sf, "mentions").select("ts", "pos", F.posexplode(text.split_list(F.col("skills"))).alias("i", "skill"))
    return s.groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "pos", "i")).alias("first")).orderBy(F.desc("n"), "first").limit(20).drop("first")


@query("f12_x24_coerced_records", ctes("cards") + """SELECT card_id, CASE WHEN lower(mark) = 'f' THEN 'qa' WHEN price > 200000 THEN 'other-it' ELSE 'non-it' END AS direction, price > 200000 AS is_it, CASE WHEN priority = '5-LOW' THEN 'junior' ELSE 'unspecified' END AS level FROM cards""")
def _(spark, sf):
    from jobstrata.operators import records
    c = view(spark, sf, "cards")
    raw = c.select("card_id", F.col("title").alias("title"), F.col("company"), (F.col("price") > 200000).alias("is_it"), F.when(F.col("mark") == "F", " QA ").otherwise(F.col("mark")).alias("direction"),
                   F.when(F.col("priority") == "5-LOW", "Junior").otherwise(F.col("priority")).alias("level"), F.lit("On-site").alias("work_format"), F.array("snippet", F.lit(" ")).alias("skills"), F.lit("YEAR").alias("salary_period"))
    return records.coerce(raw).select("card_id", "direction", "is_it", "level")


@query("f13_f14_period", ctes("cards") + """SELECT count(*) FILTER (source <> 'board-b') AS kept, count(*) FILTER (source = 'board-b') AS other_system FROM cards WHERE coalesce(CASE WHEN posted_raw LIKE '____-__-__T%' THEN CAST(posted_raw[1:10] AS DATE) END, run_date) BETWEEN DATE '1996-03-01' AND DATE '1999-03-31'""")
def _(spark, sf):
    from jobstrata.operators import records
    return records.in_period(view(spark, sf, "cards"), "posted_raw", "run_date", "1996-03-01", "1999-03-31", r"(?i)board-b")


@query("f20_k7_decision_log", ctes("cards") + "SELECT strftime(run_date, '%Y') AS year, source, count(*) AS rows FROM cards WHERE mark <> 'F' GROUP BY ALL")
def _(spark, sf):
    from jobstrata.operators import records
    path = scratch_path(spark, "decisions")
    c = view(spark, sf, "cards").select("card_id", "source", F.date_format("run_date", "yyyy").alias("run_date"), F.lit(0).alias("run_index"), F.when(F.col("mark") == "F", "ПІДСУМОК").otherwise("показано").alias("result"))
    tables.write_decisions(c, path)
    stored = spark.read.schema("card_id long, source string, result string, run_date string, run_index int").parquet(f"{path}/rows")
    return records.data_rows(stored).groupBy(F.col("run_date").alias("year"), "source").agg(F.count(F.lit(1)).alias("rows"))


_YEARS = ("d", "SELECT *, strftime(run_date, '%Y') AS day, CASE source WHEN 'board-c' THEN 0 WHEN 'board-a' THEN 1 ELSE 2 END AS rank FROM cards")


@query("k7_log_in_order", ctes("cards", _YEARS) + """SELECT day, run_index, row_no, source, label FROM (
  SELECT day, row_number() OVER (PARTITION BY day ORDER BY rank, source, card_id) AS row_no, source, title AS label FROM d
  UNION ALL SELECT day, count(*) + 1, 'ПІДСУМОК', 'знайдено ' || count(*) FROM d GROUP BY day), (VALUES (0), (1)) r(run_index)""")
def _(spark, sf):
    """Written twice, as by a repeated run. The label of a summary row is its text here."""
    path = scratch_path(spark, "log")
    c = view(spark, sf, "cards").select(F.date_format("run_date", "yyyy").alias("run_date"), "source", F.col("title").alias("label"), F.lit("показано").alias("result"),
                                        F.lit("—").alias("code"), F.lit("").alias("detail"), "card_id")
    for _ in range(2):
        tables.write_log(c, ["board-c", "board-a"], path, F.concat(F.lit("знайдено "), F.count(F.lit(1)).cast("string")))
    d = tables.read_log(spark, path)
    return d.select(F.col("run_date").alias("day"), "run_index", "row_no", "source", F.when(F.col("result") == tables.SUMMARY, F.col("detail")).otherwise(F.col("label")).alias("label"))


@query("f22_x25_company_names", ctes("shown_log") + r"SELECT DISTINCT part_id, supp_id, 'Supplier#' || lpad(CAST(supp_id AS STRING), 9, '0') AS company FROM shown_log")
def _(spark, sf):
    s = view(spark, sf, "shown_log").select("part_id", "supp_id").distinct()
    files = s.withColumn("name", F.concat(F.lit("CV_Data-Analyst_"), F.format_string("Supplier#%09d", F.col("supp_id")), F.lit("_v2.1_2026.pdf"))).withColumn("mime", F.lit("application/pdf"))
    # a company is told from the name alone, so each name is read once
    return files.join(mail.company_names(files.select("name", "mime").distinct()), "name").select("part_id", "supp_id", "company")


# ---- mails --------------------------------------------------------------------------------------------------
_NAMED = "(role = 'assistant' AND conv_id % 300 IN (SELECT s_suppkey FROM supplier))"


@query("j14_f16_a30_mail_relevance", f"""SELECT count(*) AS total, count(*) FILTER (role = 'user') AS hr, count(*) FILTER (known) AS known_company, count(*) FILTER (length(text) > 20) AS threads_loaded, count(*) FILTER (length(text) <= 20) AS threads_skipped
FROM (SELECT *, {_NAMED} AS known FROM conversations) WHERE role = 'user' OR known OR length(text) % 2 = 0""")
def _(spark, sf):
    from jobstrata.operators.monitor import mail_counters
    m = view(spark, sf, "mails")
    known = mail.known_senders(m, table(spark, sf, "supplier").select(F.col("s_name").alias("company"))).withColumn("from_known", F.lit(True))
    m = m.join(known, "sender", "left").withColumn("from_known", F.coalesce("from_known", F.lit(False))).withColumn("from_hr", text.from_hr(F.col("sender")))
    kept = m.where(mail.relevant(F.length("body") % 2 == 0, F.col("sender"), F.col("from_known")))
    return mail_counters(kept.withColumn("loaded", F.length("body") > 20))


@query("f17_x25_mail_candidates", r"SELECT conv_id AS thread_id, turn AS message_no, CASE role WHEN 'user' THEN 'supplier' || (conv_id % 40) || '.example' WHEN 'assistant' THEN 'mail.example' ELSE 'boards.example' END AS domain FROM conversations WHERE (regexp_matches(lower(text), 'вакансія|співбесіда|candidate|interview|resume|application') OR role = 'user') AND turn >= 1")
def _(spark, sf):
    m = view(spark, sf, "mails")
    sent = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("message_no") * 86_400)
    now = F.timestamp_seconds(F.lit(1_700_000_000 + 3 * 86_400))
    m = m.where(mail.candidate(F.col("body"), F.col("sender"), F.lit(False), sent, now))
    return m.select("thread_id", "message_no", text.sender_domain(F.col("sender")).alias("domain"))


@query("j15_k12_application_updates")
def _(spark, sf):
    applied = view(spark, sf, "applied")
    mails = view(spark, sf, "mails").select((F.col("thread_id") * 1000 + F.col("message_no")).alias("mail_id"), "sender", "subject", F.lit("Tue, 3 Nov 2026 10:00:00 +0200").alias("date"), "status")
    return mail.apply_updates(applied, mail.plan_updates(applied, mails))


# ---- table maintenance ---------------------------------------------------------------------------------------
@query("k1_k13_append", "SELECT event_type AS source, count(*) * 2 AS rows, CAST(sum(event_id) * 2 AS BIGINT) AS ids FROM events GROUP BY ALL")
def _(spark, sf):
    path = scratch_path(spark, "source_runs")
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("source"))
    for _n in range(2):
        tables.append_strict(e, path, ["event_id", "source"])
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))


@query("k2_u3_q8_schema_evolution", "SELECT o_orderkey, CAST(NULL AS STRING) AS note, o_orderstatus FROM orders")
def _(spark, sf):
    return tables.evolve_schema(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey", "note", "o_orderstatus"])


@query("k3_append_unseen", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, sf):
    stored = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.unseen(tables.unseen(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), None, ["l_orderkey", "l_suppkey"]).join(stored, "l_orderkey", "left_anti"), None, ["l_orderkey", "l_suppkey"])


@query("k4_upsert", """SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new' ELSE 'old' END AS v, CASE WHEN c_mktsegment = 'BUILDING' THEN 'updated' ELSE 'kept' END AS action FROM customer
UNION ALL SELECT -1 - c_custkey, 'new', 'appended' FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    old = c.select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    new = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), F.lit("new").alias("v")).unionByName(c.where("c_mktsegment = 'MACHINERY'").select((-1 - F.col("c_custkey")).alias("k"), F.lit("new").alias("v")))
    return tables.upsert(old, new, ["k"])


@query("k6_retention", ctes("shown_log") + "SELECT shown_date, count(*) AS n FROM (SELECT shown_date FROM shown_log WHERE CAST(shown_date AS DATE) >= DATE '2000-06-01' - 21 UNION ALL SELECT '2000-06-01' FROM customer) GROUP BY ALL")
def _(spark, sf):
    log = view(spark, sf, "shown_log").select("shown_date").unionByName(table(spark, sf, "nation").select(F.lit("broken").alias("shown_date")))
    new = table(spark, sf, "customer").select(F.lit("2000-06-01").alias("shown_date"))
    return tables.retain(log, F.lit("2000-06-01").cast("date"), 21, new).groupBy("shown_date").agg(F.count(F.lit(1)).alias("n"))


@query("k4_k6_stored_ledger", """SELECT strftime(run_date, '%Y-%m-%d') AS run_date, status, count(*) AS n, sum(k)::BIGINT AS keys FROM (
  SELECT date_trunc('month', o_orderdate) AS run_date, o_orderkey AS k, CASE WHEN year(o_orderdate) = 1995 AND o_orderstatus <> 'P' THEN 'changed' ELSE o_orderstatus END AS status FROM orders
  UNION ALL SELECT DATE '1997-02-01', -1 - c_custkey, 'new' FROM customer) WHERE run_date >= DATE '1998-08-01' - 1300 GROUP BY ALL""")
def _(spark, sf):
    """Rows of 1995 change, rows of one month are added, and what is older than 1300 days goes."""
    path = scratch_path(spark, "ledger")
    o = table(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("run_date"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    schema = "k long, status string, run_date date"
    tables.upsert_days(spark, path, schema, o, ["k"], "run_date")
    changed = o.where("year(run_date) = 1995 AND status <> 'P'").withColumn("status", F.lit("changed"))
    added = table(spark, sf, "customer").select(F.lit("1997-02-01").cast("date").alias("run_date"), (-1 - F.col("c_custkey")).alias("k"), F.lit("new").alias("status"))
    tables.upsert_days(spark, path, schema, changed.unionByName(added), ["k"], "run_date")
    tables.retain_days(spark, path, "run_date", date(1998, 8, 1), 1300)
    d = spark.read.schema(schema).parquet(path)
    return d.groupBy(dates.day_text(F.col("run_date")).alias("run_date"), "status").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


@query("k8_dead_letters", """SELECT 'metrics' AS kind, repeat('x', 200) AS reason, '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}' AS row_json FROM supplier""")
def _(spark, sf):
    return tables.dead_letters(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "metrics", F.lit("x" * 300))


@query("k10_q9_snapshot", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, count(*) AS stored, true AS ok FROM {t}" for t in ("orders", "customer", "events", "documents")))
def _(spark, sf):
    return tables.snapshot(spark, {t: table(spark, sf, t) for t in ("orders", "customer", "events", "documents")}, "snapshot")


@query("k11_recovery", "SELECT l_returnflag AS channel, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) GROUP BY ALL")
def _(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("channel"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus")
    begun = o.select("run_id", F.lit("A").alias("channel"), F.lit("begin").alias("state"))
    done = o.where("o_orderstatus <> 'P'").select("run_id", F.lit("A").alias("channel"), F.lit("finish").alias("state"))
    return tables.recover_pending(t, tables.pending_commits(begun.unionByName(done))).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("j20_t6_backfill", """SELECT source AS channel, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS missing, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS saved FROM documents GROUP BY ALL""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("channel"), F.col("doc_id").alias("post_id"))
    gone = table(spark, sf, "labels").select(F.col("doc_id").alias("post_id"))
    fetched = d.join(gone, "post_id", "left_anti").unionByName(d.select(F.lit("elsewhere").alias("channel"), "post_id"))
    _saved, report = tables.backfill(fetched, d)
    return report.select("channel", "missing", "saved")
