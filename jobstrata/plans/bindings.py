"""Canonical views over the driver's tables. Each view is one SELECT in the SQL both engines share.

Every view keeps all rows of its tables: attributes are computed, rows are never sampled.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

KIND = "CASE p_size % 10 WHEN 3 THEN 'Graphic ' WHEN 5 THEN 'UX motion ' WHEN 7 THEN 'MEAL ' WHEN 9 THEN 'Data analyst ' ELSE '' END"
DIRECTION = ("CASE p_type WHEN 'ECONOMY' THEN 'analytics' WHEN 'SMALL' THEN 'design' WHEN 'MEDIUM' THEN 'marketing' "
             "WHEN 'PROMO' THEN 'qa' WHEN 'STANDARD' THEN 'dev' ELSE 'ai-ml' END")

VIEWS: dict[str, str] = {
    # one posting mentioned in one channel post
    "mentions": f"""
SELECT 'ch' || lpad(CAST(l_orderkey % 25 AS STRING), 2, '0') AS channel,
       l_orderkey AS post_id, l_linenumber AS vacancy_idx, l_partkey AS part_id, l_suppkey AS supp_id,
       l_shipdate + INTERVAL '1' HOUR * l_linenumber AS ts,
       CASE l_linenumber WHEN 1 THEN 'Junior ' WHEN 2 THEN 'Senior ' WHEN 3 THEN 'Стажер ' ELSE '' END
         || {KIND} || p_name || ' (' || p_brand || ')' AS title,
       CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE s_name END AS company,
       p_size > 15 AS is_it,
       {DIRECTION} AS direction,
       CASE WHEN l_quantity <= 10 THEN 'intern' WHEN l_quantity <= 20 THEN 'junior' WHEN l_quantity <= 27 THEN 'middle'
            WHEN l_quantity <= 32 THEN 'senior' WHEN l_quantity <= 35 THEN 'lead' ELSE 'unspecified' END AS level,
       CASE WHEN l_tax >= 0.045 THEN NULL ELSE round(l_discount * 30) / 2 END AS experience_years_min,
       CASE WHEN l_quantity > 45 THEN ''
            ELSE CASE WHEN l_linenumber % 3 = 0 THEN upper(p_type) ELSE lower(p_type) END || '; '
              || CASE WHEN l_linenumber % 2 = 0 THEN p_name ELSE upper(p_name) END
              || CASE p_brand WHEN 'Brand#1' THEN '; postgres' WHEN 'Brand#2' THEN '; PowerBI' WHEN 'Brand#3' THEN '; MS Excel'
                              WHEN 'Brand#4' THEN '; SQL' WHEN 'Brand#5' THEN '; UML; SQL' ELSE '' END END AS skills,
       CASE l_returnflag WHEN 'A' THEN 'remote' WHEN 'N' THEN 'hybrid' ELSE 'unspecified' END AS work_format,
       l_discount > 0.055 AS salary_stated,
       CASE WHEN l_discount > 0.055 AND l_linenumber <> 7 THEN l_extendedprice / 20 END AS salary_min,
       CASE WHEN l_discount > 0.055 THEN l_extendedprice / 10 END AS salary_max,
       CASE l_linestatus WHEN 'F' THEN 'USD' ELSE 'UAH' END AS salary_currency,
       CASE WHEN l_linenumber <= 4 THEN 'month' WHEN l_linenumber = 5 THEN 'hour' ELSE 'project' END AS salary_period,
       CASE WHEN l_linenumber % 4 = 0 THEN 'https://www.jobs.example/vacancy' || CAST(l_orderkey AS STRING) || '?utm_source=feed' END AS link
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey""",

    # the ledger of channel posts: one per order
    "posts": """
SELECT 'ch' || lpad(CAST(o_orderkey % 25 AS STRING), 2, '0') AS channel, o_orderkey AS post_id, o_orderdate AS ts,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE CAST(floor(o_totalprice / 100) AS BIGINT) END AS views,
       CASE o_orderstatus WHEN 'P' THEN '' WHEN 'F' THEN 'True' ELSE CASE WHEN o_totalprice > 400000 THEN 'False' ELSE 'True' END END AS classified,
       o_totalprice > 150000 AS is_vacancy
FROM {orders}""",

    # the registry of channels
    "channels": """
SELECT 'ch' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS handle,
       CASE n_regionkey WHEN 0 THEN 'core' WHEN 1 THEN 'core' WHEN 2 THEN 'secondary' ELSE 'reference' END AS panel,
       CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE 15 + n_nationkey END AS max_pages,
       CASE WHEN n_regionkey <= 2 THEN 'junior' WHEN n_regionkey = 3 THEN '' ELSE 'general' END AS orientation
FROM {nation}""",

    # one card of a job board, found by one run (a run a day)
    "cards": f"""
SELECT o_orderkey AS card_id, CAST(o_orderdate AS DATE) AS run_date,
       CASE o_orderkey % 4 WHEN 0 THEN 'board-a' WHEN 1 THEN 'board-b' WHEN 2 THEN 'board-c' ELSE 'board-d' END AS source,
       CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_totalprice > 250000 THEN 'Senior ' ELSE 'Junior/Middle ' END
                            WHEN '5-LOW' THEN 'Junior ' ELSE '' END || {KIND} || p_name AS title,
       CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE
         CASE o_orderkey % 3 WHEN 0 THEN 'ТОВ ' ELSE '' END || 'Supplier#' || lpad(CAST(o_orderkey % 100 AS STRING), 9, '0')
         || CASE o_orderkey % 3 WHEN 1 THEN ' LLC' ELSE '' END END AS company,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL
            WHEN o_orderkey % 4 = 1 THEN 'https://board-b.example/jobs?id=' || CAST(o_orderkey AS STRING)
            ELSE 'http://jobs.example/vacancy' || CAST(o_orderkey AS STRING) || '/' END AS url,
       CASE CAST(floor(o_totalprice) AS BIGINT) % 8
         WHEN 0 THEN '' WHEN 1 THEN 'сьогодні' WHEN 2 THEN 'вчора' WHEN 3 THEN '10h ago' WHEN 4 THEN '3 дн. тому'
         WHEN 5 THEN 'updated 1 day ago' WHEN 6 THEN '2 тиж. тому' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T09:00' END AS posted_raw,
       CASE WHEN o_orderkey % 13 = 0 THEN 'people with disabilities welcome' ELSE p_type || ' ' || p_brand END AS snippet,
       o_totalprice AS price, o_orderstatus AS mark, o_orderpriority AS priority, o_custkey AS client_id
FROM {{orders}} JOIN {{part}} ON o_custkey = p_partkey""",

    # lines of the log of shown postings
    "shown_log": """
SELECT CAST(CAST(l_shipdate AS DATE) AS STRING) AS shown_date,
       CASE WHEN l_linenumber = 1 THEN '(без прямого URL, board-a)'
            ELSE 'https://www.jobs.example/vacancy' || CAST(l_orderkey * 40 + l_linenumber AS STRING) || '?from=log' END AS identifier,
       p_name || ' — Supplier#' || lpad(CAST(l_suppkey AS STRING), 9, '0') AS label,
       l_orderkey AS log_order, l_linenumber AS log_line, l_partkey AS part_id, l_suppkey AS supp_id
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",

    # the hand-kept table of applications
    "applied": """
SELECT c_custkey AS row_no,
       CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE 'https://board-b.example/jobs?id=' || CAST(c_custkey * 4 + 1 AS STRING) END AS url,
       'Supplier#' || lpad(CAST(c_custkey % 100 AS STRING), 9, '0') AS company,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'відмова' WHEN 'MACHINERY' THEN 'на розгляді' ELSE '' END AS status,
       CASE WHEN c_acctbal > 5000 THEN 'blue bolt, red ring' ELSE '' END AS notes
FROM {customer}""",

    # evaluations of the cards, flattened
    "evaluations": """
SELECT o_orderkey AS card_id,
       o_totalprice > 120000 AS passes_criteria,
       CASE CAST(floor(o_totalprice) AS BIGINT) % 5 WHEN 0 THEN 'роль' WHEN 1 THEN 'досвід' WHEN 2 THEN 'формат' WHEN 3 THEN NULL ELSE 'ЗП' END AS reject_code,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'r' || CAST(o_orderkey % 10 AS STRING) END AS reject_reason,
       CASE o_orderkey % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' ELSE NULL END AS match_level,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 7) AS BIGINT) % 4 END AS score_skills,
       CAST(floor(o_totalprice / 11) AS BIGINT) % 3 AS score_duties,
       CAST(floor(o_totalprice / 13) AS BIGINT) % 3 AS score_expectations,
       o_orderkey % 9 = 0 AS veteran_bonus, o_orderkey % 6 = 0 AS near_miss,
       CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'скоро'
            ELSE CAST(CAST(o_orderdate AS DATE) - CAST(o_custkey % 3 AS INT) AS STRING) END AS posted_date,
       o_orderkey % 10 = 3 AS date_undetermined,
       o_orderkey % 31 = 0 AS omitted, o_orderkey % 29 = 0 AS failed
FROM {orders}""",

    # gig posts of a freelance board
    "gigs": """
SELECT event_id AS gig_id, CAST(ts AS DATE) AS run_date,
       CASE WHEN event_type = 'view' THEN 'messenger' ELSE 'gig-board' END AS source,
       CASE event_type WHEN 'click' THEN 'BI' WHEN 'error' THEN 'ERP' WHEN 'purchase' THEN 'SQL' ELSE 'Telegram' END AS category,
       CASE WHEN user_id % 9 = 0 THEN 'Звіт з BAS ' WHEN user_id % 9 = 1 THEN 'ERP модуль ' WHEN user_id % 9 = 2 THEN 'Налаштувати 1С: склад ' ELSE 'Dashboard ' END
         || event_type AS title,
       'https://gigs.example/project/' || CAST(user_id * 100 + event_id % 97 AS STRING) AS url,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value * 3) AS INT) % 60 END AS bids_count,
       CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN CAST(CAST(floor(value * 10) AS INT) AS STRING) || ' USD'
            ELSE CAST(CAST(floor(value * 100) AS INT) AS STRING) || ' UAH' END AS budget_raw,
       props, user_id, value, ts, event_type
FROM {events}""",

    # calls of an external evaluator with their token counts
    "usage": """
SELECT event_id AS call_id, CAST(ts AS DATE) AS run_date, ts,
       CASE event_type WHEN 'click' THEN 'cards' WHEN 'view' THEN 'fulltext' WHEN 'purchase' THEN 'freelance' WHEN 'signup' THEN 'mail' ELSE 'cards_shadow' END AS stage,
       CASE user_id % 4 WHEN 0 THEN 'vendor-haiku-1' WHEN 1 THEN 'vendor-Sonnet-2' WHEN 2 THEN 'vendor-opus-3' ELSE 'mystery' END AS model,
       CAST(floor(value * 1000) AS BIGINT) AS input_tokens, user_id * 7 AS output_tokens,
       CASE WHEN event_id % 3 = 0 THEN event_id % 1000 ELSE 0 END AS cache_write_tokens,
       CASE WHEN event_id % 3 = 1 THEN event_id % 5000 ELSE 0 END AS cache_read_tokens
FROM {events}""",

    # mails: the turns of a conversation are the messages of a thread
    "mails": """
SELECT conv_id AS thread_id, turn AS message_no,
       CASE role WHEN 'user' THEN 'HR <hr@supplier' || CAST(conv_id % 40 AS STRING) || '.example>'
                 WHEN 'assistant' THEN 'Supplier#' || lpad(CAST(conv_id % 300 AS STRING), 9, '0') || ' <jobs@mail.example>'
                 ELSE 'digest@boards.example' END AS sender,
       'Re: case ' || CAST(conv_id AS STRING) AS subject, role, text AS body,
       CASE (conv_id + turn) % 4 WHEN 0 THEN 'відмова' WHEN 1 THEN 'запрошення на співбесіду' WHEN 2 THEN 'відгук на розгляді' ELSE NULL END AS status
FROM {conversations}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Spark form of a canonical view."""
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    df = spark.sql(sql, **used)
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    if name == "mentions":
        df = df.withColumn("pos", F.struct("post_id", "vacancy_idx", "part_id", "supp_id"))
    return df


def duck(name: str) -> str:
    """The same view as a SELECT over the pre-registered tables."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]).strip()


def ctes(*parts: tuple[str, str] | str) -> str:
    """`WITH a AS (…), b AS (…)`; a bare name stands for the canonical view. Each is computed once."""
    items = [(p, duck(p)) if isinstance(p, str) else p for p in parts]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in items) + "\n"
