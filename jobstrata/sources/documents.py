"""JSON documents, log files and hand-kept grids → typed rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNIPPET_CHARS = 600
HEADER_ROWS = 5

JOB = "struct<id:string,name:string,companyName:string,notebookId:string,date:string,cityName:string,salary:string,shortDescription:string>"
JOB_PAGE = f"documents array<{JOB}>, vacancies array<{JOB}>"
GIG = ("id string, attributes struct<name:string,description:string,budget:struct<amount:string,currency:string>,bid_count:string,published_at:string>, "
       "links struct<self:struct<web:string>>")


def job_documents(pages: DataFrame, base: str, column: str = "payload") -> DataFrame:
    """API pages → cards; `documents`, or `vacancies` when it is missing or empty. Id and name are required."""
    p = F.from_json(column, JOB_PAGE)
    rows = F.when(F.size(F.coalesce(p["documents"], F.array().cast(f"array<{JOB}>"))) > 0, p["documents"]).otherwise(p["vacancies"])
    d = pages.select(F.explode(rows).alias("d")).select("d.*")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.regexp_replace(blank("shortDescription"), r"<[^>]+>", " ")
    snippet = F.regexp_replace(F.regexp_replace(F.concat(blank("cityName"), F.lit(" | "), text), r"^[ |]+|[ |]+$", ""), r"(?U)\s+", " ")
    path = F.when(~blank("notebookId").isin("", "0"), F.concat(F.lit("/company"), F.col("notebookId"))).otherwise("")
    return d.where(~blank("id").isin("", "0") & (F.trim(blank("name")) != "")).select(
        F.trim("name").alias("title"), blank("companyName").alias("company"), F.concat(F.lit(base), path, F.lit("/vacancy"), F.col("id")).alias("url"),
        blank("date").alias("posted_raw"), F.when(blank("salary").isin("0", ""), "").otherwise(F.col("salary")).alias("salary_raw"),
        F.substring(snippet, 1, SNIPPET_CHARS).alias("snippet"))


def job_full_text(payload: Column) -> Column:
    """The text of one API posting: place, date, clusters and description on one line."""
    p = F.from_json(payload, "cityName string, vacancyAddress string, date string, clusters string, description string")
    part = lambda label, c: F.concat(F.lit(label + ": "), F.coalesce(c, F.lit("")))
    text = F.concat_ws(" | ", part("Місто", p["cityName"]), part("Адреса", p["vacancyAddress"]), part("Дата публікації", p["date"]),
                       part("Кластери (вид зайнятості тощо)", F.coalesce(p["clusters"], F.lit("[]"))), part("Опис", F.regexp_replace(p["description"], r"<[^>]+>", " ")))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def gig_items(items: DataFrame, base: str, column: str = "payload") -> DataFrame:
    """JSON:API items → gigs; the url falls back to the id, items without title or url are dropped."""
    d = items.select(*[c for c in items.columns if c != column], F.from_json(column, GIG).alias("i"))
    a = F.col("i.attributes")
    web = F.coalesce(F.nullif(F.col("i.links.self.web"), F.lit("")), F.when(F.coalesce(F.col("i.id"), F.lit("")) != "", F.concat(F.lit(base + "/project/"), F.col("i.id"), F.lit(".html"))))
    budget = F.when(F.coalesce(a["budget"]["amount"], F.lit("")) != "", F.trim(F.concat(a["budget"]["amount"], F.lit(" "), F.coalesce(a["budget"]["currency"], F.lit("")))))
    out = d.select(*[c for c in items.columns if c != column], F.trim(a["name"]).alias("title"), web.alias("url"), F.coalesce(a["published_at"], F.lit("")).alias("posted_raw"),
                   a["bid_count"].try_cast("double").cast("int").alias("bids_count"), F.coalesce(budget, F.lit("")).alias("budget_raw"),
                   F.substring(F.coalesce(a["description"], F.lit("")), 1, SNIPPET_CHARS).alias("snippet"))
    return out.where((F.coalesce("title", F.lit("")) != "") & F.col("url").isNotNull())


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """CSV with a header; a byte order mark is not part of the first name."""
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str]) -> DataFrame:
    """JSON lines below a folder; malformed lines are skipped and the last record of a key wins (file, then line)."""
    d = spark.read.schema(schema).options(mode="DROPMALFORMED", recursiveFileLookup="true").json(path)
    cols = d.columns
    d = d.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at")).where(F.col(keys[0]).isNotNull())
    rest = [c for c in cols if c not in keys]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_at").alias("r")).select(*keys, "r.*").select(*cols)


def read_daily_logs(spark: SparkSession, path: str, schema: T.StructType | str, result: str, skip: tuple[str, ...] = ("source_counts.csv", "sheet_rows.csv")) -> DataFrame:
    """All logs below a folder, without bookkeeping files and files that lack the result column."""
    d = spark.read.schema(schema).options(header=True, recursiveFileLookup="true", enforceSchema=True).csv(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return d.where(~name.isin(*skip) & F.col(result).isNotNull())


def rows_by_headers(grid: DataFrame, headers: list[str]) -> DataFrame:
    """A grid of (row_no, cells): the headers are looked for in the first five rows; missing columns are empty, empty
    rows are dropped."""
    top = grid.where(F.col("row_no") < HEADER_ROWS).select("row_no", F.transform("cells", lambda c: F.trim(c)).alias("cells"))
    where = [F.min(F.when(F.array_contains("cells", h.strip()), F.struct("row_no", F.array_position("cells", F.lit(h.strip())).cast("int").alias("i")))).alias(f"h{n}") for n, h in enumerate(headers)]
    d = grid.withColumn("_at", top.agg(*where).select(F.struct(*[f"h{n}" for n in range(len(headers))])).scalar())
    first = F.greatest(*[F.coalesce(F.col(f"_at.h{n}.row_no"), F.lit(-1)) for n in range(len(headers))], F.lit(-1))
    cell = lambda n: F.coalesce(F.trim(F.try_element_at("cells", F.col(f"_at.h{n}.i"))), F.lit(""))
    values = [cell(n) for n in range(len(headers))]
    return d.where((first >= 0) & (F.col("row_no") > first) & (F.concat(*values) != "")).select("row_no", *[v.alias(h) for v, h in zip(values, headers)])


def last_rows(rows: DataFrame, pos: str, n: int) -> DataFrame:
    """The last n rows in their order: a top-n, not a full sort."""
    return rows.orderBy(F.desc(pos)).limit(n).orderBy(pos)


def latest_messages(messages: DataFrame, thread: str = "thread_id", no: str = "message_no") -> DataFrame:
    """The last message of every thread, found by a partial aggregate."""
    rest = [c for c in messages.columns if c not in (thread, no)]
    return messages.groupBy(thread).agg(F.max(no).alias(no), F.max_by(F.struct(*rest), no).alias("r")).select(thread, no, "r.*")


def header_value(headers: Column, name: str) -> Column:
    """First header of that name, case ignored; "" without one. Headers are (name, value) structs."""
    return F.coalesce(F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"], F.lit(""))


def classified_baseline(posts: DataFrame, mentions: DataFrame) -> DataFrame:
    """(channel, post_id, is_vacancy) of classified posts; a blank flag counts as classified."""
    has = mentions.select("channel", "post_id").distinct().withColumn("_has", F.lit(True))
    done = posts.where(F.coalesce(F.nullif("classified", F.lit("")), F.lit("True")) == "True")
    return done.join(has, ["channel", "post_id"], "left").select("channel", "post_id", F.coalesce("_has", F.lit(False)).alias("is_vacancy"))


def newest(rows: DataFrame, order: list[Column], k: int) -> tuple[DataFrame, Column]:
    """Top k and, as a scalar, whether there were more."""
    return rows.orderBy(*order).limit(k), (rows.limit(k + 1).agg(F.count(F.lit(1)).alias("n")).scalar() > k)


def source_order(source: Column, registry: list[str]) -> list[Column]:
    """Registry order, unknown sources last by name."""
    rank = F.lit(len(registry))
    for i, s in reversed(list(enumerate(registry))):
        rank = F.when(source == s, i).otherwise(rank)
    return [rank, source]
