"""One query per training-data operator over its whole table, with the operator's production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobstrata.llm import chat, decontaminate, divergence, infill, lines, ngram_join, passages, pieces, pii, quality, suffixes, vectors, warc

#: where the public tokenizer models lie; never copied into the repository
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_documents(_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(turns.unionByName(planted))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    return pieces.encoded_documents(_table(spark, sf_dir, "documents"), pieces.load_vocabulary(model_file))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_warc, op3_repeated_passages, op4_quality, op5_embedding_near_duplicates, op6_personal_data, op7_ngram_jaccard, op8_chat_format, op9_sentencepiece, op10_line_dedup, op11_fill_in_middle, op12_source_divergence, op13_suffix_dedup)}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WINDOWS_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
hits AS MATERIALIZED (
    SELECT doc_id, i, p.n, item_id
    FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))) p
    JOIN win ON win.win = p.win AND win.n = p.n),
marked AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SHINGLES = "SELECT {keys}, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM {source}"

NEAR_DOCUMENTS_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT * FROM ({_SHINGLES.format(keys="doc_id", source="d")})),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(node, low) AS (SELECT a, b FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.low = links.a),
lowest AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN lowest ON node = d.doc_id
"""

REPEATED_LINES_SQL = f"""
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, no, [t FOR t IN regexp_extract_all(lower(lines[no + 1]), '[^\\x20\\x09\\x0B-\\x0D]+')] AS w FROM (SELECT *, unnest(range(0, len(lines))) AS no FROM x)),
sh AS MATERIALIZED (SELECT DISTINCT * FROM ({_SHINGLES.format(keys="doc_id, no", source="l")})),
size AS MATERIALIZED (SELECT doc_id, no, count(*) AS n FROM sh GROUP BY ALL),
gone AS (
    SELECT DISTINCT b AS doc_id, b_no AS no FROM (
        SELECT x.doc_id AS a, x.no AS a_no, y.doc_id AS b, y.no AS b_no, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE (x.doc_id, x.no) < (y.doc_id, y.no) GROUP BY ALL)
    JOIN size p ON p.doc_id = a AND p.no = a_no JOIN size q ON q.doc_id = b AND q.no = b_no WHERE 100 * c >= 75 * (p.n + q.n - c)),
listed AS (SELECT doc_id, list(CAST(no AS INTEGER) ORDER BY no) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed, coalesce(removed, CAST([] AS INTEGER[])) AS removed
FROM x LEFT JOIN listed USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": WINDOWS_SQL, "op2_warc": warc.PAGES_SQL, "op5_embedding_near_duplicates": vectors.EXACT_SQL, "op7_ngram_jaccard": NEAR_DOCUMENTS_SQL, "op8_chat_format": chat.DIGEST_SQL,
            "op10_line_dedup": REPEATED_LINES_SQL, "op11_fill_in_middle": infill.DIGEST_SQL, "op12_source_divergence": divergence.DIVERGENCE_SQL, "op13_suffix_dedup": suffixes.DIGEST_SQL}
