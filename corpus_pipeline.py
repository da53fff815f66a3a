"""From raw documents to token ids in five stages, each one of the training-data operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobstrata.llm import decontaminate, lines, ngram_join, pieces, quality
from jobstrata.session import Stages

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from `labels`, does not reject."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to earlier ones; n_chars follows the text. What loses all its words goes."""
    return lines.without_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.drop_documents(docs, _table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip."""
    return pieces.encoded_documents(docs, pieces.load_vocabulary(MODEL_FILE))


STAGES = [("quality classifier", good_quality), ("line dedup", new_lines), ("n-gram Jaccard join", one_of_each), ("benchmark decontamination", clean_of_benchmark), ("SentencePiece encoding", encoded)]

#: SQL cannot express the classifier or the encoding; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is a table before the next one reads it."""
    stages = Stages(spark)
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = stages.keep(stage(spark, docs, sf_dir), "stage")
        stages.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
