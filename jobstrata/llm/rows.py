"""What tells rows apart whose ids repeat."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A number that, with the id, stands for one text: decisions on rows are brought back by both.

    It is the hash of the text where some id has several texts. Where every id has one text, the id is enough and the number
    is 0, which takes no room in what is dealt out."""
    text = F.xxhash64(F.col(text_col))
    several = docs.select(F.col(id_col).alias("id"), text.alias("key")).where("id is not null").groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    return F.lit(0).cast("long") if several.isEmpty() else text
