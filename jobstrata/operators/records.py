"""Coercion and filtering of extracted records and log rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata.functions import dates
from jobstrata.functions.text import enum_or
from jobstrata.operators.dedup import DIRECTIONS, FORMATS, LEVELS, NON_IT_DIRECTIONS

SALARY_PERIODS = ("month", "hour", "project")


def coerce(raw: DataFrame) -> DataFrame:
    """Extracted records with enumerated fields made valid; a marketing or non-IT direction is never IT."""
    said = F.coalesce(F.col("is_it"), F.lit(False))
    direction = enum_or(F.col("direction"), DIRECTIONS, F.when(said, "other-it").otherwise("non-it"))
    words = F.filter(F.transform("skills", lambda s: F.trim(s)), lambda s: s != "")
    return (raw.withColumn("direction", direction).withColumn("is_it", said & ~F.col("direction").isin(*NON_IT_DIRECTIONS))
            .withColumn("title", F.trim(F.coalesce("title", F.lit("")))).withColumn("company", F.trim(F.coalesce("company", F.lit(""))))
            .withColumn("level", enum_or(F.col("level"), LEVELS, "unspecified")).withColumn("work_format", enum_or(F.col("work_format"), FORMATS, "unspecified"))
            .withColumn("salary_period", enum_or(F.col("salary_period"), SALARY_PERIODS, "")).withColumn("skills", F.array_join(words, "; ")))


def in_period(log: DataFrame, published: str, run_date: str, start: str, end: str, other_system: str) -> DataFrame:
    """How many rows of the period count and how many come from the other system's own channel (left out).

    A row's date is its publication date, else the date of the run; both ends are inside the period."""
    day = F.coalesce(dates.date_anywhere(F.col(published)), F.col(run_date).cast("date"))
    foreign = F.col("source").rlike(other_system)
    return log.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).agg(F.count_if(~foreign).alias("kept"), F.count_if(foreign).alias("other_system"))


def data_rows(log: DataFrame) -> DataFrame:
    """Log rows without the summary rows."""
    return log.where(F.trim("result") != "ПІДСУМОК")
