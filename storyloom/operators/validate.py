"""Checks in place of foreign keys and constraints: each gives the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def bad_spans(rows: DataFrame, start: str = "start", end: str = "end", low: str | None = None, high: str | None = None) -> DataFrame:
    bad = (F.col(end) <= F.col(start)) | (F.col(start) < 0)
    if low and high:
        bad = bad | (F.col(start) < F.col(low)) | (F.col(end) > F.col(high))
    return rows.where(F.coalesce(bad, F.lit(True)))


def bad_weights(rows: DataFrame, column: str = "weight") -> DataFrame:
    return rows.where(~F.coalesce(F.col(column).between(0, 1), F.lit(False)))


def bad_lists(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose JSON text is there but is no list of strings."""
    return rows.where((F.trim(column) != "") & F.from_json(column, "array<string>").isNull())


def rank_gaps(rows: DataFrame, by: str = "scene_id", rank: str = "rank") -> DataFrame:
    """Groups whose ranks are not exactly 1 to n."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(rank))
    return rows.withColumn("_n", n).where(F.col("_n") != F.col(rank)).select(by).distinct()
