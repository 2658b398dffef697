"""Writes that keep keys unique, as set operations on immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """Rows that are there stay; of new rows with one new key the first in order comes in."""
    return old.unionByName(first_of_each(new.join(old.select(*key), key, "left_anti"), key, order).select(old.columns))


def insert_or_replace(old: DataFrame, new: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """Of new rows with one key the last in order wins over the old row. `order` must be descending."""
    last = first_of_each(new, key, order).select(old.columns)
    return old.join(last.select(*key), key, "left_anti").select(old.columns).unionByName(last)


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ("created_at",)) -> DataFrame:
    """New values where there is a new row (a null does not erase), old ones elsewhere; `keep` columns stay as they
    first were. Each side must have one row a key."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full_outer")
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}") if c in keep else F.coalesce(f"b.{c}", f"a.{c}")
    return joined.select(*(pick(c).alias(c) for c in old.columns))


def update(rows: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """rows with the columns that changes has for the same key, where it has any."""
    names = [c for c in changes.columns if c not in key]
    other = changes.select(*key, *(F.col(c).alias(f"_{c}") for c in names))
    out = rows.join(other, key, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns))


def delete(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key), key, "left_anti")


def in_listed_order(lists: DataFrame, key: str, ids: str, rows: DataFrame, id_: str, value: str) -> DataFrame:
    """key and `values`: for each list of ids the looked-up values in the list's order; unknown ids are left out."""
    asked = lists.select(key, F.posexplode(ids).alias("_n", id_))
    found = asked.join(rows.select(id_, value), id_)
    out = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", value))).alias("v")).select(key, F.col(f"v.{value}").alias("values"))
    return lists.select(key).join(out, key, "left").withColumn("values", F.coalesce("values", F.array().cast(f"array<{dict(rows.dtypes)[value]}>")))


def sampled(rows: DataFrame, id_: str, k: int, seed: int = 0) -> DataFrame:
    """k rows by a seeded hash of their id: the same rows on every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), id_), id_).limit(k)
