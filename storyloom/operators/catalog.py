"""The catalog of motifs: loading, groups and aliases."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from storyloom.functions.text import normalize_alias, split_list

from .tables import upsert

ALIAS_CHARS, ALIASES = 40, 12
#: Fixed values.
BARRED = ("trope", "cliche", "stereotype")


@F.pandas_udf(StringType())
def ascii_folded(x):
    """Compatibility decomposition without what is not ASCII (no JVM function does this)."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


@F.pandas_udf(ArrayType(StringType()))
def ascii_folded_list(x):
    return x.map(lambda a: None if a is None else [unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode() for s in a if s is not None])


@F.pandas_udf(StringType())
def motif_uuid(x):
    """The name-based id of a motif: UUID version 5 of `trope:<lower-case name>` in the URL namespace."""
    return x.map(lambda s: None if s is None else str(uuid.uuid5(uuid.NAMESPACE_URL, f"trope:{s.strip().lower()}")))


def loaded(rows: DataFrame) -> DataFrame:
    """Catalog rows as motifs: lists split, ids from names where there is none."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    lists = lambda c: split_list(F.col(c)) if c in rows.columns else F.array().cast("array<string>")
    named = rows.where("trim(name) <> ''")
    return named.select(F.coalesce(text("id"), motif_uuid("name")).alias("motif_id"), F.trim("name").alias("name"), text("summary").alias("summary"), lists("aliases").alias("aliases"), lists("anti_aliases").alias("anti_aliases"), lists("tags").alias("tags"), text("source_url").alias("source_url"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The catalog after a load: new values over old, by id; the last row of one id within the load wins by name order."""
    w = Window.partitionBy("motif_id").orderBy(F.desc("name"))
    one = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return upsert(old, one, ["motif_id"])


def groups(rows: DataFrame, column: str = "groups") -> tuple[DataFrame, DataFrame]:
    """Groups (group_id, name; names that differ in case alone are one, spelled as the least) and memberships."""
    listed = rows.select("motif_id", F.explode(split_list(F.col(column))).alias("name")).withColumn("group_id", F.md5(F.lower("name").cast("binary")))
    return listed.groupBy("group_id").agg(F.min("name").alias("name")), listed.select("motif_id", "group_id").distinct()


def cleaned_aliases(rows: DataFrame, aliases: str = "aliases", name: str = "name", out: str = "clean") -> DataFrame:
    """rows with `out`: distinct aliases, folded to ASCII, normalized and cut to 40 characters: those of two
    characters or more, without the name, barred words and any with a quote inside; 12 at most."""
    both = F.concat(F.array(F.coalesce(name, F.lit(""))), F.coalesce(aliases, F.array().cast("array<string>")))
    folded = rows.withColumn("_folded", ascii_folded_list(both))
    flat = F.transform("_folded", lambda a: F.rtrim(F.substring(normalize_alias(a), 1, ALIAS_CHARS)))
    kept = F.filter(F.slice(flat, 2, F.size(flat)), lambda a: (F.length(a) >= 2) & (a != F.get(flat, F.lit(0))) & ~a.isin(*BARRED) & ~a.rlike("[\"'`]"))
    return folded.withColumn(out, F.slice(F.array_distinct(kept), 1, ALIASES)).drop("_folded")


def merged_aliases(old: Column, new: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)))


def without_aliases(motifs: DataFrame) -> DataFrame:
    return motifs.where("aliases is null or size(aliases) = 0")
