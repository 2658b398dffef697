"""Sharding by sampled splitters.

Keys are drawn with a chance in proportion to a row's size, their quantiles split the key space into
ranges, ranges that turn out overfull are split again, and each range is then ordered by itself. Only the
ranges' totals (a bounded number) reach the driver; with them every row knows how many bytes lie before it
in the one global order, so the shards follow the law ``bytes``: each holds its share of the bytes, up to
one row. The key is (md5 of the text, doc_id): equal texts lie side by side, and a large group of equal
texts can still be cut.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import id_and_text, saved, table

LEAST_RANGES, MOST_RANGES, ROWS_A_RANGE = 512, 16_384, 250_000
DRAWS, ROUNDS = 32, 4


def _sort_key() -> F.Column:
    """md5 of the text, then doc_id with its sign flipped: bytes that sort as (text group, doc_id)."""
    flipped = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(F.md5(F.col("text").cast("binary"))), F.unhex(flipped))


def _drawn(rows: DataFrame, total: int, draws: int, seed: int) -> list[bytes]:
    """About `draws` sort keys, each row with a chance of draws * size / total."""
    chance = F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return sorted(bytes(r.k) for r in rows.where(chance < F.col("size") * F.lit(draws / max(total, 1))).select("k").collect())


def _in_ranges(rows: DataFrame, splitters: list[bytes]) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pa.array([bisect_right(splitters, k) for k in b.column("k").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, at], [*b.schema.names, "range"])

    return rows.mapInArrow(place, StructType([*rows.schema.fields, StructField("range", IntegerType())]))


def byte_shards(docs: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """Place every row into one of `shards` shards of near equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; null counts as no text), text_crc32, shard and
    slot (from 0, gapless, in key order). Null doc_id sorts first; repeated rows stand side by side, each
    with a slot of its own; an empty table gives an empty result; other columns are left behind.
    The number of ranges follows the rows. The driver sees about ranges * DRAWS sampled keys and one total for
    each range, half a million keys at most.
    """
    return _placed(id_and_text(docs), [], shards, ranges)


def _placed(docs: DataFrame, kept: list[F.Column], shards: int, ranges: int | None) -> DataFrame:
    """What byte_shards returns, and the columns `kept` of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), text.alias("text"), *kept)
    carried = rows.columns[3:]
    rows = saved(rows.select(F.col("id").alias("doc_id"), (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), _sort_key().alias("k"), *carried))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, count // ROWS_A_RANGE))
    splitters = _spread(_drawn(rows, total, ranges * DRAWS, 1), ranges)
    for again in range(ROUNDS + 1):
        placed = _in_ranges(rows, splitters)
        held = {r["range"]: (r.b, r.n) for r in placed.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
        overfull = [r for r, (b, n) in held.items() if n > 1 and b > 2 * total / ranges]
        if not overfull or again == ROUNDS:
            break
        more = _drawn(placed.where(F.col("range").isin(overfull)), sum(held[r][0] for r in overfull), len(overfull) * DRAWS * 4, 2 + again)
        found: dict[int, list[bytes]] = {r: [] for r in overfull}
        for k in more:
            found[bisect_right(splitters, k)].append(k)
        new = {k for r, ks in found.items() for k in _spread(ks, 1 + int(2 * held[r][0] * ranges / total))}
        if not new - set(splitters):
            break
        splitters = sorted(new | set(splitters))
    bases, b, n = [], 0, 0
    for r in sorted(held):
        bases.append((r, b, n))
        b, n = b + held[r][0], n + held[r][1]
    spark = docs.sparkSession
    bases = spark.createDataFrame(bases or [(0, 0, 0)], "range int, bytes_before long, rows_before long")
    in_order = Window.partitionBy("range").orderBy("k", "text_crc32")
    upto = F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = placed.select("*", upto.alias("upto"), F.row_number().over(in_order).alias("nth")).join(F.broadcast(bases), "range")  # one row a range: at most a few thousand
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    at = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(total, 1)))).cast("int"))
    ranked = saved(ranked.select("doc_id", "size", "text_crc32", at.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("position"), *carried))
    firsts = ranked.groupBy("shard").agg(F.min("position").alias("first"))
    return ranked.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"), *carried)


def _spread(keys: list[bytes], parts: int) -> list[bytes]:
    """At most parts - 1 distinct keys at the quantiles of a sorted sample."""
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys and parts > 1 else []


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> DataFrame:
    """Write every row as it is, with its slot, to one folder for each shard; returns what byte_shards says.

    Rows are carried along, not looked up by doc_id, so null and repeated doc_ids are written like all others.
    Columns shard and slot of the input are replaced; an empty table writes no folder."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = _placed(docs, [F.struct(*names).alias("row")], shards, None)
    placed.select(*(F.col(f"row.`{c}`") for c in names), "shard", "slot").write.partitionBy("shard").parquet(path)
    return placed.drop("row")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards by the law of bytes; see byte_shards for odd rows."""
    placed = byte_shards(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The global order and its byte offsets; the CRC runs over the bytes with a table made from the polynomial.
ORACLE_SQL = """
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM steps WHERE k < 8
), lookup AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS k FROM documents),
g AS (SELECT *, sum(size) OVER (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM d),
s AS (SELECT *, least(7, floor((upto - size / 2.0) * 8 / total))::INTEGER AS shard FROM g)
SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32,
  'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s, lookup
"""
