"""What the operators of this subpackage share: table access, the shared folder, and Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import mix


#: Text in one numpy batch. A task may hold two Python workers, each with a dozen arrays over its batch.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). In local mode, where one machine is all there
    is, a folder of our own stands in for it; a cluster without the setting is an error."""
    sc = spark.sparkContext
    if set_dir := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return set_dir
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="storyloom-checkpoints-"))
    return sc.getCheckpointDir()


_scratch: list[list[str]] = []


def saved(df: DataFrame, keep_as: str | None = None) -> DataFrame:
    """Write to a fresh table in the shared folder and read it again: cheaper than checkpoint() for wide rows. A table
    with a name in keep_as outlives scratch()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/storyloom-{keep_as or 'table'}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch and not keep_as:
        _scratch[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)  # one that has gone already is no error


def discard(*tables: DataFrame) -> None:
    """Remove saved tables that nothing will read again: what was made from them has itself been saved."""
    for df in tables:
        _remove(df.sparkSession, df.saved_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are saved inside go at the end; what is made from them must be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _remove(spark, path)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string (null stays null); columns of any other name are left behind."""
    kinds = dict(docs.dtypes)
    as_is = kinds["doc_id"] == "bigint" and kinds["text"] == "string"  # plain columns, so that Spark sees equal exchanges
    return docs.select("doc_id", "text") if as_is else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def by_megabytes(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut and join record batches so that each holds about `most` bytes of `column` (one longer row stands alone)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        i = b.schema.get_field_index(column)
        lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False).cumsum()
        at, base = 0, 0
        for k in range(b.num_rows):
            if size + lengths[k] - base >= most:
                held.append(b.slice(at, k + 1 - at))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, at, base = [], 0, k + 1, int(lengths[k])
        if at < b.num_rows:
            held.append(b.slice(at))
            size += int(lengths[-1]) - base
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def trim() -> None:
    """Give memory that this Python worker no longer uses back to the system; Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


@lru_cache(1)
def _libc():
    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "malloc_trim") else None


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that trims its worker when the task's last batch is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def arrow_map(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", most: int = BATCH_BYTES):
    """A mapInArrow function that calls f on batches of about `most` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_megabytes(batches, column, most):
            if (out := f(b)) is not None and out.num_rows:
                yield out

    return trimmed(run)


def release(spark: SparkSession) -> None:
    """A hint, of which no result depends: when the driver's JVM collects garbage, Spark removes the shuffle files of
    finished queries. Without it they stay until the heap fills, which a driver with little to do takes long for.
    Spark holds on to the latest query, so another one, of a single row, comes first."""
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


FILTER_BITS = 1 << 29  # at most 64 MB; beyond about 50 million ids it passes more rows than it must, never fewer
FILTER_BLOCK = 1 << 17


def _bloom_places(x: np.ndarray, bits: int) -> np.ndarray:
    h = mix(x.astype(np.int64, copy=False).view(np.uint64) + np.uint64(11))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1), mix(h) & np.uint64(bits - 1)]).astype(np.int64)


def bloom_filter(ids: DataFrame, column: str) -> np.ndarray:
    """Bytes of a Bloom filter over a long column, of bounded size. ids should be a saved table; nulls don't count."""
    bits = 1 << max(17, min(FILTER_BITS.bit_length() - 1, (10 * ids.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.unique(_bloom_places(b.column(0).drop_null().to_numpy(zero_copy_only=False), bits))
            cut = np.flatnonzero(np.diff(at // FILTER_BLOCK)) + 1
            for part in np.split(at, cut) if len(at) else []:
                block = held.setdefault(int(part[0] // FILTER_BLOCK), np.zeros(FILTER_BLOCK // 8, np.uint8))
                part = part % FILTER_BLOCK
                np.bitwise_or.at(block, part >> 3, (128 >> (part & 7)).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint8)
                held[k] = held[k] | x if k in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "bits"])

    marked = ids.select(column).mapInArrow(trimmed(mark), "block int, bits binary").repartition(max(1, min(64, bits // FILTER_BLOCK)), "block")
    out = np.zeros((bits // FILTER_BLOCK, FILTER_BLOCK // 8), np.uint8)
    found = marked.mapInArrow(trimmed(join), "block int, bits binary").toArrow()  # at most bits / 8 bytes
    for k, x in zip(found.column("block").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[k] |= np.frombuffer(x, np.uint8)
    return out.ravel()


def in_filter(filter_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mask of the values that may be in the filter; none that is in it is missed."""
    ok = np.ones(len(x), bool)
    for at in _bloom_places(x.view(np.int64), 8 * len(filter_)):
        ok &= (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ok


def only_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """rows whose `column` may be among the one long column of ids: a Bloom filter of bounded size that drops most
    other rows before they are shuffled. ids should be a saved table; null ids never pass; an empty ids passes no
    row; repeated rows and all columns stay as they are."""
    held = bloom_filter(ids, ids.columns[0])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(column)
            ok = ~np.array(x.is_null()) & in_filter(held, pa.compute.fill_null(x, 0).to_numpy(zero_copy_only=False))
            if ok.any():
                yield b.filter(pa.array(ok))

    return rows.mapInArrow(trimmed(keep), rows.schema)
