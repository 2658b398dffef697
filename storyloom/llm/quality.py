"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Every word has two rows in a fixed table: one of its hash and one of its shape (case, punctuation, length).
A row's vector is the sum, over every document, of the sparse random index vectors of the words that stand
within two places; tables of all tasks are added block by block. A document's features are the mean vectors
of its words. Its size is fixed (4 MB), so it can go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, by_megabytes, id_and_text, table, trimmed
from .words import U, Words, mix

WORD_ROWS, SHAPE_ROWS, WIDTH, NONZERO, REACH = 1 << 13, 1 << 10, 64, 4, 2
ROWS = WORD_ROWS + SHAPE_ROWS
BLOCK_ROWS = 256
DOCS_AT_ONCE = 128  # of which word counts stand in memory as a dense table
SAMPLE = 20_000  # labelled rows that the network is fitted on, at most: the smallest hashes of doc_id
THRESHOLD = 0.7


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each row as a context: the places of its nonzero entries, and their signs."""
    r = mix(np.arange(ROWS * NONZERO, dtype=U) + U(77)).reshape(ROWS, NONZERO)
    return (r % U(WIDTH)).astype(np.int64), np.where((r >> U(40)) & U(1), 1.0, -1.0)


PLACES, SIGNS = _index_vectors()


def rows_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of each word's hash and shape."""
    buf = w.buf
    count = lambda m: (lambda c: c[w.end] - c[w.start])(np.concatenate([[0], np.cumsum(m)]))
    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    digit, high = (buf >= 48) & (buf <= 57), buf >= 128
    size = w.end - w.start
    n_up, n_low, n_dig, n_high = count(upper), count(lower), count(digit), count(high)
    marks = size - n_up - n_low - n_dig - n_high
    letters = n_up + n_low + n_high
    tail = ~(upper | lower | digit | high)[w.end - 1] if len(size) else np.zeros(0, bool)
    case = np.where(letters == 0, 0, np.where((n_up >= 2) & (n_low == 0), 1, np.where(n_up > 0, 2, 3)))
    shape = ((case * 4 + np.minimum(marks, 3)) * 2 + tail) * 2 + (n_dig > 0)
    shape = shape * 8 + np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 7)
    return (w.hash % U(WORD_ROWS)).astype(np.int64), WORD_ROWS + shape % SHAPE_ROWS


def cooccurrence(w: Words) -> np.ndarray:
    """The batch's share of the table: each row gets the index vectors of its words' neighbours."""
    a, b = rows_of(w)
    of = w.of()
    out = np.zeros(ROWS * WIDTH)
    for reach in range(1, REACH + 1):
        if len(a) <= reach:
            break
        same = np.flatnonzero(of[reach:] == of[:-reach])
        for here, there in ((same, same + reach), (same + reach, same)):
            for rows in (a, b):
                r, c = rows[here] * WIDTH, rows[there]
                for k in range(NONZERO):
                    out += np.bincount(r + PLACES[c, k], SIGNS[c, k], ROWS * WIDTH)
    return out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table over all documents, each row of unit length (rows never met stay zero)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * WIDTH)
        for b in by_megabytes(batches):
            total += cooccurrence(Words(b.column("text")))
        blocks = total.astype(np.int64).reshape(-1, BLOCK_ROWS * WIDTH)
        full = [i for i in range(len(blocks)) if blocks[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([blocks[i].astype("<i8").tobytes() for i in full], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column("block").to_pylist(), b.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(x, "<i8")
                held[i] = held[i] + x if i in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "sums"])

    parts = id_and_text(docs).select("text").mapInArrow(trimmed(gather), "block int, sums binary")
    out = np.zeros((ROWS // BLOCK_ROWS, BLOCK_ROWS * WIDTH))
    for r in parts.repartition(ROWS // BLOCK_ROWS, "block").mapInArrow(trimmed(add), "block int, sums binary").collect():  # a fixed 36 blocks
        out[r.block] += np.frombuffer(r.sums, "<i8")
    out = out.reshape(ROWS, WIDTH)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean vector of its words and mean vector of their shapes."""
    w = Words(texts)
    a, b = rows_of(w)
    of = w.of()
    out = np.zeros((len(w.n), 2 * WIDTH), np.float32)
    for d in range(0, len(w.n), DOCS_AT_ONCE):
        low, high = w.doc[d], w.doc[min(d + DOCS_AT_ONCE, len(w.n))]
        here, docs = of[low:high] - d, min(DOCS_AT_ONCE, len(w.n) - d)
        for k, (rows, first, size) in enumerate(((a, 0, WORD_ROWS), (b, WORD_ROWS, SHAPE_ROWS))):
            counts = np.bincount(here * size + rows[low:high] - first, minlength=docs * size).reshape(docs, size)
            out[d : d + docs, k * WIDTH : (k + 1) * WIDTH] = counts.astype(np.float32) @ vectors[first : first + size]
    return out / np.maximum(w.n, 1).astype(np.float32)[:, None]


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 1500, rate: float = 0.01, seed: int = 7) -> QualityModel:
    """Adam on cross-entropy over four fifths of the rows; the temperature is set on the rest. With no rows or
    one class only, the score is the smoothed share of class 1."""
    rng = np.random.default_rng(seed)
    width = 2 * WIDTH
    share = (y.sum() + 1) / (len(y) + 2)
    model = QualityModel(vectors, np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    held, used = order[:cut], order[cut:]
    model.centre, model.scale = x[used].mean(0), x[used].std(0) + 1e-3
    z = (x - model.centre) / model.scale
    p = [rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), hidden), np.array([model.b2])]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, steps + 1):
        at = rng.choice(used, min(512, len(used)), replace=False)
        pre = z[at] @ p[0] + p[1]
        h = np.maximum(pre, 0)
        out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -60, 60)))
        d = (out - y[at]) / len(at)
        dh = np.outer(d, p[2]) * (pre > 0)
        grads = [z[at].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (0.1 ** (t / steps)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3][0])
    logits, target = model.logits(x[held]), y[held]
    loss = lambda t: np.logaddexp(0, -logits / t * (2 * target - 1)).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Word vectors from every document; the network from at most `sample` labelled documents that are not held
    out. Null doc_id, null texts' labels of null and repeated labels are left out or counted once; no label at
    all gives the score 0.5."""
    vectors = word_vectors(docs)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    marked = marked.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = id_and_text(docs).join(F.broadcast(marked), "doc_id")  # at most `sample` rows of 12 bytes

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        x = pooled(b.column("text"), vectors)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    found = sorted((r.doc_id, r.quality, bytes(r.x)) for r in rows.select("doc_id", "quality", "text").mapInArrow(arrow_map(features), "doc_id long, quality int, x binary").collect())
    x = np.frombuffer(b"".join(r[2] for r in found), np.float32).reshape(-1, 2 * WIDTH).astype(np.float64)
    return fit_network(vectors, x, np.array([r[1] for r in found], float))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row; null text counts as empty, null doc_id and repeated rows stay."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(pooled(b.column("text"), model.vectors)), pa.float64())], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(arrow_map(one), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns kept, in one pass. Null texts are scored as
    empty ones; null doc_id and repeated rows are judged by their texts like all others; without labels every score
    is 0.5; an empty table stays empty."""
    model = fit_quality(docs, labels)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(model.scores(pooled(b.column("text").cast(pa.string()), model.vectors)) >= threshold))

    return docs.mapInArrow(arrow_map(one), docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of documents by a model of their words and of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
