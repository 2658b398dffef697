"""Models from outside as replaceable parts: by default deterministic, and never over a network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Any picklable object that turns texts into vectors of one size."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Judge(Protocol):
    """Turns prompts (scene_id, prompt) into answers (scene_id, answer)."""

    def judge(self, prompts: DataFrame) -> DataFrame: ...


class HashingEmbedder:
    """Signed counts of words and word pairs in `dim` places by hash, of unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for r, t in enumerate(texts):
            words = re.findall(r"\w+", t.lower())
            for g in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest())
                out[r, h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class RecordedJudge:
    """Answers that were given before, as a table scene_id, answer."""

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def judge(self, prompts: DataFrame) -> DataFrame:
        return prompts.select("scene_id").join(self.answers, "scene_id")


def embedded(rows: DataFrame, text: str, embedder: Embedder | None = None, batch: int = 64) -> DataFrame:
    """rows with `embedding`; each distinct text of a batch is embedded once, null and blank texts get none."""
    model = embedder or HashingEmbedder()
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    base = rows.drop("embedding")
    schema = StructType([*base.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            distinct = list(dict.fromkeys(t for t in texts if t and t.strip()))
            found: dict[str, list[float]] = {}
            for k in range(0, len(distinct), batch):
                part = distinct[k : k + batch]
                found |= dict(zip(part, model.embed(part).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([found.get(t) for t in texts], pa.list_(pa.float32()))], schema.names)

    return base.mapInArrow(run, schema)


def incrementally_embedded(chunks: DataFrame, refs: DataFrame, collection: str, model_name: str, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors of the chunks that the collection lacks, and the references to add for them."""
    from storyloom.operators.vectors import unembedded

    vectors = embedded(unembedded(chunks, refs, collection), "text", embedder).where("embedding is not null")
    added = vectors.select("chunk_id", F.lit(collection).alias("collection"), F.lit(model_name).alias("model"), F.size("embedding").alias("dim"))
    return vectors, added
