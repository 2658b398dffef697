"""Works into chapters, scenes, sentences and overlapping token chunks, with absolute code-point offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.config import ChunkConfig
from storyloom.functions.text import MARK, piece_spans, pieces

#: What a heading and a scene rule look like.
HEADING = r"(?i)^(?:chapter|ch\.|book|part)\s+([ivxlcdm]+|\d+|[a-z]+)\b"
RULE = r"^(?:\*{3,}|-{3,}|—{2,}|·{3,}|\*\s\*\s\*|#\s#\s#)\s*$"
STRIP = r"^\s+|\s+$"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def lines(rows: DataFrame, key: str, text: str = "text", start: str | None = None) -> DataFrame:
    """key, line (from 0), content, at (offset of the line; counted from the column `start` if given).

    Offsets come from one pass over the array of lines, so no window over the lines of a work is sorted."""
    split = pieces(F.col(text), "\n", f"\n{MARK}")
    base = F.col(start) if start else F.lit(0)
    out = rows.select("*", F.posexplode(split).alias("line", "_p"))
    return out.select(*rows.columns, "line", (F.col("_p.start") + base).alias("at"), F.regexp_replace("_p.piece", "\n$", "").alias("content"))


def chapters(works: DataFrame, key: str = "work_id", text: str = "text") -> DataFrame:
    """key, idx, title, char_start, char_end, text. Text before the first heading belongs to no chapter; a work
    without headings is one chapter without a title."""
    heads = F.filter(pieces(F.col(text), "\n", f"\n{MARK}"), lambda p: _stripped(p["piece"]).rlike(HEADING))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(None).cast("string").alias("piece")))
    heads = F.when(F.size(heads) > 0, heads).otherwise(whole)
    rows = works.select(F.col(key), F.col(text).alias("_t"), heads.alias("_h")).select(key, "_t", "_h", F.posexplode("_h").alias("idx", "_c"))
    end = F.coalesce(F.get(F.col("_h"), F.col("idx") + 1)["start"], F.length("_t"))
    rows = rows.select(key, "idx", _stripped(F.col("_c.piece")).alias("title"), F.col("_c.start").alias("char_start"), end.alias("char_end"), "_t")
    return rows.select(key, "idx", "title", "char_start", "char_end", F.col("_t").substr(F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("text"))


def scenes(chapter_rows: DataFrame, key: str = "work_id") -> DataFrame:
    """key, chapter, idx (from 0 in each chapter), char_start, char_end, heading, text.

    A scene starts at a rule line or at the second of two blank lines; spans of white space only are dropped, but a
    chapter of white space only is one scene."""
    parts = pieces(F.col("text"), "\n", f"\n{MARK}")
    line = lambda p: _stripped(p["piece"])
    starts = lambda p, i: (i == 0) | line(p).rlike(RULE) | ((line(p) == "") & (i > 0) & (line(F.get(F.col("_l"), i - 1)) == ""))
    anchors = F.filter(F.transform("_l", lambda p, i: F.when(starts(p, i), F.struct(p["start"].alias("start"), line(p).alias("line")))), lambda a: a.isNotNull())
    rows = chapter_rows.select(key, F.col("idx").alias("chapter"), F.col("char_start").alias("_base"), "text", parts.alias("_l")).withColumn("_a", anchors)
    n = F.length("text")
    end = lambda i: F.coalesce(F.get(F.col("_a"), i + 1)["start"], n)
    spans = F.transform("_a", lambda a, i: F.struct(a["start"].alias("start"), end(i).alias("end"), F.when(a["line"].rlike(RULE), a["line"]).alias("heading")))
    cut = lambda s: F.col("text").substr(s["start"] + 1, s["end"] - s["start"])
    full = F.filter(spans, lambda s: _stripped(cut(s)) != "")
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end"), F.lit(None).cast("string").alias("heading")))
    rows = rows.withColumn("_s", full).withColumn("_s", F.when(F.size("_s") > 0, F.col("_s")).otherwise(whole))
    rows = rows.select(key, "chapter", "_base", "text", F.posexplode("_s").alias("idx", "_s"))
    return rows.select(key, "chapter", "idx", (F.col("_base") + F.col("_s.start")).alias("char_start"), (F.col("_base") + F.col("_s.end")).alias("char_end"), F.col("_s.heading").alias("heading"), cut(F.col("_s")).alias("text"))


SENTENCE_END = {"A": r"([.!?]+(?:\s+|$)|\n{2,})", "B": r"([.!?]+(?:\s+|$)|\n{2,})", "C": r"((?:[.!?]|—)+\s+)", "D": r"([.!?]\"?\s)"}


def sentences(c: Column, variant: str = "A") -> Column:
    """array<struct<start, end>>. A: trimmed pieces that are not empty, the whole text if there is none; B: the
    same, but the last piece keeps its white space at the end; C, D: untrimmed pieces between cuts."""
    ends = piece_spans(c, SENTENCE_END[variant], f"$1{MARK}", trim=variant in "AB", tail=variant == "B")
    if variant in "CD":
        return ends
    return F.when(F.size(ends) > 0, ends).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.length(c).alias("end"))))


TOKEN = re.compile(r"\w+|[^\w\s]")
OUT_BYTES = 4 << 20  # chunks of a batch that a task holds at once
CHUNK = "idx int, char_start int, char_end int, token_start int, token_end int, text string"


def chunk_spans(text: str, config: ChunkConfig = ChunkConfig()) -> list[tuple[int, int]]:
    """Token ranges of one scene's chunks: a sequential rule (each start depends on the last end)."""
    tokens = [m.group() for m in TOKEN.finditer(text)]
    n, i, out = len(tokens), 0, []
    while i < n:
        j = min(i + config.target, n)
        j = min(i + config.most, max(j, min(n, i + config.least)), n)
        for p in range(j, min(n - 1, j + config.look_ahead) + 1):
            if tokens[p] in ".!?":
                j = min(p + 1, i + config.most)
                break
        out.append((i, j))
        if j >= n:
            break
        i = max(0, j - config.overlap)
    return out


def chunks(scene_rows: DataFrame, keys: list[str], config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """keys, idx, char_start, char_end (absolute, from the scene's char_start), token_start, token_end (in the
    scene), text and sha256. The only step of segmentation in Python, for its recurrence: Arrow batches, no shuffle."""
    rows = scene_rows.select(*keys, F.col("char_start").alias("_base"), "text")

    def made(b: pa.RecordBatch, at: list, out: list) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 6
        parts = [pa.array(c, t) for c, t in zip(cols, (pa.int32(),) * 5 + (pa.string(),), strict=True)]
        kept = b.select(keys).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, *parts], [*keys, "idx", "char_start", "char_end", "token_start", "token_end", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out, size = [], [], 0
            for r, (base, text) in enumerate(zip(b.column("_base").to_pylist(), (x.as_py() for x in b.column("text")), strict=True)):
                if not text:
                    continue
                ends = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
                for k, (i, j) in enumerate(chunk_spans(text, config)):
                    at.append(r)
                    a, z = ends[i][0], ends[j - 1][1]
                    out.append((k, base + a, base + z, i, j, text[a:z]))
                    size += 256 + z - a
                    if size > OUT_BYTES:
                        yield made(b, at, out)
                        at, out, size = [], [], 0
            yield made(b, at, out)

    from pyspark.sql.types import StructType

    schema = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL(CHUNK).fields])
    return rows.mapInArrow(run, schema).withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))


def segment(works: DataFrame, key: str = "work_id", config: ChunkConfig = ChunkConfig()) -> dict[str, DataFrame]:
    """Chapters, scenes and chunks of works (key, text: already normalized)."""
    c = chapters(works, key)
    s = scenes(c, key)
    return {"chapter": c.drop("text"), "scene": s, "chunk": chunks(s.withColumnRenamed("idx", "scene"), [key, "chapter", "scene"], config)}


def statistics(works: DataFrame, key: str = "work_id", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """key, chapters, scenes, chunks of each work: what a dry run prints."""
    parts = segment(works, key, config)
    out = works.select(key)
    for name, df in parts.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(f"{name}s")), key, "left")
    return out.na.fill(0)
