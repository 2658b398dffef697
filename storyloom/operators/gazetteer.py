"""The dictionary join: every place where an alias of a motif stands in a chunk."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from storyloom.config import GazetteerConfig
from storyloom.functions.text import ANTI_EDGE, DASHES, WORD, matches, normalize_alias

FLAGS = "(?iuU)"  # what the JVM needs to read a pattern as the scan does
#: How the words of a phrase may be joined, by variant of the pattern builder.
JOINERS = {1: rf"[{DASHES}\s]+", 2: rf"(?:[{DASHES}]+\s*|\s+)", 3: rf"(?:[{DASHES}]\s*|\s+)"}


def alias_pattern(alias: Column, variant: int = 2) -> Column:
    """A whole-word, case-blind pattern: any dash for a dash, either apostrophe (not in variant 1), any joiner for
    a space; (s|es) may follow a single alphabetic word, in variants 2 and 3 the last word of a phrase too."""
    quoted = F.regexp_replace(alias, r"([^\p{L}\p{N}_\s])", r"\\$1")
    quoted = F.regexp_replace(quoted, rf"\\[{DASHES}]", f"[{DASHES}]")
    if variant != 1:
        quoted = F.regexp_replace(quoted, r"\\['’]", "['’]")
    joined = F.regexp_replace(quoted, r"\s+", JOINERS[variant].replace("\\", "\\\\"))
    plural = alias.rlike(r"^\p{L}+$") if variant == 1 else alias.rlike(r"(^|\s)\p{L}+$")
    return F.concat(F.lit(rf"{FLAGS}(?<!{WORD})"), joined, F.when(plural, F.lit("(?:s|es)?")).otherwise(F.lit("")), F.lit(rf"(?!{WORD})"))


def admitted_aliases(motifs: DataFrame, stop: DataFrame | None = None, config: GazetteerConfig = GazetteerConfig()) -> DataFrame:
    """motif_id, alias, nth: the normalized name and aliases of each motif; aliases must be long enough and off the
    stop list, the name always counts."""
    rows = motifs.select("motif_id", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("nth", "raw"))
    rows = rows.select("motif_id", "nth", normalize_alias(F.col("raw")).alias("alias")).where("alias <> ''")
    if stop is not None:
        rows = rows.join(stop.select(F.col("word").alias("alias")).distinct().withColumn("stopped", F.lit(True)), "alias", "left")
    else:
        rows = rows.withColumn("stopped", F.lit(None).cast("boolean"))
    rows = rows.where((F.col("nth") == 0) | ((F.length("alias") >= config.min_length) & F.col("stopped").isNull()))
    return rows.groupBy("motif_id", "alias").agg(F.min("nth").alias("nth"))


CATALOG_BYTES = 32 << 20
OUT_BYTES = 4 << 20  # hits of a batch that a task holds at once, with their texts


def hits(chunks: DataFrame, aliases: DataFrame, variant: int = 2, most_bytes: int = CATALOG_BYTES, with_text: bool = True) -> DataFrame:
    """chunk_id, motif_id, alias, nth, start, end (in the chunk), surface, text (of the chunk; not without with_text).

    A chunk is tried with an alias only if it holds the alias's longest word (or that word's plural where the
    pattern allows one), then if it holds all its words. A catalog whose patterns take at most most_bytes goes to every
    task, which passes once over its chunks; no text is shuffled. A larger one is joined on those words."""
    listed = F.regexp_extract_all(F.lower("alias"), F.lit(rf"({WORD}+)"), F.lit(1))
    longest = F.array_max(F.transform(listed, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    forms = F.when(longest == F.element_at(listed, -1), F.array(longest, F.concat(longest, F.lit("s")), F.concat(longest, F.lit("es")))).otherwise(F.array(longest))
    keyed = aliases.where(F.size(listed) > 0).select("motif_id", "alias", "nth", listed.alias("needs"), alias_pattern(F.col("alias"), variant).alias("pattern"), F.array_distinct(forms).alias("words"))
    size = keyed.agg(F.sum(F.octet_length("alias") * 3 + F.octet_length("pattern") + 64)).first()[0] or 0
    if size > most_bytes:
        found = _joined_hits(chunks, keyed)
        return found if with_text else found.drop("text")
    schema = StructType([
        chunks.schema["chunk_id"], aliases.schema["motif_id"], *StructType.fromDDL("alias string, nth int, start int, end int, surface string" + ", text string" * with_text).fields,
    ])
    return chunks.select("chunk_id", "text").mapInArrow(_scan([tuple(r) for r in keyed.collect()], schema), schema)


def _scan(catalog: list[tuple], schema: StructType):
    """A mapInArrow function over (chunk_id, text) that tries each chunk with the aliases whose words it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import regex

        by_word: dict[str, list[int]] = {}
        for k, (_, _, _, _, _, words) in enumerate(catalog):
            for w in words:
                by_word.setdefault(w, []).append(k)
        patterns: dict[int, object] = {}
        word = re.compile(r"\w+")
        types = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
        with_text = "text" in schema.names

        def made(b: pa.RecordBatch, at: list, out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([b.column("chunk_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], schema.names)

        for b in batches:
            at, out, size = [], [], 0
            for r, text in enumerate(x.as_py() for x in b.column("text")):
                if not text:
                    continue
                low = text.lower()
                for k in sorted({k for w in by_word.keys() & set(word.findall(low)) for k in by_word[w]}):
                    motif, alias, nth, needs, pattern, _ = catalog[k]
                    if not all(n in low for n in needs):
                        continue
                    if k not in patterns:
                        patterns[k] = regex.compile(pattern.removeprefix(FLAGS), regex.IGNORECASE)
                    for m in patterns[k].finditer(text):
                        at.append(r)
                        out.append((motif, alias, nth, m.start(), m.end(), m.group(), *([text] if with_text else [])))
                        size += 256 + (len(text) if with_text else 0)
                        if size > OUT_BYTES:
                            yield made(b, at, out)
                            at, out, size = [], [], 0
            yield made(b, at, out)

    return run


def _joined_hits(chunks: DataFrame, keyed: DataFrame) -> DataFrame:
    """The same by an equi-join on words, for a catalog of any size."""
    keyed = keyed.withColumn("word", F.explode("words")).drop("words")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"({WORD}+)"), F.lit(1)))
    tried = chunks.select("chunk_id", F.explode(words).alias("word")).join(keyed, "word").drop("word").dropDuplicates(["chunk_id", "motif_id", "alias"])
    held = F.lower("text")
    tried = tried.join(chunks.select("chunk_id", "text"), "chunk_id").where(F.forall("needs", lambda w: F.contains(held, w)))
    found = tried.select("*", F.explode(matches(F.col("text"), F.col("pattern"))).alias("hit"))
    return found.select("chunk_id", "motif_id", "alias", "nth", F.col("hit.start").alias("start"), (F.col("hit.start") + F.length("hit.piece")).alias("end"), F.col("hit.piece").alias("surface"), "text")


def unblocked(found: DataFrame, anti: DataFrame | None = None, config: GazetteerConfig = GazetteerConfig()) -> DataFrame:
    """Hits without those whose window holds `anti-`, and without those of motifs one of whose anti phrases
    (motif_id, phrase) stands anywhere in the chunk."""
    w = config.anti_window
    around = F.col("text").substr(F.greatest(F.lit(0), F.col("start") - w) + 1, F.least(F.length("text"), F.col("end") + w) - F.greatest(F.lit(0), F.col("start") - w))
    out = found.where(~around.rlike(ANTI_EDGE)) if config.use_anti else found
    if anti is not None and config.use_anti:
        chunk = found.select("chunk_id", "motif_id", "text").dropDuplicates(["chunk_id", "motif_id"]).join(anti, "motif_id")
        blocked = chunk.where(F.contains(F.lower("text"), F.lower("phrase"))).select("chunk_id", "motif_id").distinct()
        out = out.join(blocked, ["chunk_id", "motif_id"], "left_anti")
    return out


def seeded(found: DataFrame, config: GazetteerConfig = GazetteerConfig()) -> DataFrame:
    """The first hit on each span of a motif, then the first `most_per_motif` of each motif in each work, in order of
    chunk (by char_start), alias and place.

    found: what hits gives, and work_id and char_start of each chunk; without these the chunks are one work, in order
    of their ids, and no two of them share a span."""
    work = [F.col("work_id")] if "work_id" in found.columns else []
    placed = "char_start" in found.columns
    base = F.col("char_start") if placed else F.lit(0)
    order = [base, F.col("chunk_id"), F.col("nth"), F.col("alias"), F.col("start"), F.col("end")]
    one = Window.partitionBy(*work, "motif_id", base + F.col("start"), base + F.col("end"), *([] if placed else ["chunk_id"])).orderBy(*order)
    cap = Window.partitionBy(*work, "motif_id").orderBy(*order)
    rows = found.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return rows.withColumn("_n", F.row_number().over(cap)).where(F.col("_n") <= config.most_per_motif).drop("_n")
