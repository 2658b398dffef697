"""Evidence spans: containment, the sentences around them, snapping, verification and cue flags."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DecimalType, DoubleType, StructField, StructType

from storyloom.config import VerifierConfig
from storyloom.functions import numbers as N
from storyloom.functions.text import ANTI_EDGE, DASHES, META_CUES, NEGATION, STRONG_NEGATION, WORD, matches

from .gazetteer import alias_pattern
from .segment import sentences


def inside(findings: DataFrame, chunks: DataFrame, by: str, cell: int = 4096) -> DataFrame:
    """Findings with the chunks of the same work that hold their span: an equi-join on the work and on the cells
    of `cell` code points that a chunk touches, so that a long work is not one key."""
    reach = F.explode(F.sequence(F.floor(F.col("char_start") / cell), F.floor(F.greatest("char_end", "char_start") / cell)))
    left = findings.withColumn("_cell", F.floor(F.col("start") / cell))
    right = chunks.withColumn("_cell", reach)
    return left.join(right, [by, "_cell"]).where((F.col("start") >= F.col("char_start")) & (F.col("end") <= F.col("char_end"))).drop("_cell")


def first_overlapping(sents: Column, start: Column, end: Column) -> Column:
    """Number of the first sentence that meets [start, end); 0 if none does."""
    numbered = F.transform(sents, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["end"].alias("end")))
    met = F.filter(numbered, lambda s: ~((s["end"] <= start) | (s["start"] >= end)))
    return F.coalesce(F.get(met, 0)["i"], F.lit(0))


def sentence_of(sents: Column, start: Column, end: Column) -> Column:
    """struct<start, end> of the sentence that holds the span's middle, else the one whose centre is nearest."""
    middle = F.floor((start + end) / 2)
    ranked = F.transform(sents, lambda s, i: F.struct((~((s["start"] <= middle) & (middle < s["end"]))).cast("int").alias("out"), F.abs(F.floor((s["start"] + s["end"]) / 2) - middle).cast("double").alias("far"), i.alias("i"), s["start"].alias("start"), s["end"].alias("end")))
    best = F.array_min(F.transform(ranked, lambda s: F.struct(s["out"].alias("out"), F.when(s["out"] == 0, F.lit(0.0)).otherwise(s["far"]).alias("far"), s["i"].alias("i"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.struct(best["start"].alias("start"), best["end"].alias("end"))


def sentence_zones(works: DataFrame, by: str, cell: int) -> DataFrame:
    """by, zone_start, zone_end, sentence and _cell: for each sentence of a text the middles whose sentence_of it is, once
    for each cell of `cell` code points that this zone touches.

    Sentences stand in order and apart, so their centres ascend: between two of them the nearer centre is that of one of
    the two, and the zones of a text cover [0, length] without overlap. Join on by and floor(middle / cell)."""
    s, n = F.col("_s"), F.length("text")
    centre = lambda x: F.floor((x["start"] + x["end"]) / 2)
    half = lambda x, y: F.floor((centre(x) + centre(y)) / 2) + 1
    bound = lambda x, y: F.greatest(x["end"].cast("long"), F.least(half(x, y), y["start"].cast("long")))
    start = lambda x, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(bound(F.get(s, i - 1), x))
    end = lambda x, i: F.when(i == F.size(s) - 1, F.greatest(n, x["end"]).cast("long") + 1).otherwise(bound(x, F.get(s, i + 1)))
    zones = F.transform(s, lambda x, i: F.struct(start(x, i).alias("zone_start"), end(x, i).alias("zone_end"), F.col("text").substr(x["start"] + 1, x["end"] - x["start"]).alias("sentence")))
    rows = works.where("text is not null").select(by, "text", sentences(F.col("text")).alias("_s")).select(by, F.explode(zones).alias("_z")).select(by, "_z.*").where("zone_end > zone_start")
    return rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("zone_start") / cell), F.floor((F.col("zone_end") - 1) / cell))))


def snapped(text: Column, start: Column, end: Column, most: int = 280) -> Column:
    """struct<start, end>: out to the end of the last boundary before the start and of the first one that begins at or
    after the end; if that is longer than `most`, a window of `most` around the middle of the span."""
    a, b = N.clipped(start, end, F.length(text))

    def fit(v: Column) -> Column:
        low = F.coalesce(F.array_max(F.filter(F.transform(v["m"], lambda m: m["start"] + F.length(m["piece"])), lambda c: c <= v["a"])), F.lit(0))
        high = F.coalesce(F.array_min(F.transform(F.filter(v["m"], lambda m: m["start"] >= v["b"]), lambda m: m["start"] + F.length(m["piece"]))), v["n"])
        size = F.least(F.lit(most), v["n"])
        left = F.greatest(F.lit(0), F.least(F.floor((v["a"] + v["b"]) / 2) - F.floor(size / 2), v["n"] - size))
        long = high - low > size
        return F.struct(F.when(long, left).otherwise(low).cast("int").alias("start"), F.when(long, left + size).otherwise(high).cast("int").alias("end"))

    held = F.array(F.struct(matches(text, r"[.!?]\"?\s").alias("m"), a.alias("a"), b.alias("b"), F.length(text).alias("n")))
    return F.get(F.transform(held, fit), F.lit(0))


def snapped_to_sentences(text: Column, start: Column, end: Column) -> Column:
    """struct<start, end>: out to the sentence cuts (variant C) around the span."""
    cuts = F.concat(F.array(F.lit(0)), F.transform(sentences(text, "C"), lambda s: s["end"]))
    return F.struct(F.coalesce(F.array_max(F.filter(cuts, lambda c: c <= start)), F.lit(0)).alias("start"), F.coalesce(F.array_min(F.filter(cuts, lambda c: c >= end)), F.length(text)).alias("end"))


def adopted_edits(scored: DataFrame, gain: float = 0.05, reviewer: str = "verifier") -> DataFrame:
    """Log rows for the snapped spans (finding_id, start, end, old_score, new_score) that are enough better."""
    rows = scored.where(F.col("new_score") - F.col("old_score") >= gain)
    return rows.select("finding_id", F.lit("edit").alias("decision"), F.col("start").alias("corrected_start"), F.col("end").alias("corrected_end"), F.lit(reviewer).alias("reviewer"))


def candidate_windows(sents: Column, start: Column, end: Column, n: Column, config: VerifierConfig = VerifierConfig()) -> Column:
    """Distinct array<struct<start, end>> in a text of n characters: the span itself, and from the sentence that meets
    it up to `sentences` more to one side; what is too long, the span too, becomes the `most_chars` around the
    span's middle."""
    steps = range(-config.sentences, config.sentences + 1)

    def windows(v: Column) -> Column:
        """v: one struct that holds the sentences and what is computed from them, so that each is computed once."""
        from_ = F.greatest(F.lit(0), F.least(v["middle"] - config.most_chars // 2, v["n"] - config.most_chars))

        def fit(a: Column, b: Column) -> Column:
            long = b - a > config.most_chars
            return F.struct(F.when(long, from_).otherwise(a).cast("int").alias("start"), F.when(long, F.least(v["n"], from_ + config.most_chars)).otherwise(b).cast("int").alias("end"))

        def run(k: int) -> Column:
            here = F.get(v["s"], v["at"])
            there = F.get(v["s"], F.greatest(F.lit(0), F.least(F.size(v["s"]) - 1, v["at"] + k)))
            return fit(F.least(here["start"], there["start"]), F.greatest(here["end"], there["end"]))

        return F.array(fit(v["start"], v["end"]), *map(run, steps))

    held = F.transform(
        F.array(sents),
        lambda s: F.struct(s.alias("s"), first_overlapping(s, start, end).alias("at"), F.floor((start + end) / 2).cast("int").alias("middle"), n.alias("n"), start.cast("int").alias("start"), end.cast("int").alias("end")),
    )
    return F.array_distinct(F.flatten(F.transform(held, windows)))


def verified(scored: DataFrame, config: VerifierConfig = VerifierConfig()) -> DataFrame:
    """Choose among scored candidates of each finding (finding_id, start, end, is_original, text, motif_similarity,
    scene_similarity): score, flag, and the best span if it is enough better or lifts the finding over the threshold."""
    score = config.alpha * F.col("motif_similarity") + (1 - config.alpha) * F.col("scene_similarity")
    rows = scored.withColumn("score", F.round(score, 6))
    best = F.max_by(F.struct("start", "end", "text", "score"), F.struct("score", F.col("is_original").cast("int"), -F.col("start"), -F.col("end")))
    out = rows.groupBy("finding_id").agg(best.alias("best"), F.max(F.when(F.col("is_original"), F.struct("score", "start", "end"))).alias("orig"))
    b, o, t = F.col("best.score"), F.coalesce(F.col("orig.score"), F.lit(0.0)), config.threshold
    moved = ~((F.col("best.start") == F.col("orig.start")) & (F.col("best.end") == F.col("orig.end")))
    adopt = F.coalesce(moved, F.lit(True)) & ((b >= o + config.gain) | ((o < t) & (b >= t)))
    flag = F.when(b < t, "low_sim").when(F.col("best.text").rlike(NEGATION), "negation_cue").otherwise("ok")
    pick = lambda c: F.when(adopt, F.col(f"best.{c}")).otherwise(F.col(f"orig.{c}"))
    return out.select("finding_id", pick("start").alias("start"), pick("end").alias("end"), b.alias("verifier_score"), flag.alias("verifier_flag"), adopt.alias("adopted"))


def cue_flags(rows: DataFrame, aliases: str | None = None, config: VerifierConfig = VerifierConfig()) -> DataFrame:
    """Adds neg, meta, anti, verifier_flag and verified_confidence from the window around [start, end) of text.

    With a column `aliases` (array of a motif's normalized name and aliases), `not` within 16 characters of a hit of
    any of them counts as negation, and only `anti` right before one as an anti form."""
    w = config.window
    low = F.greatest(F.lit(0), F.col("start") - w)
    window = F.col("text").substr(low + 1, F.greatest(F.lit(0), F.least(F.length("text"), F.col("end") + w) - low))
    neg, meta = window.rlike(STRONG_NEGATION), window.rlike(META_CUES)
    anti = window.rlike(ANTI_EDGE)
    if aliases:
        body = lambda a: F.regexp_replace(alias_pattern(a), r"^\(\?iuU\)", "")
        near = lambda a: F.concat(F.lit(r"(?iuU)(?s)(\bnot\b.{0,13}"), body(a), F.lit("|"), body(a), F.lit(r".{0,13}\bnot\b)"))
        before = lambda a: F.concat(F.lit(rf"(?iuU)(?<!{WORD})anti(?:[{DASHES}]\s*|\s+)"), body(a))
        said = lambda word: F.contains(F.lower(window), F.lit(word))
        neg = neg | (said("not") & F.exists(aliases, lambda a: F.regexp(window, near(a))))
        anti = said("anti") & F.exists(aliases, lambda a: F.regexp(window, before(a)))
    rows = rows.withColumn("neg", neg).withColumn("meta", meta).withColumn("anti", anti)
    flag = F.when(F.col("neg") & F.col("anti"), "negation_anti").when(F.col("neg"), "negation_cue").when(F.col("anti"), "anti_alias").when(F.col("meta"), "meta_cue")
    factor = F.when(F.col("neg"), config.negation_factor).otherwise(1.0) * F.when(F.col("meta"), config.meta_factor).otherwise(1.0) * F.when(F.col("anti"), config.anti_factor).otherwise(1.0)
    return rows.withColumn("verifier_flag", flag).withColumn("verified_confidence", N.clamped(F.col("confidence") * factor))


MODES = ("downweight", "flag", "delete")


def applied_flags(flagged: DataFrame, mode: str = "downweight") -> DataFrame:
    """What a verifier run leaves of findings that cue_flags has seen: downweight puts the verified confidence in place
    of the old one, flag leaves it as it was, delete drops the findings with a flag."""
    match mode:
        case "downweight":
            return flagged.withColumn("confidence", F.col("verified_confidence"))
        case "flag":
            return flagged
        case "delete":
            return flagged.where("verifier_flag is null")
        case _:
            raise ValueError(f"unknown mode {mode}; one of {', '.join(MODES)}")


def matched_one_to_one(predicted: DataFrame, truth: DataFrame, by: list[str], least: float = 0.3, cell: int = 1024) -> DataFrame:
    """Greedy one-to-one matches of spans within each group `by`: truths in order of start take the free prediction
    of greatest overlap. Returns by, truth_id, predicted_id, iou.

    No pairs are made: the spans of a group come in order of start, and a sweep in Python keeps those that may still
    meet a later one, equal spans as one entry. Shuffle and memory follow the spans, not their pairs. Rows without an id,
    a group or a place are left out; `cell` (from when pairs were joined on cells) changes nothing."""
    t = truth.select(*by, F.lit(0).alias("_kind"), "truth_id", F.lit(None).cast(predicted.schema["predicted_id"].dataType).alias("predicted_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    p = predicted.select(*by, F.lit(1).alias("_kind"), F.lit(None).cast(truth.schema["truth_id"].dataType).alias("truth_id"), "predicted_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    rows = t.unionByName(p)
    rows = rows.select(*(F.col(c).cast("double") if c in ("_s", "_e") and isinstance(f.dataType, DecimalType) else F.col(c) for c, f in zip(rows.columns, rows.schema.fields, strict=True)))
    held = F.when(F.col("_kind") == 0, F.col("truth_id").isNotNull()).otherwise(F.col("predicted_id").isNotNull())
    for c in (*by, "_s", "_e"):
        held = held & F.col(c).isNotNull()
    schema = StructType([*(rows.schema[c] for c in (*by, "truth_id", "predicted_id")), StructField("iou", DoubleType())])
    rows = rows.where(held).repartition(*by).sortWithinPartitions(*by, "_s", "_kind", "truth_id", "_e", "predicted_id")
    return rows.mapInArrow(_sweep(by, least, schema), schema)


def _sweep(by: list[str], least: float, schema: StructType):
    """A mapInArrow function over the spans of whole groups, in order of start, truths first."""

    def taken(start, ends: list, free: dict, used: set):
        """(-iou, id) of the free prediction that overlaps most, the least id among equals; spans that end before any
        later truth starts go."""
        best, gone = None, []
        for span, ids in free.items():
            s, e = span
            if e <= start:
                gone.append(span)
                continue
            for end in ends:
                if s < end:
                    both, union = min(end, e) - max(start, s), max(end, e) - min(start, s)
                    iou = both / union if both > 0 and union > 0 else 0.0
                    if iou < least or (best is not None and -iou > best[0]):
                        continue
                    while ids and ids[0] in used:
                        ids.popleft()
                    if not ids:
                        gone.append(span)
                        break
                    if best is None or (-iou, ids[0]) < best:
                        best = (-iou, ids[0])
        for span in gone:
            del free[span]
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(f.dataType) for f in schema.fields]
        key, waiting, free, used, out = None, deque(), {}, set(), []

        def settle(upto=None) -> None:
            """Match the truths that no span from `upto` on can meet."""
            while waiting and (upto is None or (waiting[0][0] < upto and max(waiting[0][2]) <= upto)):
                start, name, ends = waiting.popleft()
                if best := taken(start, ends, free, used):
                    used.add(best[1])
                    out.append((*key, name, best[1], -best[0]))

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in by), strict=True) if by else repeat((), b.num_rows)
            for here, *row in zip(keys, *(b.column(c).to_pylist() for c in ("_kind", "truth_id", "predicted_id", "_s", "_e")), strict=True):
                kind, name, found, start, end = row
                if here != key:
                    settle()
                    key, free, used = here, {}, set()
                elif waiting:
                    settle(start)
                if kind:
                    free.setdefault((start, end), deque()).append(found)
                elif waiting and waiting[-1][:2] == (start, name):
                    waiting[-1][2].append(end)
                else:
                    waiting.append((start, name, [end]))
            yield made()
        settle()
        yield made()

    return run


def match_report(matches: DataFrame, predicted: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1."""
    n = lambda df, c: df.groupBy(*by).agg(F.count("*").alias(c))
    out = n(predicted, "p").join(n(truth, "t"), by, "full_outer").join(n(matches, "tp"), by, "left").na.fill(0)
    out = out.select(*by, "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))
    precision, recall = N.ratio(F.col("tp"), F.col("tp") + F.col("fp")), N.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select("*", precision.alias("precision"), recall.alias("recall"), N.f1(precision, recall).alias("f1"))
