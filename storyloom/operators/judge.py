"""From candidates to findings: union, support, sanity weights, priors, thresholds, prompts and run stamps.

What a language model answers is an input table; everything around it is relational."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.config import JudgeConfig, params
from storyloom.functions import numbers as N
from storyloom.functions.text import extract_json, mentioned, truncated

from .tables import insert_or_replace


def candidate_union(*sources: DataFrame) -> DataFrame:
    """Distinct (scene_id, motif_id) of all sources."""
    out = sources[0].select("scene_id", "motif_id")
    for s in sources[1:]:
        out = out.unionByName(s.select("scene_id", "motif_id"))
    return out.distinct()


def support(hits: DataFrame, picks: DataFrame | None, keep: int = JudgeConfig.keep) -> DataFrame:
    """scene_id, chunk_id, rank, stage1_score, stage2_score, picked, note: the reranker's choice (scene_id, support_ids)
    among the retrieved chunks in its order, unknown ids left out; by similarity where it chose nothing.

    hits: scene_id, chunk_id, similarity, rank."""
    chosen = hits.withColumn("place", F.lit(None).cast("int")).withColumn("said", F.lit(False))
    if picks is not None:
        listed = picks.select("scene_id", F.size("support_ids").alias("_n"), F.posexplode("support_ids").alias("place", "chunk_id")).dropDuplicates(["scene_id", "chunk_id"])
        said = picks.where(F.size("support_ids") > 0).select("scene_id", F.lit(True).alias("said"))
        chosen = hits.join(listed.drop("_n"), ["scene_id", "chunk_id"], "left").join(said, "scene_id", "left").withColumn("said", F.coalesce("said", F.lit(False)))
    wanted = chosen.where(~F.col("said") | F.col("place").isNotNull())
    order = Window.partitionBy("scene_id").orderBy(F.coalesce("place", "rank"), "chunk_id")
    ranked = wanted.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= keep)
    m = F.count("*").over(Window.partitionBy("scene_id"))
    return ranked.select("scene_id", "chunk_id", F.col("new_rank").alias("rank"), F.col("similarity").alias("stage1_score"), ((m - F.col("new_rank") + 1) / m).alias("stage2_score"), F.lit(1).alias("picked"), F.when(F.col("said"), F.lit("")).otherwise(F.lit("fallback=knn")).alias("note"))


def sanity(candidates: DataFrame, scene_texts: DataFrame, phrases: DataFrame, similarities: DataFrame, config: JudgeConfig = JudgeConfig()) -> DataFrame:
    """scene_id, motif_id, lex_ok, sem_sim, weight. scene_texts: scene_id, texts (scene and supports); phrases:
    motif_id, phrases; similarities: scene_id, motif_id, sem_sim. The prior is 1 if the motif is named or near."""
    rows = candidates.join(scene_texts, "scene_id").join(phrases, "motif_id").join(similarities, ["scene_id", "motif_id"], "left")
    rows = rows.select("scene_id", "motif_id", mentioned(F.col("texts"), F.col("phrases")).cast("int").alias("lex_ok"), F.coalesce("sem_sim", F.lit(0.0)).alias("sem_sim"))
    return rows.withColumn("weight", prior("lex_ok", "sem_sim", config))


def prior(lex: str, sem: str, config: JudgeConfig = JudgeConfig()):
    return F.when((F.col(lex) == 1) | (F.col(sem) >= config.similarity_cut), F.lit(1.0)).otherwise(F.lit(config.prior_unmentioned))


def gated(judged: DataFrame, weights: DataFrame, thresholds: DataFrame | None, config: JudgeConfig = JudgeConfig()) -> DataFrame:
    """Judged items (scene_id, motif_id, confidence, rationale, ...) with the prior applied, above their motif's
    threshold or the default, the adjustment written into the rationale where there was one."""
    rows = judged.join(weights.select("scene_id", "motif_id", "weight"), ["scene_id", "motif_id"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    if thresholds is not None:
        rows = rows.join(thresholds.select("motif_id", "threshold"), "motif_id", "left")
    else:
        rows = rows.withColumn("threshold", F.lit(None).cast("double"))
    rows = rows.withColumn("raw", F.col("confidence")).withColumn("confidence", N.clamped(F.col("confidence") * F.col("weight")))
    rows = rows.withColumn("threshold_used", F.coalesce("threshold", F.lit(config.threshold))).where(F.col("confidence") >= F.col("threshold_used"))
    note = F.format_string(" [prior=%.2f, raw=%.2f, adj=%.2f]", "weight", "raw", "confidence")
    return rows.withColumn("rationale", F.when(F.col("weight") != 1, F.concat(F.coalesce("rationale", F.lit("")), note)).otherwise(F.col("rationale"))).drop("threshold", "raw")


def placed(judged: DataFrame, scenes: DataFrame, works: DataFrame) -> DataFrame:
    """Evidence spans for judged items: theirs, or the scene's, inside the work and the right way round; in_scene
    says whether the span also lies in its scene."""
    rows = judged.join(scenes.select("scene_id", "work_id", F.col("char_start").alias("_s"), F.col("char_end").alias("_e")), "scene_id").join(works.select("work_id", "char_count"), "work_id")
    a, b = N.clipped(F.coalesce("start", "_s"), F.coalesce("end", "_e"), F.col("char_count"))
    return rows.withColumn("evidence_start", a).withColumn("evidence_end", b).withColumn("in_scene", (a >= F.col("_s")) & (b <= F.col("_e"))).drop("_s", "_e", "char_count", "start", "end")


FINDING_KEY = ["work_id", "motif_id", "evidence_start", "evidence_end"]


def judge(old: DataFrame, judged: DataFrame, candidates: DataFrame | None, weights: DataFrame, thresholds: DataFrame | None, scenes: DataFrame, works: DataFrame, run_id: str, config: JudgeConfig = JudgeConfig()) -> DataFrame:
    """The findings table after a run: candidates only (if given), gated, placed, and written over findings on the same span."""
    if candidates is not None:
        judged = judged.join(candidates, ["scene_id", "motif_id"], "left_semi")
    new = placed(gated(judged, weights, thresholds, config), scenes, works).withColumn("run_id", F.lit(run_id)).withColumn("level", F.lit("scene"))
    names = old.columns
    return insert_or_replace(old, new.select(names), FINDING_KEY, [F.desc("confidence"), "scene_id"])


def prompts(candidates: DataFrame, scene_texts: DataFrame, definitions: DataFrame, supports: DataFrame, weights: DataFrame, config: JudgeConfig = JudgeConfig()) -> DataFrame:
    """scene_id, prompt: the scene's text, its supports and its candidates with their priors, each within its budget."""
    defs = candidates.join(definitions, "motif_id").join(weights.select("scene_id", "motif_id", "weight"), ["scene_id", "motif_id"], "left")
    line = F.format_string("- %s | %s | PRIOR=%.2f | %s", "motif_id", "name", F.coalesce("weight", F.lit(1.0)), F.coalesce("summary", F.lit("")))
    defs = defs.groupBy("scene_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("defs"))
    quote = F.format_string("[%d] %s", "rank", truncated(F.regexp_replace("text", r"\s+", " "), config.snippet))
    cited = supports.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("rank", quote.alias("q")))).alias("q")).select("scene_id", F.array_join("q.q", "\n").alias("quotes"))
    out = scene_texts.join(defs, "scene_id").join(cited, "scene_id", "left")
    return out.select("scene_id", F.concat_ws("\n\n", F.lit("SCENE"), F.substring("text", 1, config.scene_prompt), F.lit("SUPPORT"), F.coalesce("quotes", F.lit("")), F.lit("MOTIFS"), "defs").alias("prompt"))


def rerank_items(hits: DataFrame, chunks: DataFrame, config: JudgeConfig = JudgeConfig()) -> DataFrame:
    """scene_id, items: what a reranker sees of each scene's hits (scene_id, chunk_id, similarity, rank) in their order, as
    JSON: id, knn (clamped, three places), len and a snippet."""
    rows = hits.join(chunks.select("chunk_id", "text"), "chunk_id")
    text = F.coalesce("text", F.lit(""))
    item = F.struct(F.col("chunk_id").alias("id"), F.round(N.clamped(F.col("similarity")), 3).alias("knn"), F.length(text).alias("len"), truncated(F.trim(text), config.snippet).alias("snippet"))
    listed = rows.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))).alias("x"))
    return listed.select("scene_id", F.to_json("x.item").alias("items"))


def parsed_picks(answers: DataFrame) -> DataFrame:
    """scene_id, support_ids, notes from a reranker's answers (scene_id, answer); what can't be read picks nothing."""
    said = extract_json(F.col("answer"), "support_ids array<string>, notes string")
    return answers.select("scene_id", said.alias("a")).select("scene_id", F.coalesce("a.support_ids", F.array().cast("array<string>")).alias("support_ids"), F.trim(F.coalesce("a.notes", F.lit(""))).alias("notes"))


def parsed_findings(answers: DataFrame) -> DataFrame:
    """Judged items (scene_id, motif_id, confidence, rationale, start, end) from a judge's answers (scene_id, answer): a
    JSON array of objects, bare, fenced or somewhere in the text; what can't be read holds no item."""
    said = extract_json(F.col("answer"), "array<struct<trope_id:string,confidence:double,evidence_char_span:array<int>,rationale:string>>")
    rows = answers.select("scene_id", F.explode(said).alias("x")).where("x.trope_id is not null")
    at = lambda k: F.get("x.evidence_char_span", F.lit(k))
    return rows.select("scene_id", F.col("x.trope_id").alias("motif_id"), F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"), F.col("x.rationale").alias("rationale"), at(0).alias("start"), at(1).alias("end"))


def run_stamp(spark, run_id: str, *configs) -> DataFrame:
    """The one row that records a run's knobs."""
    said = json.dumps(params(*configs), sort_keys=True).replace("\\", "\\\\").replace("'", "\\'")
    return spark.sql(f"SELECT '{run_id}' AS id, current_timestamp() AS created_at, '{said}' AS params_json")
