"""A folder of Parquet tables and the steps from files to reviewed findings over it.

Each step reads the latest snapshots and writes a new one of the table that it changes; a snapshot counts once it
is complete, so a step that fails leaves the old one. Models come in as providers; by default they are offline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.config import CalibrationConfig, ChunkConfig, GazetteerConfig, JudgeConfig, SemanticConfig, VerifierConfig
from storyloom.functions import numbers as N
from storyloom.functions.text import motif_query, motif_text, normalize_alias, normalize_text
from storyloom.operators import calibrate, catalog, gazetteer, judge, review, segment, spans, tables, vectors
from storyloom.sources import files, providers


def _id(*parts):
    return F.sha2(F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)), 256)


def _number(c: str):
    return F.xxhash64(c)


class Workspace:
    def __init__(self, spark: SparkSession, folder: str, embedder: providers.Embedder | None = None):
        self.spark, self.folder, self.embedder = spark, folder, embedder or providers.HashingEmbedder()

    # ------------------------------------------------------------ tables

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _snapshots(self, name: str) -> list[str]:
        """Paths of the table's complete snapshots, oldest first."""
        fs, at = self._fs(f"{self.folder}/{name}")
        found = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(p.toString() for p in found if fs.exists(self._fs(f"{p.toString()}/_SUCCESS")[1]))

    def has(self, name: str) -> bool:
        return bool(self._snapshots(name))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._snapshots(name)[-1])

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """A new snapshot; the ones before stay for readers that hold them, until vacuum()."""
        number = int(self._snapshots(name)[-1].rsplit("/", 1)[1]) + 1 if self.has(name) else 1
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{number:08d}")
        return self.table(name)

    def vacuum(self, name: str, keep: int = 1) -> None:
        for path in self._snapshots(name)[:-keep]:
            fs, at = self._fs(path)
            fs.delete(at, True)

    def _add(self, name: str, new: DataFrame, key: list[str], order: list) -> DataFrame:
        """Insert or ignore."""
        one = tables.first_of_each(new, key, order)
        return self.put(name, tables.insert_or_ignore(self.table(name), one, key, order) if self.has(name) else one)

    # ------------------------------------------------------------ texts

    def ingest(self, folder: str, glob: str = "*.txt", encoding: str = "auto", author: str = "Unknown Author", config: ChunkConfig = ChunkConfig()) -> dict[str, int]:
        """Files to works, chapters, scenes and chunks (of the whole workspace, anew); returns the counts."""
        read = files.read_texts(self.spark, folder, glob, encoding).where("error is null")
        new = read.select("work_id", "title", F.lit(author).alias("author"), "raw_text", normalize_text(F.col("raw_text")).alias("text"))
        works = self._add("work", new.withColumn("char_count", F.length("text")), ["work_id"], ["title"])
        parts = segment.segment(works.select("work_id", "text"), "work_id", config)
        self.put("chapter", parts["chapter"])
        scenes = parts["scene"].withColumnRenamed("idx", "scene").withColumn("scene_id", _id("work_id", "chapter", "scene"))
        self.put("scene", scenes)
        chunks = parts["chunk"].withColumn("scene_id", _id("work_id", "chapter", "scene")).withColumn("chunk_id", _id("work_id", "chapter", "scene", "idx"))
        self.put("chunk", chunks)
        return {n: self.table(n).count() for n in ("work", "chapter", "scene", "chunk")}

    def statistics(self, config: ChunkConfig = ChunkConfig()) -> DataFrame:
        return segment.statistics(self.table("work").select("work_id", "text"), "work_id", config)

    # ------------------------------------------------------------ catalog and vectors

    def load_catalog(self, path: str, clear: bool = False) -> DataFrame:
        new = catalog.loaded(files.read_catalog(self.spark, path))
        keep = self.has("motif") and not clear
        return self.put("motif", catalog.merged(self.table("motif"), new) if keep else new.dropDuplicates(["motif_id"]))

    def expand_aliases(self, answers: DataFrame) -> DataFrame:
        """Merge proposed aliases (motif_id, proposed) into the catalog after cleaning."""
        rows = self.table("motif").join(answers, "motif_id", "left")
        clean = catalog.cleaned_aliases(rows, "proposed", "name", "clean")
        return self.put("motif", clean.withColumn("aliases", catalog.merged_aliases(F.col("aliases"), F.col("clean"))).drop("clean", "proposed"))

    def embed(self, collection: str = "main", model: str = "hashing") -> DataFrame:
        """Vectors for the chunks that have none yet in the collection, and for the catalog."""
        refs = self.table("embedding_ref") if self.has("embedding_ref") else self.spark.createDataFrame([], "chunk_id string, collection string, model string, dim int")
        new, added = providers.incrementally_embedded(self.table("chunk").select("chunk_id", "scene_id", "work_id", "text"), refs, collection, model, self.embedder)
        rows = new.select("chunk_id", "scene_id", "work_id", "embedding")
        rows = tables.insert_or_ignore(self.table("vector"), rows, ["chunk_id"], ["chunk_id"]) if self.has("vector") else rows
        self.put("vector", rows)
        self.put("embedding_ref", refs.unionByName(added))
        m = self.table("motif").withColumn("entry", motif_text(F.col("name"), F.col("summary"), F.col("aliases"))).withColumn("asked", motif_query(F.col("name"), F.col("summary"), F.col("aliases")))
        v = providers.embedded(m.select("motif_id", F.col("asked").alias("t")), "t", self.embedder)
        return self.put("motif_vector", v.select("motif_id", "embedding"))

    # ------------------------------------------------------------ candidates

    def seed_dictionary(self, stop: str | None = None, config: GazetteerConfig = GazetteerConfig()) -> DataFrame:
        m = self.table("motif")
        aliases = gazetteer.admitted_aliases(m, files.read_stop_words(self.spark, stop), config)
        anti = m.select("motif_id", F.explode("anti_aliases").alias("phrase"))
        chunks = self.table("chunk").select("chunk_id", "scene_id", "work_id", "char_start", "text")
        hits = gazetteer.unblocked(gazetteer.hits(chunks, aliases), anti, config).drop("text").join(chunks.drop("text"), "chunk_id")
        rows = gazetteer.seeded(hits, config).select("work_id", "scene_id", "chunk_id", "motif_id", "surface", "alias", (F.col("start") + F.col("char_start")).alias("start"), (F.col("end") + F.col("char_start")).alias("end"), F.lit("dictionary").alias("source"), F.lit(1.0).alias("score"))
        return self._add("candidate", rows, ["work_id", "motif_id", "start", "end"], ["chunk_id", "alias"])

    def seed_semantic(self, config: SemanticConfig = SemanticConfig()) -> DataFrame:
        v = self.table("vector").withColumn("item_id", _number("chunk_id"))
        q = self.table("motif_vector").withColumn("query_id", _number("motif_id"))
        found = vectors.nearest(q.select("query_id", "embedding"), v.select("item_id", "embedding", "work_id"), config.top_n, config.least_similarity, by="work_id")
        found = found.join(v.select("item_id", "chunk_id", "scene_id"), "item_id").join(q.select("query_id", "motif_id"), "query_id")
        found = vectors.capped_by_scene(found, None, config.most_per_scene).join(self.table("chunk").select("chunk_id", "char_start", "char_end"), "chunk_id")
        rows = found.select("work_id", "scene_id", "chunk_id", "motif_id", F.lit(None).cast("string").alias("surface"), F.lit(None).cast("string").alias("alias"), F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.lit("semantic").alias("source"), F.col("similarity").alias("score"))
        return self._add("candidate", rows, ["work_id", "motif_id", "start", "end"], [F.desc("score"), "chunk_id"])

    # ------------------------------------------------------------ judging

    def shortlist_catalog(self, config: JudgeConfig = JudgeConfig()) -> DataFrame:
        """The candidates that judging looks at, of every scene: the seeds; where there are none, motifs an alias of which
        stands in the scene; and the motifs of the catalog that are nearest to the scene."""
        scenes, m = self.table("scene"), self.table("motif")
        seeds = judge.candidate_union(self.table("candidate"))
        unseeded = scenes.join(seeds.select("scene_id").distinct(), "scene_id", "left_anti").select(F.col("scene_id").alias("chunk_id"), "text")
        named = gazetteer.hits(unseeded, gazetteer.admitted_aliases(m, files.read_stop_words(self.spark, None))).select(F.col("chunk_id").alias("scene_id"), "motif_id")
        sv = providers.embedded(scenes.select("scene_id", F.substring("text", 1, config.shortlist_chars).alias("text")), "text", self.embedder)
        near = vectors.shortlist(sv, self.table("motif_vector"), config.shortlist)
        return self.put("scene_candidate", judge.candidate_union(seeds, named, near))

    def _candidates(self) -> DataFrame:
        return self.table("scene_candidate") if self.has("scene_candidate") else judge.candidate_union(self.table("candidate"))

    def select_support(self, picks: DataFrame | None = None, config: JudgeConfig = JudgeConfig()) -> tuple[DataFrame, DataFrame]:
        """Supports of every scene among its work's chunks, and each candidate's sanity weight."""
        scenes = self.table("scene")
        sv = providers.embedded(scenes.select("scene_id", "work_id", "text"), "text", self.embedder).where("embedding is not null")
        v = self.table("vector").withColumn("item_id", _number("chunk_id"))
        near = vectors.nearest_within(sv.select("work_id", _number("scene_id").alias("query_id"), "embedding"), v.select("work_id", "item_id", "embedding"), "work_id", config.top_k)
        hits = near.join(scenes.select("scene_id", _number("scene_id").alias("query_id")), "query_id").join(v.select("item_id", "chunk_id"), "item_id").select("scene_id", "chunk_id", "similarity", "rank")
        support = self.put("support_selection", judge.support(hits, picks, config.keep))
        c = self._candidates()
        ranked = F.sort_array(F.collect_list(F.struct("rank", "text")))
        quoted = support.join(self.table("chunk").select("chunk_id", "text"), "chunk_id").groupBy("scene_id").agg(ranked.alias("r")).select("scene_id", F.col("r.text").alias("more"))
        texts = scenes.join(quoted, "scene_id", "left").select("scene_id", F.concat(F.array("text"), F.coalesce("more", F.array().cast("array<string>"))).alias("texts"))
        phrases = self.table("motif").select("motif_id", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("phrases"))
        mv = self.table("motif_vector").withColumnRenamed("embedding", "m")
        joined = providers.embedded(quoted.select("scene_id", F.array_join("more", " ").alias("text")), "text", self.embedder).where("embedding is not null").select("scene_id", F.col("embedding").alias("quoted"))
        sims = c.join(sv.select("scene_id", "embedding"), "scene_id").join(joined, "scene_id").join(mv, "motif_id")
        sims = sims.select("scene_id", "motif_id", F.greatest(N.cosine(F.col("embedding"), F.col("m")), N.cosine(F.col("quoted"), F.col("m"))).alias("sem_sim"))
        return support, self.put("motif_sanity", judge.sanity(c, texts, phrases, sims, config))

    def prompts(self, config: JudgeConfig = JudgeConfig()) -> DataFrame:
        quoted = self.table("support_selection").join(self.table("chunk").select("chunk_id", "text"), "chunk_id").select("scene_id", "rank", "text")
        return judge.prompts(self._candidates(), self.table("scene").select("scene_id", "text"), self.table("motif").select("motif_id", "name", "summary"), quoted, self.table("motif_sanity"), config)

    def judge(self, answers: DataFrame, run_id: str, config: JudgeConfig = JudgeConfig()) -> DataFrame:
        """Findings from answers (scene_id, motif_id, confidence, rationale, start, end), candidates only."""
        names = ["work_id", "scene_id", "motif_id", "level", "confidence", "rationale", "evidence_start", "evidence_end", "threshold_used", "run_id"]
        kinds = "work_id string, scene_id string, motif_id string, level string, confidence double, rationale string, evidence_start int, evidence_end int, threshold_used double, run_id string"
        old = self.table("finding").select(names) if self.has("finding") else self.spark.createDataFrame([], kinds)
        limits = self.table("motif_threshold") if self.has("motif_threshold") else None
        out = judge.judge(old, answers, self._candidates(), self.table("motif_sanity"), limits, self.table("scene"), self.table("work"), run_id, config)
        stamp = judge.run_stamp(self.spark, run_id, config)
        self.put("run", tables.insert_or_replace(self.table("run"), stamp, ["id"], ["id"]) if self.has("run") else stamp)
        return self.put("finding", out.withColumn("finding_id", _id("work_id", "motif_id", "evidence_start", "evidence_end")))

    def verify(self, config: VerifierConfig = VerifierConfig()) -> DataFrame:
        """Better spans and similarity flags, then cue flags; returns findings with both."""
        f = self.table("finding").join(self.table("scene").select("scene_id", F.col("char_start").alias("base"), "text"), "scene_id").join(self.table("motif").select("motif_id", "name", "summary", "aliases"), "motif_id")
        a, b = N.clipped(F.col("evidence_start") - F.col("base"), F.col("evidence_end") - F.col("base"), F.length("text"))
        f = f.withColumn("s", a).withColumn("e", b).withColumn("sents", segment.sentences(F.col("text")))
        c = f.select("*", F.posexplode(spans.candidate_windows(F.col("sents"), F.col("s"), F.col("e"), F.length("text"), config)).alias("k", "w"))
        c = c.select("finding_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), (F.col("k") == 0).alias("is_original"), F.col("text").substr(F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("span"), F.concat_ws(". ", "name", "summary").alias("motif"), F.substring("text", 1, 4096).alias("scene"))
        texts = c.select(F.explode(F.array("span", "motif", "scene")).alias("t")).distinct()
        e = providers.embedded(texts, "t", self.embedder)
        for name in ("span", "motif", "scene"):
            c = c.join(e.select(F.col("t").alias(name), F.col("embedding").alias(f"{name}_v")), name, "left")
        scored = c.select("finding_id", "start", "end", "is_original", F.col("span").alias("text"), F.coalesce(N.cosine(F.col("span_v"), F.col("motif_v")), F.lit(0.0)).alias("motif_similarity"), F.coalesce(N.cosine(F.col("span_v"), F.col("scene_v")), F.lit(0.0)).alias("scene_similarity"))
        best = spans.verified(scored, config).withColumnRenamed("start", "ns").withColumnRenamed("end", "ne")
        out = f.drop("sents").join(best, "finding_id").withColumnRenamed("verifier_flag", "similarity_flag")
        out = spans.cue_flags(out.withColumn("start", F.col("ns")).withColumn("end", F.col("ne")).withColumn("_said", F.filter(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), normalize_alias)), lambda a: a != "")), "_said", config)
        return out.select("finding_id", "work_id", "scene_id", "motif_id", (F.col("ns") + F.col("base")).alias("start"), (F.col("ne") + F.col("base")).alias("end"), "confidence", "verifier_score", "similarity_flag", F.col("verifier_flag").alias("cue_flag"), "verified_confidence", "adopted")

    # ------------------------------------------------------------ review and calibration

    def decide(self, decisions: DataFrame) -> DataFrame:
        """Append to the log (id, finding_id, decision, created_at)."""
        return self.put("decision", review.append_decision(self.table("decision"), decisions) if self.has("decision") else decisions)

    def calibrate(self, config: CalibrationConfig = CalibrationConfig()) -> tuple[DataFrame, DataFrame]:
        """The chosen threshold for all, and one for each motif that has enough decisions (used by the next judging)."""
        points = calibrate.labelled(self.table("finding"), review.latest_decisions(self.table("decision")))
        swept = calibrate.sweep(points, calibrate.thresholds(config.step))
        return calibrate.choose(swept, config.objective, config.min_precision, config.min_recall), self.put("motif_threshold", calibrate.motif_thresholds(points, config))
