from pyspark.sql import functions as F

from storyloom.config import CalibrationConfig, ChunkConfig, SemanticConfig
from storyloom.operators import analytics, validate
from storyloom.plans.workspace import Workspace


def test_from_files_to_thresholds(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"book{k}.txt").write_bytes(f"Preface\r\nChapter 1\r\nThe wise mentor spoke. He was a mentor of old.\r\n***\r\nA lost sword lay there, the sword number {k}.\r\nChapter 2\r\nNo mentors here, but an anti-sword.\r\n".encode("utf-16"))
    (tmp_path / "c.csv").write_text('id,name,aliases,summary,anti_aliases\n,Mentor,"wise mentor|old teacher",A guide who teaches,\n,Lost Sword,sword,"A blade, missing",\n')
    w = Workspace(spark, str(tmp_path / "ws"))
    small = ChunkConfig(20, 10, 30, 4, 5)
    assert w.ingest(str(src), config=small) == {"work": 3, "chapter": 6, "scene": 9, "chunk": 9}
    assert w.ingest(str(src), config=small)["work"] == 3
    assert w.load_catalog(str(tmp_path / "c.csv")).count() == 2 and w.load_catalog(str(tmp_path / "c.csv")).count() == 2
    ids = {r.name: r.motif_id for r in w.table("motif").collect()}
    w.expand_aliases(spark.createDataFrame([(ids["Mentor"], ["Sage Counsel", "mentor", "trope"])], "motif_id string, proposed array<string>"))
    assert {r.name: r.aliases for r in w.table("motif").collect()}["Mentor"] == ["wise mentor", "old teacher", "sage counsel"]
    w.embed()
    n = w.table("vector").count()
    w.embed()
    assert n == 9 == w.table("vector").count() == w.table("embedding_ref").count()
    first = w.seed_dictionary().count()
    assert first > 0 and w.seed_dictionary().count() == first
    texts = {r.work_id: r.text for r in w.table("work").collect()}
    assert all(texts[r.work_id][r.start : r.end] == r.surface for r in w.table("candidate").collect())
    assert not [r for r in w.table("candidate").collect() if r.surface == "sword" and "anti" in texts[r.work_id][r.start - 5 : r.start]]
    w.seed_semantic(SemanticConfig(8, 0.05, 2))
    support, weights = w.select_support()
    assert validate.rank_gaps(support).count() == 0 and validate.bad_weights(weights).count() == 0
    assert w.prompts().count() == w.table("candidate").select("scene_id").distinct().count()
    answers = w.table("candidate").where("source = 'dictionary'").select("scene_id", "motif_id", F.lit(0.8).alias("confidence"), F.lit("why").alias("rationale"), "start", "end")
    found = w.judge(answers, "r1")
    assert found.count() == answers.dropDuplicates(["scene_id", "motif_id", "start", "end"]).count() and w.judge(answers, "r1").count() == found.count()
    assert w.table("run").count() == 1
    w.vacuum("finding")
    assert w.table("finding").count() == answers.dropDuplicates(["scene_id", "motif_id", "start", "end"]).count()
    checked = w.verify().collect()
    assert len(checked) == w.table("finding").count() and all(texts[r.work_id][r.start : r.end] for r in checked)
    w.decide(w.table("finding").select(F.monotonically_increasing_id().alias("id"), "finding_id", F.when(F.col("motif_id") == ids["Mentor"], "accept").otherwise("reject").alias("decision"), F.lit("2024-01-01").alias("created_at")))
    chosen, each = w.calibrate(CalibrationConfig(min_samples=2))
    assert chosen.count() == 1 and each.count() == 2
    assert analytics.cooccurrence(analytics.scene_motifs(w.table("finding"))).count() <= 1
