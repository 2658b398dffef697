import duckdb
import pytest
from pyspark.sql import functions as F

from storyloom.config import CalibrationConfig, GazetteerConfig, JudgeConfig
from storyloom.operators import analytics, calibrate, gazetteer, judge, review, spans, tables, validate, vectors
from storyloom.plans import queries
from storyloom.schemas import TABLES, conform
from storyloom.sources import files, providers, sinks


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in queries.ORACLES:
        return
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(queries.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in rows) == sorted(map(repr, got.fetchall()))


def hits(spark, texts, aliases, **kw):
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    motifs = spark.createDataFrame([(1, aliases[0], aliases[1:])], "motif_id int, name string, aliases array<string>")
    return gazetteer.hits(chunks, gazetteer.admitted_aliases(motifs, **kw))


def test_gazetteer(spark):
    texts = ["heroes éhero superhero", "😀 the anti-hero", "Fake‐out and fake out", "fools’ gold fool's gold"]
    got = {(r.chunk_id, r.start, r.surface) for r in hits(spark, texts, ["hero", "fake-out", "fool's gold", "ox"]).collect()}
    assert got == {(0, 0, "heroes"), (1, 11, "hero"), (2, 0, "Fake‐out"), (3, 12, "fool's gold")}
    found = hits(spark, texts, ["hero"])
    assert {r.chunk_id for r in gazetteer.unblocked(found).collect()} == {0}
    assert {r.chunk_id for r in gazetteer.unblocked(found, config=GazetteerConfig(use_anti=False)).collect()} == {0, 1}
    assert gazetteer.seeded(hits(spark, ["hero " * 9], ["hero", "heroe"]), GazetteerConfig(most_per_motif=4)).count() == 4
    stop = spark.createDataFrame([("villain",)], "word string")
    assert hits(spark, ["villain"], ["hero", "villain"], stop=stop).count() == 0


def test_support_with_unknown_picks(spark):
    h = spark.createDataFrame([(1, c, s, r) for r, (c, s) in enumerate([("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.6)], 1)] + [(2, "e", 0.5, 1)], "scene_id int, chunk_id string, similarity double, rank int")
    p = spark.createDataFrame([(1, ["c", "zz", "a"]), (2, [])], "scene_id int, support_ids array<string>")
    out = judge.support(h, p)
    got = {(r.scene_id, r["rank"]): (r.chunk_id, round(r.stage2_score, 3), r.note) for r in out.collect()}
    assert got == {(1, 1): ("c", 1.0, ""), (1, 2): ("a", 0.5, ""), (2, 1): ("e", 1.0, "fallback=knn")}
    assert validate.rank_gaps(out).count() == 0


def test_prior_gate(spark):
    j = spark.createDataFrame([(1, "m", 0.5, "r")], "scene_id int, motif_id string, confidence double, rationale string")
    w = spark.createDataFrame([(1, "m", 0.55)], "scene_id int, motif_id string, weight double")
    kept = judge.gated(j, w, None, JudgeConfig(threshold=0.25)).first()
    assert round(kept.confidence, 3) == 0.275 and kept.rationale == "r [prior=0.55, raw=0.50, adj=0.28]" or kept.rationale.endswith("adj=0.28]")
    assert judge.gated(j, w, None, JudgeConfig(threshold=0.30)).count() == 0
    stamp = judge.run_stamp(spark, "r1", JudgeConfig(), CalibrationConfig()).first()
    assert '"top_k": 8' in stamp.params_json


def test_latest_ties(spark):
    log = spark.createDataFrame([(1, 7, "accept", "2024-01-01"), (2, 7, "reject", "2024-01-01"), (3, 8, "edit", "2024-01-02")], "id int, finding_id int, decision string, created_at string")
    assert review.latest_decisions(log, ties=True).count() == 3
    assert sorted((r.finding_id, r.decision) for r in review.latest_decisions(log).collect()) == [(7, "reject"), (8, "edit")]
    with_bad = log.withColumn("decision", F.lit("maybe"))
    assert review.append_decision(log, with_bad).count() == 3


def test_flags(spark):
    rows = spark.createDataFrame([(1, "a never seen anti-x thing here", 2, 8, 1.0, "x"), (5, "an anti-war x", 2, 8, 1.0, "x"), (2, "it is not quite the hero yet", 20, 24, 1.0, "hero"), (3, "plain", 0, 5, 1.0, "hero"), (4, "such a CLICHÉ here", 0, 4, 1.0, "z")], "id int, text string, start int, end int, confidence double, alias string")
    got = {r.id: (r.verifier_flag, round(r.verified_confidence, 3)) for r in spans.cue_flags(rows.withColumn("aliases", F.array(F.lit("zzz"), "alias")), "aliases").collect()}
    assert got == {1: ("negation_anti", 0.3), 2: ("negation_cue", 0.6), 3: (None, 1.0), 4: ("meta_cue", 0.75), 5: (None, 1.0)}


def test_calibration_edges(spark):
    p = spark.createDataFrame([(1.0, 1), (0.0, 0), (0.5, 1), (1.5, 1)], "confidence double, y int")
    assert [r.n for r in calibrate.reliability(p).orderBy("bin").collect()] == [1, 0, 0, 0, 0, 1, 0, 0, 0, 1]
    assert len(calibrate.thresholds()) == 101 and any(t != k / 100 for k, t in enumerate(calibrate.thresholds()))
    edge = spark.createDataFrame([(c, 1) for c in (0.3, 0.6, 0.7, 0.1, 0.9)], "confidence double, y int")
    assert {r.bin for r in calibrate.reliability(edge).where("n > 0").collect()} == {2, 5, 6, 1, 9}
    few = spark.createDataFrame([("m", 0.5, 1)] * 3, "motif_id string, confidence double, y int")
    assert calibrate.motif_thresholds(few).count() == 0


def best_by_loop(points, marks, least_precision):
    best, score = 0.5, -1.0
    for t in sorted(marks):
        tp = sum(y for c, y in points if c >= t)
        hit = sum(c >= t for c, _ in points)
        p, r = (tp / hit if hit else 0.0), tp / max(1, sum(y for _, y in points))
        f = round(2 * p * r / (p + r), 9) if p + r else 0.0
        if p >= least_precision and f > score:
            best, score = t, f
    return best


def test_thresholds_compare_confidences_as_they_are(spark):
    import random

    rng = random.Random(3)
    groups = {"edge": [(0.6236, 1)] * 4 + [(0.2, 0)] * 8}
    for k in range(5):
        groups[f"m{k}"] = [(round(rng.random(), rng.choice([2, 4, 6])), int(rng.random() < 0.5)) for _ in range(rng.randint(8, 40))]
    df = spark.createDataFrame([(m, c, y) for m, ps in groups.items() for c, y in ps], "motif_id string, confidence double, y int")
    got = {r.motif_id: r.threshold for r in calibrate.motif_thresholds(df, CalibrationConfig(min_precision=0.6)).collect()}
    grid = [k * 0.01 for k in range(101)]
    for m, ps in groups.items():
        assert got[m] == pytest.approx(best_by_loop(ps, {round(c, 3) for c, _ in ps} | set(grid), 0.6)), m
    assert got["edge"] < 0.6236
    got = {r.motif_id: r.threshold for r in calibrate.review_thresholds(df).collect()}
    assert got == {m: pytest.approx(best_by_loop(ps, {c for c, _ in ps}, 0.0)) for m, ps in groups.items()}


def test_seeds_are_capped_in_each_work_in_order(spark):
    rows = [(w, f"{9 - c}-{w}", 1, "x", 0, s, s + 1, 100 * c) for w in "ab" for c in range(4) for s in range(3)] + [("a", "dup", 1, "x", 0, 100, 101, 0)]
    found = spark.createDataFrame(rows, "work_id string, chunk_id string, motif_id int, alias string, nth int, start int, end int, char_start int")
    kept = gazetteer.seeded(found, GazetteerConfig(most_per_motif=5)).collect()
    places = {w: sorted(r.char_start + r.start for r in kept if r.work_id == w) for w in "ab"}
    assert places == {"a": [0, 1, 2, 100, 101], "b": [0, 1, 2, 100, 101]}


def test_scan_and_join_find_the_same(spark):
    texts = ["heroes éhero superhero Hero", "😀 the anti-hero", "Fake‐out and fake out", "fools’ gold fool's gold", None, "", "naïve İstanbul"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    motifs = spark.createDataFrame([(1, "hero", ["fake-out", "fool's gold", "naïve"])], "motif_id int, name string, aliases array<string>")
    for variant in (1, 2, 3):
        one, two = (gazetteer.hits(chunks, gazetteer.admitted_aliases(motifs), variant, most) for most in (1 << 20, 0))
        assert one.columns == two.columns and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert gazetteer.hits(chunks, gazetteer.admitted_aliases(motifs.limit(0))).count() == 0


def test_nearest_with_odd_vectors(spark):
    v = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [0.0, 0.0])]
    e = spark.createDataFrame(v, "item_id long, embedding array<double>")
    q = e.withColumnRenamed("item_id", "query_id")
    got = {(r.query_id, r["rank"]): r.item_id for r in vectors.nearest(q, e, 2).collect()}
    assert got == {(1, 1): 1, (1, 2): 6, (4, 1): 4, (4, 2): 1, (6, 1): 1, (6, 2): 6, (7, 1): 1, (7, 2): 4}
    by = e.withColumn("work", F.col("item_id") % 2)
    assert {(r.query_id, r.work): r.item_id for r in vectors.nearest(q.where("query_id = 1"), by, 1, by="work").collect()} == {(1, 0): 6, (1, 1): 1}
    lists = vectors.shortlist(e.withColumnRenamed("item_id", "scene_id"), q.where("query_id in (1, 4, 6)").withColumnRenamed("query_id", "motif_id"), 2)
    assert {(r.scene_id, r["rank"]): r.motif_id for r in lists.collect()} == {(1, 1): 1, (1, 2): 6, (4, 1): 4, (4, 2): 1, (6, 1): 1, (6, 2): 6, (7, 1): 1, (7, 2): 4}
    assert vectors.nearest(q.limit(0), e, 2).count() == 0 and vectors.shortlist(e.withColumnRenamed("item_id", "scene_id"), q.limit(0).withColumnRenamed("query_id", "motif_id"), 2).count() == 0


def test_long_spans_and_blank_chapters(spark):
    from storyloom.operators import segment

    df = spark.createDataFrame([(1, "a. " * 300, 20, 420), (2, "One two. Three four. Five.", 4, 7)], "id int, text string, s int, e int")
    got = {r.id: [(w.start, w.end) for w in r.w] for r in df.select("id", spans.candidate_windows(segment.sentences(F.col("text")), F.col("s"), F.col("e"), F.length("text")).alias("w")).collect()}
    assert got[1][0] == (80, 360) and all(b - a <= 280 for a, b in got[1]) and got[2][0] == (4, 7)
    works = spark.createDataFrame([(1, ""), (2, " \n "), (3, "Chapter 1\nx\nChapter 2\n***\n \n")], "work_id int, text string")
    found = sorted((r.work_id, r.chapter, r.idx, r.char_start, r.char_end, r.heading) for r in segment.scenes(segment.chapters(works)).collect())
    assert found == [(1, 0, 0, 0, 0, None), (2, 0, 0, 0, 3, None), (3, 0, 0, 0, 12, None), (3, 1, 0, 12, 22, None), (3, 1, 1, 22, 28, "***")]


def test_verifier_modes(spark):
    rows = spark.createDataFrame([(1, 0.8, 0.4, "negation_cue"), (2, 0.9, 0.9, None)], "id int, confidence double, verified_confidence double, verifier_flag string")
    left = {m: sorted((r.id, r.confidence) for r in spans.applied_flags(rows, m).collect()) for m in spans.MODES}
    assert left == {"downweight": [(1, 0.4), (2, 0.9)], "flag": [(1, 0.8), (2, 0.9)], "delete": [(2, 0.9)]}
    with pytest.raises(ValueError):
        spans.applied_flags(rows, "other")


def test_one_to_one(spark):
    t = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 5, 15)], "scene_id int, truth_id string, start int, end int")
    p = spark.createDataFrame([(1, "x", 0, 12), (1, "y", 30, 40)], "scene_id int, predicted_id string, start int, end int")
    m = spans.matched_one_to_one(p, t, ["scene_id"])
    assert [(r.truth_id, r.predicted_id) for r in m.collect()] == [("a", "x")]
    r = spans.match_report(m, p, t, ["scene_id"]).first()
    assert (r.tp, r.fp, r.fn, r.f1) == (1, 1, 1, 0.5)


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, created_at int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 9)], "k int, v string, created_at int")
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["k"]).collect()) == [(1, "a", 1), (2, "b", 1), (3, "c", 9)]
    again = tables.insert_or_ignore(old, old, ["k"], ["v"])
    assert again.count() == 2
    assert set(conform(old.withColumnRenamed("k", "id"), "work").columns) == {c.split()[0] for c in TABLES["work"].split(", ")}


def test_embedding_is_incremental(spark):
    chunks = spark.createDataFrame([("a", "one two"), ("b", "three"), ("c", " ")], "chunk_id string, text string")
    refs = spark.createDataFrame([("a", "main", "m", 64)], "chunk_id string, collection string, model string, dim int")
    v, added = providers.incrementally_embedded(chunks, refs, "main", "m")
    assert [r.chunk_id for r in v.collect()] == ["b"] and [tuple(r) for r in added.collect()] == [("b", "main", "m", 64)]
    e = providers.embedded(chunks, "text").where("embedding is not null").selectExpr("hash(chunk_id) as item_id", "embedding")
    found = vectors.nearest(e.selectExpr("cast(item_id as long) as query_id", "embedding"), e.selectExpr("cast(item_id as long) as item_id", "embedding"), 1)
    assert all(r.ok for r in vectors.self_probe(found).collect())


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("é".encode("utf-16"))
    (tmp_path / "in" / "b.txt").write_bytes(b"plain")
    rows = {r.title: r for r in files.read_texts(spark, str(tmp_path / "in")).collect()}
    assert rows["a"].raw_text == "﻿é" and rows["b"].raw_text == "plain"
    bad = {r.title: r.error for r in files.read_texts(spark, str(tmp_path / "in"), encoding="ascii").collect()}
    assert bad["a"] and bad["b"] is None
    (tmp_path / "c.csv").write_text('id,name,aliases,summary,source_url\n1,"The ""Fool""","a|b","two\nlines",u\n')
    assert files.read_catalog(spark, str(tmp_path / "c.csv")).first().name == 'The "Fool"'
    (tmp_path / "stop").write_text("# no\n\n Ghost \n")
    words = {r.word for r in files.read_stop_words(spark, str(tmp_path / "stop")).collect()}
    assert "ghost" in words and "# no" not in words and files.read_stop_words(spark, str(tmp_path / "gone")).count() == len(files.STOP_WORDS)
    e = spark.createDataFrame([("a", "b", 2)], "src string, dst string, weight int")
    n = spark.createDataFrame([("a", 3), ("b&", 1)], "motif_id string, scenes int")
    sinks.write_graphml(e, n, str(tmp_path / "g.xml"))
    import xml.etree.ElementTree as ET

    graph = ET.parse(tmp_path / "g.xml").getroot()[3]
    assert len(graph) == 3 and [x.get("id") for x in graph] == ["a", "b&", "e0"] and [x.text for x in graph[0]] == ["a", "3"]
    f = spark.createDataFrame([(1, "a|b", 0.5)], "finding_id int, motif string, confidence double")
    sinks.write_markdown(f, ["finding_id", "motif"], str(tmp_path / "f.md"))
    assert (tmp_path / "f.md").read_text().splitlines()[2] == "| 1 | a\\|b |"
    sinks.write_findings_csv(f, str(tmp_path / "f"))
    assert spark.read.csv(str(tmp_path / "f"), header=True).columns == sinks.FINDING_COLUMNS
    pages = analytics.highlighted(spark.createDataFrame([(1, "a <b> c")], "scene_id int, text string"), spark.createDataFrame([(1, 2, 5, "m")], "scene_id int, start int, end int, motif_id string"), "scene_id")
    assert pages.first().html == 'a <mark data-motif="m">&lt;b&gt;</mark> c'
    sinks.write_html(pages, "scene_id", str(tmp_path / "h"))
    assert (tmp_path / "h" / "1.html").exists()


def test_streamed_ingest(spark, tmp_path):
    from storyloom.streaming.ingest import ingest_stream

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for k in (1, 2):
        spark.createDataFrame([(k, f"Chapter {k}\r\none.  \ntwo")], "work_id long, text string").write.mode("append").parquet(src)
        ingest_stream(spark, src, out, ck).awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(f"{out}/chapter").collect()) == ["Chapter 1", "Chapter 2"]
    assert spark.read.parquet(f"{out}/chunk").count() == 2


def test_reports(spark, tmp_path):
    works = spark.createDataFrame([("w", "A & B", "see the <sword> there"), ("v", "Empty", "")], "work_id string, title string, text string")
    found = [("w", 1, 8, 15, "Sword", "Things", "http://x", 0.5, "why\nso"), ("w", 2, 10, 20, "Late", None, None, 0.9, None), ("w", 3, 16, 99, "There", None, None, 0.25, ""), ("w", 4, 50, 60, "Beyond", None, None, 1.0, None), ("w", 5, 0, 3, "Sword", "Things", "http://x", 1.0, None)]
    f = spark.createDataFrame(found, "work_id string, finding_id int, start int, end int, name string, group_name string, url string, confidence double, rationale string")
    pages = {r.work_id: r for r in analytics.report_pages(works, f).collect()}
    assert pages["v"].html == "" and "No findings" in pages["v"].legend
    html = pages["w"].html
    assert html.count("<mark") == 3 and '&lt;sword&gt;</mark>' in html and 'title="Sword | [Things] | conf=0.50 | why so"' in html and 'title="There | conf=0.25"' in html
    assert html.endswith(">there</mark>") and "Late" not in html
    legend = pages["w"].legend
    assert legend.index("Sword") < legend.index("There") and "×2" in legend and '<a href="http://x"' in legend and "[Things]" in legend
    scenes = spark.createDataFrame([("w", "s1", 0, 0, 10, "see the <s"), ("w", "s2", 1, 10, 21, "word> there")], "work_id string, scene_id string, idx int, char_start int, char_end int, text string")
    g = f.withColumn("scene_id", F.when(F.col("finding_id") == 5, "s1").when(F.col("finding_id") == 4, "gone").otherwise("s2"))
    page = {r.work_id: r for r in analytics.highlight_pages(works, scenes, g).collect()}["w"]
    assert page.jumps.count("<li>") == 5 and 'data-jump="5"' in page.jumps and "(scene ?, 50–60)" in page.jumps
    assert '<mark data-span-id="5" title="Sword">see</mark>' in page.html and page.html.index("Scene 0") < page.html.index("Scene 1")


def test_answers_are_parsed(spark):
    rows = [(1, '```json\n[{"trope_id": "m", "confidence": 0.7, "evidence_char_span": [3, 9], "rationale": "r"}, {"confidence": 1}]\n```'), (2, "nothing"), (3, 'So: [{"trope_id": "n"}] ok'), (4, None)]
    got = judge.parsed_findings(spark.createDataFrame(rows, "scene_id int, answer string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "m", 0.7, "r", 3, 9), (3, "n", 0.0, None, None, None)]
    rows = [(1, 'Sure {"support_ids": ["b", "a"], "notes": " near "}'), (2, "no")]
    assert sorted(tuple(r) for r in judge.parsed_picks(spark.createDataFrame(rows, "scene_id int, answer string")).collect()) == [(1, ["b", "a"], "near"), (2, [], "")]
    hits = spark.createDataFrame([(1, "a", 0.12345, 2), (1, "b", 1.5, 1)], "scene_id int, chunk_id string, similarity double, rank int")
    chunks = spark.createDataFrame([("a", " x" * 400), ("b", None)], "chunk_id string, text string")
    import json

    items = json.loads(judge.rerank_items(hits, chunks).first()["items"])
    assert [(x["id"], x["knn"], x["len"], len(x["snippet"])) for x in items] == [("b", 1.0, 0, 0), ("a", 0.123, 800, 480)]


def test_calibration_csv(spark, tmp_path):
    import csv

    p = spark.createDataFrame([(0.3, 1), (0.8, 0), (0.9, 1)], "confidence double, y int")
    sinks.write_calibration_csv(calibrate.sweep(p), calibrate.reliability(p), {"best": 0.5}, str(tmp_path / "c.csv"))
    rows = list(csv.reader((tmp_path / "c.csv").open()))
    assert rows[0] == ["# meta"] and rows[1] == ["best", "0.5"] and rows[3][0] == "threshold" and len(rows) == 4 + 101 + 3 + 10
    assert sum(int(r[2]) for r in rows[-10:]) == 3
