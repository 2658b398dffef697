"""Steps whose cost must follow their input: the whole job, the same results, no pairs, no text for each row."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from storyloom.operators import analytics, gazetteer, segment, spans, vectors


def test_matches_make_no_pairs(spark):
    """Thousands of equal spans, repeated rows, several groups and partitions, against a plain loop."""
    rnd = random.Random(7)
    spot = lambda: (s := rnd.randrange(60), s + rnd.randrange(1, 40))
    t = [(g, k, *spot()) for k in range(400) for g in (1, 2)] + [(3, k, 10, 20) for k in range(3000)]
    p = [(g, k, *spot()) for k in range(500) for g in (1, 2)] + [(3, k, 10, 20) for k in range(2500)]
    truth = spark.createDataFrame(t + t[:50], "scene_id int, truth_id int, start int, end int")
    found = spark.createDataFrame(p + p[:50] + [(None, 1, 0, 9), (1, None, 0, 9), (1, 9999, None, 9)], "scene_id int, predicted_id int, start int, end int")
    want = set()
    for g in (1, 2, 3):
        used, free = set(), [r for r in p if r[0] == g]
        for _, name, a, b in sorted((r for r in t if r[0] == g), key=lambda r: (r[2], r[1])):
            if g == 3:
                best = (-1.0, name) if name < 2500 else None
            else:
                best = min(((-(min(b, y) - max(a, x)) / (max(b, y) - min(a, x)), k) for _, k, x, y in free if k not in used and x < b and a < y and (min(b, y) - max(a, x)) / (max(b, y) - min(a, x)) >= 0.3), default=None)
            if best:
                used.add(best[1])
                want.add((g, name, best[1], round(-best[0], 9)))
    out = spans.matched_one_to_one(found, truth, ["scene_id"])
    assert "Join" not in out._jdf.queryExecution().toString()
    rows = [(r.scene_id, r.truth_id, r.predicted_id, round(r.iou, 9)) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def cos(a, b):
    a, b = (np.array([0.0 if v is None else v for v in x or []]) for x in (a, b))
    norm = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0
    return round(float(a @ b / norm), 6) + 0.0 if norm else 0.0


def test_nearest_in_tiles(spark):
    """Small batches, many equal vectors: a task merges what it has kept; groups and null groups too."""
    rnd = random.Random(3)
    v = [(k, [float(rnd.randrange(-2, 3)) for _ in range(3)] if k % 9 else [1.0, 0.0, 0.0], rnd.choice(["a", "b", None])) for k in range(1, 150)]
    items = spark.createDataFrame(v, "item_id long, embedding array<double>, g string").coalesce(2)
    queries = items.where("item_id % 10 = 0").selectExpr("item_id AS query_id", "embedding")
    asked = [r for r in v if r[0] % 10 == 0]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
        got = {(r.query_id, r["rank"], r.item_id, r.similarity + 0.0) for r in vectors.nearest(queries, items, 5).collect()}
        grouped = {(r.query_id, r.g, r["rank"], r.item_id) for r in vectors.nearest(queries, items, 3, by="g").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = lambda q, rows, k: sorted((-cos(q, e), i) for i, e, _ in rows)[:k]
    assert got == {(q, n + 1, i, -s) for q, e, _ in asked for n, (s, i) in enumerate(best(e, v, 5))}
    assert grouped == {(q, g, n + 1, i) for q, e, _ in asked for g in ("a", "b", None) for n, (_, i) in enumerate(best(e, [r for r in v if r[2] == g], 3))}


def test_nearest_holds_no_table_of_all_scores(spark, monkeypatch):
    """2,000 queries and a batch of 10,000 items: 160 MB of scores, of which a task holds a tile."""
    runs = []
    e = spark.range(2000).selectExpr("id AS query_id", "array(1.0D, sin(id), cos(id), sin(id * 7)) AS embedding")
    monkeypatch.setattr(type(e), "mapInArrow", lambda self, f, schema: runs.append(f) or spark.createDataFrame([], schema))
    vectors.nearest(e, e.withColumnRenamed("query_id", "item_id"), 8)
    rnd = np.random.default_rng(1)
    b = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.FixedSizeListArray.from_arrays(pa.array(rnd.normal(size=40_000)), 4).cast(pa.list_(pa.float64()))], ["item_id", "embedding"])
    tracemalloc.start()
    rows = sum(x.num_rows for x in runs[0](iter([b, b.slice(0, 100)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 16_000 and peak < 100e6, (rows, peak)
    few = [b.slice(0, 300), b.slice(300, 300)]
    whole = sorted(r for x in runs[0](iter(few)) for r in zip(*(c.to_pylist() for c in x.columns), strict=True))
    monkeypatch.setattr(vectors, "TILE", 5000)
    assert sorted(r for x in runs[0](iter(few)) for r in zip(*(c.to_pylist() for c in x.columns), strict=True)) == whole


def test_nearest_within_joins_no_pairs(spark):
    """String ids, other sizes, nulls, vectors of no length, groups without a query."""
    rnd = random.Random(5)
    v = [(rnd.choice("abc"), f"i{k}", [float(rnd.randrange(-2, 3)) for _ in range(3 if k % 7 else 2)]) for k in range(120)]
    v += [("a", "none", None), ("a", "empty", []), ("b", "zero", [0.0, 0.0, 0.0]), ("b", "hole", [1.0, None, 2.0]), (None, "out", [1.0, 1.0, 1.0])]
    schema = "g string, item_id string, embedding array<double>"
    items = spark.createDataFrame(v, schema)
    asked = [r for r in v if r[0] in ("a", "b") and (r[1].endswith("0") or not r[1].startswith("i"))]
    found = vectors.nearest_within(spark.createDataFrame(asked, schema).withColumnRenamed("item_id", "query_id"), items, "g", 4)
    assert "Join" not in found._jdf.queryExecution().toString()
    want = {(g, q, i, -s, n + 1) for g, q, e in asked for n, (s, i) in enumerate(sorted((-cos(e, x), i) for h, i, x in v if h == g)[:4])}
    assert {(r.g, r.query_id, r.item_id, r.similarity + 0.0, r["rank"]) for r in found.collect()} == want


def test_export_splits_a_text_once(spark):
    """Sentences are found for each work, not for each finding; every middle of odd texts, against sentence_of."""
    texts = ["", "  ", "One. Two!   Three", "\n\nA b c.    \n\n\n  Dd.  E?!  x" + "y" * 300 + ". " + " " * 600 + "Z. ", "no end here", None, ". ! ?", "\u00e9\U0001f600. b\x01 c. d"]
    works = spark.createDataFrame(list(enumerate(texts)), "work_id int, text string")
    f = works.select("work_id", F.explode(F.sequence(F.lit(-2), F.coalesce(F.length("text"), F.lit(0)) + 2)).alias("start")).select("*", F.explode(F.array(F.col("start") + 7, F.col("start"), F.col("start") - 3)).alias("end"))
    f = f.select("*", F.monotonically_increasing_id().alias("finding_id"), F.lit("m").alias("motif_id"), F.lit(None).cast("string").alias("scene_id"), F.lit("scene").alias("level"), F.lit(0.5).alias("confidence"), F.lit("now").alias("created_at"), F.lit("").alias("model"), F.lit("").alias("rationale"))
    f = spark.createDataFrame(f.collect(), f.schema)
    none = spark.createDataFrame([], "scene_id string, chapter_id string, idx int")
    out = analytics.finding_rows(f, none, none, works, spark.createDataFrame([("m", "M")], "motif_id string, name string"))
    got = {r.id: (r.evidence_start, r.evidence_end, r.excerpt, r.evidence_sentence) for r in out.collect()}
    a, b = F.col("a"), F.col("b")
    n = F.length("text")
    clip = lambda c: F.greatest(F.lit(0), F.least(F.col(c), n))
    old = f.join(works, "work_id").withColumn("a", F.least(clip("start"), clip("end"))).withColumn("b", F.greatest(clip("start"), clip("end")))
    old = old.withColumn("s", spans.sentence_of(segment.sentences(F.col("text")), a, b))
    cut = lambda x, y: F.col("text").substr(x + 1, y - x)
    sentence = F.regexp_replace(F.replace(cut(F.col("s.start"), F.col("s.end")), F.lit("\n"), F.lit(" ")), r"(?U)^\s+|\s+$", "")
    want = {r.finding_id: tuple(r)[1:] for r in old.select("finding_id", "a", "b", cut(a, b), sentence).collect()}
    assert got == want and len(got) > 2000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    at = lambda word: min(len(x) - len(x.lstrip(" :+-|")) for x in plan.splitlines() if word in x)
    assert at("ArrowEvalPython") > at("Aggregate")  # below the join with the distinct spans, on the works' side


def test_sentences_send_no_text_back(spark):
    """Variants by plain loops over odd texts; what comes back from Python is places, not pieces."""
    import re

    texts = ["", None, " \t ", "One. Two!   Three ", "\n\n\nA.  \n\n B? ", "é😀. b! — c.\" d", "no end", "..! ? ", "x. " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for variant in "ABCD":
        out = rows.select("k", segment.sentences(F.col("text"), variant).alias("s"))
        assert "piece" not in out._jdf.queryExecution().optimizedPlan().toString()
        for r in out.collect():
            t, want, at = texts[r.k], [], 0
            for m in [*re.finditer(segment.SENTENCE_END[variant], t or "", re.A), None]:
                to = m.end() if m else len(t or "")
                piece = (t or "")[at:to]
                kept = piece.strip(" \t\n\x0b\f\r")
                if variant in "CD":
                    want += [(at, to)] * (to > at)
                elif kept:
                    a = at + piece.index(kept[0])
                    want.append((a, to if variant == "B" and to == len(t) else a + len(kept)))
                at = to
            if variant in "AB":
                want = want or [(0, None if t is None else len(t))]
            elif t is None:
                want = None
            assert (None if r.s is None else [tuple(x) for x in r.s]) == want, (variant, t)


def test_hits_leave_in_small_batches(spark, monkeypatch):
    """A long text with thousands of hits is not copied thousands of times at once."""
    from pyspark.sql.types import StructType

    text = "hero " * 3000
    schema = StructType.fromDDL("chunk_id long, motif_id int, alias string, nth int, start int, end int, surface string, text string")
    run = gazetteer._scan([(1, "hero", 0, ["hero"], gazetteer.FLAGS + "hero", ["hero"])], schema)
    b = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array([text, None, text + "x"])], ["chunk_id", "text"])
    out = list(run(iter([b])))
    assert max(x.nbytes for x in out) < 16 << 20
    assert [(r["chunk_id"], r["start"]) for x in out for r in x.to_pylist()] == [(c, 5 * k) for c in (7, 9) for k in range(3000)]
    chunks = spark.createDataFrame([(1, "a hero"), (2, "x")], "chunk_id int, text string")
    motifs = spark.createDataFrame([(1, "hero", ["champion"])], "motif_id int, name string, aliases array<string>")
    for most in (0, 1 << 20):
        found = gazetteer.hits(chunks, gazetteer.admitted_aliases(motifs), most_bytes=most, with_text=False)
        assert "text" not in found.columns and [(r.chunk_id, r.start, r.surface) for r in found.collect()] == [(1, 2, "hero")]


def test_chunks_leave_in_small_batches(spark, monkeypatch):
    """A batch of many scenes: chunks go on as they are made; texts are cut in slices of bounded bytes."""
    from storyloom.functions import text as T

    runs = []
    scenes = spark.createDataFrame([(1, 0, "x")], "k long, char_start int, text string")
    take = type(scenes).mapInArrow
    monkeypatch.setattr(type(scenes), "mapInArrow", lambda self, f, schema: runs.append(f) or take(self, f, schema))
    segment.chunks(scenes, ["k"])
    words = "word and. " * 6000
    b = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([3] * 300, pa.int32()), pa.array([words] * 300)], ["k", "_base", "text"])
    out = list(runs[0](iter([b])))
    assert max(x.nbytes for x in out) < 6 << 20 and len(out) > 3
    spans_ = segment.chunk_spans(words)
    assert [(r["k"], r["token_start"], r["token_end"]) for x in out for r in x.select(["k", "token_start", "token_end"]).to_pylist()] == [(k, i, j) for k in range(300) for i, j in spans_]
    marked = pa.array([f"a{T.MARK}bc", None, "", "d" * 50, f"é{T.MARK}"] * 4)
    whole = T._cut(marked, False).to_pylist()
    assert len(T.by_bytes(marked, 20)) > 4 and pa.concat_arrays([T._cut(x, False) for x in T.by_bytes(marked, 20)]).to_pylist() == whole
