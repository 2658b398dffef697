"""Queries that SQL can't express, or not in time, against plain loops."""

import math
import re

import regex

from storyloom.config import ChunkConfig, GazetteerConfig
from storyloom.operators import calibrate, gazetteer, segment, spans
from storyloom.plans import queries

W = r"[\p{L}\p{N}_]"


def works(spark, sf_dir):
    return {r.work_id: r.text for r in queries.works(spark, sf_dir).collect()}


def test_chunk_digests(spark, sf_dir):
    """Chunks of every scene: token windows with the look-ahead, their texts and digests."""
    import hashlib

    c = ChunkConfig()
    scenes = segment.scenes(segment.chapters(queries.works(spark, sf_dir))).collect()
    want = set()
    for r in scenes:
        tokens = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\w+|[^\w\s]", r.text)]
        i, k = 0, 0
        while i < len(tokens):
            j = min(len(tokens), i + c.target)
            stop = next((p for p in range(j, min(len(tokens) - 1, j + c.look_ahead) + 1) if tokens[p][2] in (".", "!", "?")), None)
            if stop is not None:
                j = min(stop + 1, i + c.most)
            text = r.text[tokens[i][0] : tokens[j - 1][1]]
            want.add((r.work_id, r.chapter, r.idx, k, r.char_start + tokens[i][0], r.char_start + tokens[j - 1][1], text, hashlib.sha256(text.encode()).hexdigest()))
            if j >= len(tokens):
                break
            i, k = max(0, j - c.overlap), k + 1
    got = {(r.work_id, r.chapter, r.scene, r.idx, r.char_start, r.char_end, r.text, r.sha256) for r in queries.QUERIES["chunk_sha256"](spark, sf_dir).collect()}
    assert got == want


def alias_hits(text, alias):
    """Whole-word, case-blind matches of a plain alias; dashes and runs of white space between its words."""
    words = [regex.escape(w) for w in alias.split(" ")]
    plural = "(?:s|es)?" if regex.search(r"(^|\s)\p{L}+$", alias) else ""
    return [(m.start(), m.end(), m.group()) for m in regex.finditer(rf"(?<!{W})" + r"(?:[-‐-―]+\s*|\s+)".join(words) + plural + rf"(?!{W})", text, regex.I)]


def all_hits(spark, sf_dir):
    aliases = gazetteer.admitted_aliases(queries.motifs(spark, sf_dir)).collect()
    return [
        (d.doc_id, a.motif_id, a.alias, a.nth, s, e, x, d.text, d.source)
        for d in queries.documents(spark, sf_dir).collect() for a in aliases for s, e, x in alias_hits(d.text or "", a.alias)
    ]


def test_gazetteer_spans_and_seeds(spark, sf_dir):
    hits = all_hits(spark, sf_dir)
    got = {(r.chunk_id, r.motif_id, r.alias, r.nth, r.start, r.end, r.surface) for r in queries.QUERIES["gazetteer_spans"](spark, sf_dir).collect()}
    assert got == {h[:7] for h in hits} and len(got) > 50
    kept, seen, count = set(), set(), {}
    for doc, motif, alias, nth, s, e, _, text, work in sorted(hits, key=lambda h: (h[0], h[3], h[2], h[4], h[5])):
        if regex.search(rf"(?<!{W})anti(?:[-‐-―]|\s)+", text[max(0, s - 60) : e + 60], regex.I) or (work, motif, doc, s, e) in seen:
            continue
        seen.add((work, motif, doc, s, e))
        count[work, motif] = count.get((work, motif), 0) + 1
        if count[work, motif] <= GazetteerConfig().most_per_motif:
            kept.add((doc, motif, alias, s, e))
    assert {(r.chunk_id, r.motif_id, r.alias, r.start, r.end) for r in queries.QUERIES["gazetteer_seeds"](spark, sf_dir).collect()} == kept


def test_one_to_one_matches(spark, sf_dir):
    f = queries.findings(spark, sf_dir).collect()
    iou = lambda a, b: max(0, min(a.end, b.end) - max(a.start, b.start)) / (max(a.end, b.end) - min(a.start, b.start))
    want = set()
    groups = {}
    for r in f:
        groups.setdefault((r.scene_id, r.motif_id), []).append(r)
    for rows in groups.values():
        used = set()
        for t in sorted((r for r in rows if r.finding_id % 2 == 0), key=lambda r: (r.start, r.finding_id)):
            free = [(-iou(t, p), p.finding_id) for p in rows if p.finding_id % 2 and p.finding_id not in used and iou(t, p) >= 0.1]
            if free:
                used.add(min(free)[1])
                want.add((t.finding_id, min(free)[1]))
    got = {(r.truth_id, r.predicted_id) for r in queries.QUERIES["one_to_one_matches"](spark, sf_dir).collect()}
    assert got == want and got


def test_matches_across_cells(spark):
    t = spark.createDataFrame([(1, "a", 0, 5000), (1, "b", 4090, 4100)], "scene_id int, truth_id string, start int, end int")
    p = spark.createDataFrame([(1, "x", 10, 5000), (1, "y", 4095, 4102)], "scene_id int, predicted_id string, start int, end int")
    for cell in (1, 7, 4096, 10_000):
        assert sorted((r.truth_id, r.predicted_id) for r in spans.matched_one_to_one(p, t, ["scene_id"], 0.3, cell).collect()) == [("a", "x"), ("b", "y")]


def test_logistic_fits(spark, sf_dir):
    groups = {}
    for r in queries.points(spark, sf_dir).collect():
        groups.setdefault(r.motif_id, []).append((r.confidence, r.y))
    got = {r.motif_id: r.weights for r in queries.QUERIES["logistic_fits"](spark, sf_dir).collect()}
    assert got.keys() == groups.keys()
    for m, points in groups.items():
        w = [0.0, 0.0]
        for _ in range(100):
            grad = [0.0, 0.0]
            for c, y in points:
                d = 1 / (1 + math.exp(-(w[0] + w[1] * c))) - y
                grad = [grad[0] + d, grad[1] + d * c]
            w = [v - 0.1 * (g / len(points) + 1e-3 * v) for v, g in zip(w, grad, strict=True)]
        assert all(abs(a - b) < 1e-4 for a, b in zip(got[m], w, strict=True))


def test_bins_keep_every_point(spark, sf_dir):
    p = queries.points(spark, sf_dir)
    assert calibrate.reliability(p).agg({"n": "sum"}).first()[0] == p.count()
