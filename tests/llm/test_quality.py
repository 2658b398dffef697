import random

from pyspark.sql import functions as F

from storyloom.llm import quality


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(1)
    say = lambda n: [rng.choice(["ba", "de", "ki"]) + rng.choice(["lo", "ra", "mu"]) for _ in range(n)]
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        rows.append((i, " ".join(say(40) if good else [w.upper() + "!!" for w in say(40)]), i))
        labels.append((i, int(good)))
    rows += [(1000, None, 1), (1001, "", 1), (None, "x", 1), (0, rows[0][1], 1)]
    labels += [(None, 1), (5, None), (0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit_quality(docs, marks)
    scored = quality.score_quality(docs, model).select("*", quality.held_out().alias("held_out")).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    held = [(r.score >= 0.5, r.doc_id % 3 > 0) for r in scored if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.97
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and kept.where(F.col("doc_id") < 600).count() > 300


def test_no_labels_and_no_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(odd_docs, quality.fit_quality(odd_docs, none)).collect()} == {0.5}
    assert quality.score_quality(no_docs, quality.fit_quality(no_docs, none)).count() == 0


def test_held_out_labels_of_the_driver(spark):
    """Labels of the fold that is not learned from: area under the curve, accuracy against the base rate, calibration."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.op6_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in scored if r.quality == 1], [r.score for r in scored if r.quality == 0]
    assert len(good) > 20 and len(bad) > 5
    area = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    right = sum(r.predicted == r.quality for r in scored) / len(scored)
    base = max(len(good), len(bad)) / len(scored)
    assert area > 0.95 and right > max(0.9, base)
    assert abs(sum(r.score for r in scored) / len(scored) - len(good) / len(scored)) < 0.1
    assert quality.score_quality(docs, quality.fit_quality(docs, labels)).count() == docs.count()
