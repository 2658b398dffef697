"""The queries against their SQL in DuckDB, over whole tables, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from storyloom.llm import decontaminate, jaccard, pieces, quality, registry, substrings


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    got = con.execute(registry.oracles()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(names).collect()))) == sorted(map(repr, got.fetchall()))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf_dir).cache())
    assert all(k.columns == names for k in kept[:-1])
    good, single, cut, clean, encoded = kept[1:]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.score_quality(docs, model).where(f"score >= {quality.THRESHOLD}").collect()}
    groups = {r.doc_id for r in jaccard.similar_groups(good, 5, 80).collect() if r.doc_id == r.component_id}
    assert {r.doc_id for r in single.collect()} == groups
    assert {r.doc_id for r in cut.collect()} == groups
    assert substrings.kept_digests(cut.where("length(text) > 0")).count() > 0
    found = {r.doc_id for r in decontaminate.contaminations(cut, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == groups - found
    back = {r.doc_id: r.text for r in pieces.decode_texts(encoded).collect()}
    assert back == {r.doc_id: r.text for r in clean.collect()}


ODD = "doc_id long, text string, lang string, source string, n_chars long, spans int, score double, h long, component_id long, prefix string, place int, kind int"


def odd_rows():
    base = " ".join(f"Word{k % 37} of the {k % 11} and more." for k in range(60))
    tail = (1, 0.5, 2, 3, "p", 4, 5)
    rows = [(1, base, "en", "a", len(base), *tail), (2, base, None, None, None, *[None] * 7), (2, base, None, None, None, *[None] * 7), (None, base, "en", "a", 3, *tail)]
    rows += [(3, None, None, None, None, *tail), (4, "", "en", "a", 0, *tail), (5, " \t\n", "en", "a", 3, *tail), (6, "one", "en", None, 3, *tail), (7, base * 40, "de", "b", None, *tail), (None, None, None, None, None, *[None] * 7)]
    return rows


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(spark, sf_dir, number):
    """Nulls in every column, empty and long texts, repeated rows, ties, columns that are called like ours; no rows."""
    name, stage = corpus_pipeline.STAGES[number]
    docs = spark.createDataFrame(odd_rows(), ODD)
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    if number < 4:
        assert out.columns == docs.columns
        assert all(r.spans in (1, None) and r.prefix in ("p", None) for r in rows)
    ids = sorted(r.doc_id or 0 for r in rows)
    match name:
        case "quality_classifier":
            assert set(ids) <= {0, 1, 2, 3, 4, 5, 6, 7}
        case "ngram_jaccard_join":  # 2 is a copy of 1, 7 says nothing else; rows without an id stay
            assert ids == [0, 0, 1, 3, 4, 5, 6]
        case _:
            assert ids == [0, 0, 1, 2, 2, 3, 4, 5, 6, 7]
    if name == "substring_dedup":
        assert {r.text for r in rows if r.doc_id == 2} == {""} and [r.text for r in rows if r.doc_id == 1] == [odd_rows()[0][1]]
    none = stage(spark, docs.limit(0), sf_dir)
    assert none.columns == out.columns and none.count() == 0


def test_the_whole_pipeline_leaves_one_table(spark, sf_dir):
    """run() gives what the stages give one after the other, and of all tables on its way the last one stays."""
    import glob

    from storyloom.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    there = set(glob.glob(f"{folder}/storyloom-*"))
    got = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert [p.split("storyloom-")[-1].rsplit("-", 1)[0] for p in set(glob.glob(f"{folder}/storyloom-*")) - there] == ["benchmark_decontamination"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert got == {(r.doc_id, tuple(r.ids)) for r in docs.collect()}
