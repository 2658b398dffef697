import os

import pyarrow as pa

from storyloom.llm.common import by_megabytes, discard, only_ids, saved


def test_batches_keep_all_rows_in_order():
    texts = ["a" * (k % 50) if k % 7 else None for k in range(500)] + ["b" * 10_000]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 90], pa.string())], ["text"]) for k in range(0, len(texts), 90)]
    out = list(by_megabytes(iter(batches), "text", 700))
    assert [t for b in out for t in b.column(0).to_pylist()] == texts and len(out) > 10
    assert list(by_megabytes(iter([]), "text")) == []


def test_id_filter_drops_no_wanted_row(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    ids = saved(rows.where("doc_id % 10 = 3"))
    kept = {r.doc_id for r in only_ids(rows, ids).collect()}
    assert kept >= set(range(3, 20_000, 10)) and len(kept) < 4000
    assert only_ids(rows, saved(rows.limit(0))).count() == 0
    with_null = rows.selectExpr("if(doc_id = 3, null, doc_id) as doc_id")
    assert 3 not in {r.doc_id for r in only_ids(with_null, ids).collect()}


def test_discarded_tables_are_gone(spark):
    df = saved(spark.range(3).toDF("x"))
    at = df.saved_at.removeprefix("file:")
    assert os.path.exists(at)
    discard(df)
    assert not os.path.exists(at)
