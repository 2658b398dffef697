import hashlib
import zlib

from storyloom.llm import sharding


def brute(rows, shards):
    keyed = sorted((hashlib.md5((t or "").encode()).digest(), -(1 << 63) if i is None else i, i, (t or "").encode()) for i, t in rows) if all(i is not None for i, _ in rows) else sorted(((hashlib.md5((t or "").encode()).digest(), -(1 << 63) if i is None else i, t or "", i) for i, t in rows), key=lambda x: x[:3])
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    out, at, slots = [], 0, [0] * shards
    for k in keyed:
        i, raw = (k[2], k[3]) if isinstance(k[3], bytes) else (k[3], k[2].encode())
        size = len(raw) + 1
        shard = min(shards - 1, int((at + size / 2) * shards // total))
        out.append((i, size, zlib.crc32(raw), shard, slots[shard]))
        at, slots[shard] = at + size, slots[shard] + 1
    return sorted(out, key=repr)


def test_against_one_global_sort(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for ranges in (1, 4, 64):
        got = sorted([tuple(r) for r in sharding.byte_shards(odd_docs, 3, ranges).collect()], key=repr)
        assert got == brute(rows, 3)
    assert sharding.byte_shards(no_docs, 3).count() == 0


def test_hot_group_is_cut(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    got = sharding.byte_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8, 64).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_written_shards(spark, odd_docs, no_docs, tmp_path):
    """Every row is written once: null ids, repeated rows, and columns that are called like ours."""
    docs = odd_docs.selectExpr("doc_id", "text", "extra as size", "h as position", "extra as slot", "'x' as k")
    said = sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: repr((r.doc_id, r.text, r.size, r.position, r.k))
    assert sorted(map(key, back.collect())) == sorted(map(key, docs.collect()))
    assert sorted((r.doc_id or 0, r.shard, r.slot) for r in back.collect()) == sorted((r.doc_id or 0, r.shard, r.slot) for r in said.collect())
    assert sharding.write_shards(no_docs, str(tmp_path / "none"), 3).count() == 0
