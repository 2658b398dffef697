import hashlib
import random
import re

from storyloom.llm import substrings


def brute(rows, window):
    docs = sorted({(i, t) for i, t in rows if i is not None}, key=lambda x: x[0])
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    seen, gone = set(), {i: set() for i in words}
    for i, w in words.items():
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone[i] |= set(range(p, p + window))
            seen.add(k)
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        cut = gone.get(i, set())
        kept = [x for k, x in enumerate(w) if k not in cut]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, window, gram):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in substrings.kept_digests(df, window, gram).collect()], key=repr)
    assert got == brute(rows, window)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(2)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 30))] for _ in range(8)]
    rows = []
    for i in rng.sample(range(1000), 60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else [rng.choice("abcdefghijk") for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(x for p in parts for x in p)))
    check(spark, rows, 6, 3)
    check(spark, rows, 20, 8)


def test_frequent_anchors_take_the_whole_window_as_prefix(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HEAVY", 2)
    rng = random.Random(4)
    core = [f"w{k}" for k in range(8)]
    rows = [(i, " ".join([*(rng.choice("abc") for _ in range(9)), *core, *(rng.choice("abc") for _ in range(9))])) for i in range(60)]
    check(spark, rows, 12, 4)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted([tuple(r) for r in substrings.kept_digests(odd_docs).collect()], key=repr)
    assert got == brute(rows, 20)
    assert substrings.kept_digests(no_docs).count() == 0


def test_cut_texts_keep_rows_and_columns(spark, odd_docs):
    out = substrings.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert len(rows) == odd_docs.count()
    want = {(i, h) for i, _, _, h in brute([(r.doc_id, r.text) for r in odd_docs.collect()], 20)}
    got = {(i, hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")).encode()).hexdigest()) for i, t in rows}
    assert got == want


def test_suffix_arrays_and_common_lengths():
    import numpy as np

    rng = random.Random(6)
    words = np.array([rng.randrange(3) for _ in range(300)], np.uint64)
    suffixes = np.array(rng.sample(range(290), 120))
    order, lcp = substrings.suffix_array(words, suffixes, 10)
    strings = [tuple(words[s : s + 10].tolist()) for s in suffixes[order]]
    assert strings == sorted(strings)
    for k in range(1, len(strings)):
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(strings[k - 1], strings[k], strict=True)) if x != y), 10)


def test_groups_of_any_size_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 300)
    monkeypatch.setattr(substrings, "SEGMENT_BYTES", 80)
    rng = random.Random(14)
    long = ["x" * 5000, "x" * 4999 + "y", "z" * 21]
    core = [rng.choice([*long, "a", "b"]) for _ in range(14)]
    rows = [(i, " ".join([*(rng.choice("abc") for _ in range(7)), *core[: rng.randint(9, 14)], *(rng.choice("abc") for _ in range(5))])) for i in range(40)]
    check(spark, rows, 8, 3)


def test_a_column_called_spans_stays(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, text, 7, 3), (2, "a " + text + " b", 8, None), (None, text, None, 1)], "doc_id long, text string, spans int, n_chars int")
    assert sorted((tuple(r) for r in substrings.without_repeats(df).collect()), key=repr) == sorted([(1, text, 7, 3), (2, "a b", 8, 3), (None, text, None, 1)], key=repr)
