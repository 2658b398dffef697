import hashlib

import pytest

from storyloom.llm import pieces


@pytest.fixture(scope="module")
def v():
    return pieces.load_vocabulary()


def brute(v, s):
    out = []

    def go(at, ids, score):
        if at == len(s):
            out.append((score, ids))
            return
        for end in range(at + 1, min(len(s), at + v.longest) + 1):
            for start, more, sc in pieces.edges_into(v, s, end):
                if start == at:
                    go(end, ids + more, score + sc)

    go(0, (), 0.0)
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("s", ["▁the", "▁hello", "▁\n", "▁", "▁世界x", "▁ab▁c", "▁😀a", "▁éa"])
def test_nbest_of_a_segment(v, s):
    want = brute(v, s)
    got = pieces.segment_nbest(v, s, 6)
    assert [x[0] for x in got] == [x[0] for x in want[:6]] and len({x[1] for x in got}) == len(got)
    for best in (pieces.best_segments(v, [s, s])[2:], [[x] for x in pieces._best_alone(v, s)[1:]]):
        assert best[0][0] == want[0][0]
        assert best[1][0] == (want[0][0] - want[1][0] if len(want) > 1 else float("inf"))


@pytest.mark.parametrize("s", ["▁aaaaaaaaaa", "▁abababab", "▁  ", "▁ééé", "▁thethe"])
def test_places_left_n_times_lose_nothing(v, s):
    want = brute(v, s)
    for n in (1, 2, 5, 40):
        got = pieces.segment_nbest(v, s, n)
        assert [x[0] for x in got] == [x[0] for x in want[:n]] and len({x[1] for x in got}) == len(got)
        assert got == pieces.segment_nbest(v, s, n)
        assert got == pieces.segment_nbest(v, s, 40)[:n]


@pytest.mark.parametrize("kind", ["equal", "random", "letters", "no pieces"])
def test_long_unbroken_texts(v, kind):
    """A hundred thousand characters without a space, in time in proportion."""
    import random
    import time

    rng = random.Random(2)
    draw = {"equal": lambda: "a", "random": lambda: chr(rng.randrange(33, 0x2000)), "letters": lambda: rng.choice("abcdefgh"), "no pieces": lambda: chr(0x10000 + rng.randrange(5000))}[kind]
    text = "".join(draw() for _ in range(100_000))
    took = {}
    for size in (25_000, 100_000):
        began = time.process_time()
        e = pieces.encode_batch(v, [text[:size]], 4)
        took[size] = time.process_time() - began
        assert pieces.decode_ids(v, e.ids) == text[:size]
        assert e.nbest[0] == sorted(e.nbest[0], reverse=True) and e.nbest[0][0] == e.score[0]
    assert took[100_000] < 20 and took[100_000] < 8 * max(took[25_000], 0.2)


TEXTS = ["hello world of the thing", " a  b", None, "", "x", "▁x ▁▁ <0x0A> </s>", "naïve café 😀\n\tz", "the the the", "y" * 90 + " z", " "]


def test_batches_agree_with_whole_text_search_and_round_trip(v):
    e = pieces.encode_batch(v, TEXTS, 4)
    for d, t in enumerate(TEXTS):
        ids = e.ids[e.starts[d] : e.starts[d + 1]]
        assert pieces.decode_ids(v, ids) == (t or "")
        if t:
            found = pieces.nbest(v, t, 4)
            assert [x[0] for x in found] == e.nbest[d]
            for _, other in found:
                assert pieces.decode_ids(v, other) == t


def test_columns(spark, odd_docs, no_docs):
    rows = pieces.decode_texts(pieces.encode_texts(odd_docs)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == sorted((r.doc_id or 0, r.text or "") for r in odd_docs.collect())
    assert all(r.nbest_scores == sorted(r.nbest_scores, reverse=True) and r.nbest_scores[0] == r.score for r in rows)
    second = next(r for r in rows if r.doc_id == 8).second_ids_sha256
    ids = pieces.nbest(pieces.load_vocabulary(), "one", 2)[1][1]
    assert second == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert pieces.encode_texts(no_docs).count() == 0
