import random
import re

import pyarrow as pa
import pytest

from storyloom.llm import decontaminate as dc


def words(t):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", (t or "").lower()).split()


def infix(item, text):
    d = list(range(len(item) + 1))
    best = d[-1]
    for t in text:
        new = [0]
        for k, x in enumerate(item):
            new.append(min(d[k] + (x != t), d[k + 1] + 1, new[-1] + 1))
        d = new
        best = min(best, d[-1])
    return best


def test_recall_against_brute_force():
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(200)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.randint(3, 45)) for _ in range(25)]
    texts = []
    for _ in range(250):
        w = list(rng.choice(items))
        for _ in range(rng.randint(0, dc.edit_limit(len(w), 0.2) + 1)):
            p = rng.randrange(len(w))
            match rng.choice("sid"):
                case "s":
                    w[p] = rng.choice(vocabulary)
                case "i":
                    w.insert(p, rng.choice(vocabulary))
                case _ if len(w) > 1:
                    del w[p]
        texts.append(", ".join([*say(rng.choice([0, 20])), *w, *say(rng.choice([0, 20]))]).upper())
    block = dc.prepare(list(range(25)), [" ".join(i) for i in items], 0.2)
    d, i, e, _, _ = dc.matches(pa.array(texts), block)
    got = {(a, b): c for a, b, c in zip(d.tolist(), block.ids[i].tolist(), e.tolist(), strict=True)}
    want = {(a, b): m for a, t in enumerate(texts) for b, w in enumerate(items) if (m := infix(w, words(t))) <= dc.edit_limit(len(w), 0.2)}
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.97 * len(want)


@pytest.mark.parametrize("n", [15, 25, 40, 59])
def test_recall_of_deletions_at_the_document_end(n):
    rng = random.Random(n)
    say = lambda k: [f"v{rng.randrange(5000)}" for _ in range(k)]
    items = [say(n) for _ in range(150)]
    texts = []
    for w in items:
        gone = set(rng.sample(range(n), dc.edit_limit(n, 0.2)))
        texts.append(" ".join([*say(40), *(x for k, x in enumerate(w) if k not in gone)]))
    block = dc.prepare(list(range(150)), [" ".join(i) for i in items], 0.2)
    d, i, _, _, _ = dc.matches(pa.array(texts), block)
    assert sum(a == b for a, b in zip(d.tolist(), block.ids[i].tolist(), strict=True)) >= 0.97 * 150


def test_odd_rows(spark, odd_docs, no_docs):
    base = odd_docs.where("doc_id = 1").first().text
    bench = spark.createDataFrame([(1, base), (2, None), (None, base), (3, ""), (1, base), (4, "one")], "item_id long, text string")
    rows = dc.contaminations(odd_docs, bench).collect()
    assert sorted({(r.doc_id, r.item_id) for r in rows if r.doc_id}) == [(1, 1), (2, 1), (3, 1), (8, 4), (10, 4)]
    assert sum(r.doc_id is None for r in rows) == 1
    kept = dc.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 5, 6, 7, 9, 11]
    assert dc.contaminations(no_docs, bench).count() == 0 and dc.contaminations(odd_docs, bench.limit(0)).count() == 0


def test_blocks_of_the_benchmark_give_the_same(spark, odd_docs):
    bench = odd_docs.where("doc_id in (1, 7, 11)").selectExpr("doc_id as item_id", "substr(text, 1, 300) as text")
    blocks = list(dc.item_blocks(bench, 0.2, 400))
    assert len(blocks) > 1 and sorted(i for b in blocks for i in b.ids.tolist()) == [1, 7, 11]


def test_unmatched_items_cost_next_to_nothing(spark):
    """Time over random texts with 50 and with 3,200 items that stand in none of them; and what does stand is found."""
    import time

    rng = random.Random(9)
    say = lambda n: " ".join(f"v{rng.randrange(400)}" for _ in range(n))
    texts = pa.array([say(400) for _ in range(100)])
    took = {}
    for n in (50, 3200):
        block = dc.prepare(list(range(n)), [say(rng.randint(20, 60)) for _ in range(n - 1)] + [" ".join(texts[7].as_py().split()[100:140])], 0.2)
        began = time.process_time()
        d, i, e, _, _ = dc.matches(texts, block)
        took[n] = time.process_time() - began
        assert (d.tolist(), i.tolist(), e.tolist()) == ([7], [n - 1], [0])
    assert took[3200] < 5


def test_items_of_one_word_over_and_over():
    """Such an item has too few different pairs for the index; every window is a candidate."""
    block = dc.prepare([1, 2], ["ha " * 30, "ha ho " * 12], 0.2)
    texts = pa.array(["x " * 20 + "ha " * 27 + "y", "ha ho " * 11 + "z", "no", "ha " * 10, None, ""])
    d, i, e, _, _ = dc.matches(texts, block)
    assert sorted(zip(d.tolist(), block.ids[i].tolist(), e.tolist(), strict=True)) == [(0, 1, 3), (1, 2, 2)]
