import math
import random
import re
from collections import Counter

from storyloom.llm import lm_scoring


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows, fitted=None):
    """Scores of the rows by the counts of `fitted`, or else of the rows themselves without each row's own bigrams."""
    corpus = [words_of(t) for _, t in (fitted if fitted is not None else rows)]
    uni = Counter(x for w in corpus for x in w)
    total = max(1, sum(uni.values()))
    pairs = Counter(b for w in corpus for b in zip(w, w[1:], strict=False))
    seen = lambda x: max(1, uni[x])
    out = {}
    for i, t in rows:
        w = words_of(t)
        own = Counter(zip(w, w[1:], strict=False))
        s = math.log(seen(w[0]) / total) if w else 0.0
        for (p, q), n in own.items():
            rest = pairs[p, q] - (n if fitted is None else 0)
            s += n * (math.log(rest / seen(p)) if rest else math.log(lm_scoring.ALPHA * seen(q) / total))
        n_words, score = out.get(i, (0, 0.0))
        out[i] = (n_words + len(w), score + s)
    return {i: (n, round(s, 5)) for i, (n, s) in out.items()}


def scored(df, model=None):
    return {r.doc_id: (r.n_words, round(r.log_score, 5)) for r in lm_scoring.lm_scores(df, model).collect()}


def close(got, want):
    return got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-4 for k in got)


def test_against_brute_force(spark, odd_docs, no_docs):
    assert close(scored(odd_docs), brute([(r.doc_id, r.text) for r in odd_docs.collect()]))
    assert scored(no_docs) == {}


def test_bounded_tables_change_nothing(spark, odd_docs, monkeypatch):
    """The same scores whether all n-grams, a few of them or none are sent to every task."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)] + [f"only{k}" for k in range(2000)]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 80))) for _ in range(150)]
    rows = list(enumerate([*texts, texts[3], texts[3], "alone", "w0 " * 500]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    for head, hot in ((1 << 20, 1 << 18), (40, 10), (0, 0), (0, 1 << 18), (1 << 20, 0)):
        monkeypatch.setattr(lm_scoring.fit, "__defaults__", (head, hot, True))
        assert close(scored(df), want), (head, hot)


def test_a_model_of_other_documents(spark, odd_docs, no_docs):
    other = [(1, "alpha beta gamma alpha beta"), (2, "of the one"), (3, None)]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for fitted in (other, []):
        model = lm_scoring.fit(spark.createDataFrame(fitted, "doc_id long, text string"))
        got = scored(odd_docs, model)
        assert all(math.isfinite(s) for _, s in got.values())
        assert close(got, brute(rows, fitted))
