import random
import re

from storyloom.llm import jaccard
from storyloom.llm.components import connected_components


def brute(rows, n, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    least[max(x, y)] = min(x, y)
    return sorted([(i, len(sets[i] if i is not None else shingles(t)), None if i is None else find(i)) for i, t in rows], key=repr)


def run(df, n, percent):
    return sorted([tuple(r) for r in jaccard.similar_groups(df, n, percent).collect()], key=repr)


def test_chains_of_edits_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for _ in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary).upper()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, 4, 85) == brute(rows, 4, 85)
    assert run(df, 5, 80) == brute(rows, 5, 80)


def test_a_group_whose_members_link_only_in_part(spark):
    rng = random.Random(11)
    base = [f"b{k}" for k in range(70)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(70)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(text)))
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85) == brute(rows, 4, 85)


def test_odd_rows(spark, odd_docs, no_docs):
    assert run(odd_docs, 4, 85) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], 4, 85)
    assert jaccard.similar_groups(no_docs).count() == 0
    kept = jaccard.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8, 9, 11]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 1), (5, 3), (3, 5), (140, 7)]
    got = {r.doc_id: r.component_id for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 7 for i in range(100, 141)}, 7: 7, 5: 3, 3: 3}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
