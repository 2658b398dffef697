import random

import pytest

DOCS = "doc_id long, text string, extra int, h long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, one long text, repeated rows, ties, clashing extra columns."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "naïve", "😀", "x"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(60)
    rows = [
        (1, base, 1, 1), (2, base, None, 2), (3, say(10) + "\n" + base + "\t" + say(30), 1, None), (4, None, 1, 1), (5, "", 1, 1), (6, " \t\n", 1, 1),
        (7, say(20_000), 1, 1), (8, "one", 1, 1), (9, "ha " * 200, 1, 1), (10, "one", 1, 1), (None, base, 1, 1), (None, None, None, None), (2, base, None, 2), (11, say(80), 1, 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
