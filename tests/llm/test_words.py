import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from storyloom.llm.words import LOWER, Words, ngram_hashes, starts_with_room

TEXT = st.text(alphabet="ab é\n\t\r\x0b\x0c\x00\x1f 😀", max_size=30)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_the_runs(texts):
    w = Words(pa.array(texts, pa.string()))
    data = w.buf.tobytes()
    for d, t in enumerate(texts):
        got = [data[w.start[k] : w.end[k]].decode() for k in range(w.doc[d], w.doc[d + 1])]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_equal_words_share_hashes_and_ngrams_room():
    w = Words(pa.array(["b a b", "xx B a"]), LOWER)
    assert w.hash[0] == w.hash[2] == w.hash[4] and len(np.unique(w.hash)) == 3
    grams = ngram_hashes(w.hash, 2)
    assert grams[4 - 0] == ngram_hashes(w.hash[4:], 2)[0] and grams[0] != grams[1]
    assert starts_with_room(w.doc, 2).tolist() == [True, True, False, True, True, False]
