from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from foldwise.llm.tokens import split_words, text_chunks, windows

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\né9", max_size=25)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 40))
def test_words_and_windows_match_plain_python(rows, limit):
    seen, n = {}, 0
    for a, b, data, begin in text_chunks(pa.array(rows, type=pa.string()), limit):
        w = split_words(data, begin, lower=True)
        h = w.hashes()
        for i in range(a, b):
            want = (rows[i] or "").encode().lower().split()
            lo, hi = w.first[i - a], w.first[i - a + 1]
            assert [data_word(w, k) for k in range(lo, hi)] == want
            for word, value in zip(want, h[lo:hi].tolist()):
                assert seen.setdefault(word, value) == value
        at, x = windows(h, w.first, 3)
        want = [k for i in range(b - a) for k in range(w.first[i], w.first[i + 1] - 2)]
        assert at.tolist() == want
        n += b - a
    assert n == len(rows) and len(set(seen.values())) == len(seen)


def data_word(w, k):
    return w.data[w.starts[k]:w.ends[k]].tobytes()


def test_equal_windows_have_equal_hashes_anywhere():
    words = "a b c d e a b c x a b c".split()
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    w = split_words(data, np.array([0, len(data)]))
    at, x = windows(w.hashes(), w.first, 3)
    assert x[0] == x[5] == x[9] and len(set(x.tolist())) == len(x) - 2
