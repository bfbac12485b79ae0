import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import words as w

from .rows import words_of

TEXT = st.lists(st.sampled_from(list("abAB é日\t\n\r\x0b\x0c  .,'!|0") + ["xyzzyxyzzy"]), max_size=60).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_hashes_follow_words(texts):
    h, begin = w.hashed_words(pa.array(texts, pa.string()))
    flat = [x for t in texts for x in words_of(t)]
    assert np.diff(begin).tolist() == [len(words_of(t)) for t in texts]
    seen = {}
    for word, value in zip(flat, h.tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_slices_and_long_words():
    column = pa.array(["one two", None, "three", "x" * 100_000 + " y"]).slice(1)
    h, begin = w.hashed_words(column)
    assert np.diff(begin).tolist() == [0, 1, 2]
    assert h[0] == w.hashed_words(pa.array(["three"]))[0][0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(2**63, 2**63 + 40), max_size=200))
def test_grouping(values):
    h = np.array(values, np.uint64)
    distinct, first, inverse = w.unique_inverse(h)
    want, back = np.unique(h, return_inverse=True)
    assert distinct.tolist() == want.tolist() and inverse.tolist() == back.tolist() and h[first].tolist() == want.tolist()
