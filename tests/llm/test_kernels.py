import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import kernels as K

TEXTS = st.lists(st.one_of(st.none(), st.text("aB éñ\n\t x1.", max_size=60)), max_size=8)


def split(t):
    return re.findall(r"[^ \t\n\r\f\v]+", (t or "").lower())


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_words_and_ngrams_are_those_of_a_plain_split(texts, n):
    w, counts = K.words(pa.array(texts, pa.string()))
    plain = [split(t) for t in texts]
    assert counts.tolist() == [len(p) for p in plain]
    flat = [x for p in plain for x in p]
    assert len(set(zip(flat, w.tolist()))) == len(set(flat)) == len(set(w.tolist()))
    g, have = K.ngrams(w, counts, n)
    grams = [tuple(p[i : i + n]) for p in plain for i in range(max(1, len(p) - n + 1) if p else 0)]
    assert len(g) == len(grams) == have.sum()
    assert len(set(zip(grams, g.tolist()))) == len(set(grams)) == len(set(g.tolist()))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=1, max_size=4), st.integers(1, 3), st.integers(1, 5))
def test_anchors_are_the_least_of_each_window(docs, k, w):
    counts = np.array([len(d) for d in docs])
    words = K.mix(np.array([x for d in docs for x in d], np.uint64) + np.uint64(9))
    first, h = K.anchors(words, counts, k, w)
    want, at = set(), 0
    for d in docs:
        own = words[at : at + len(d)]
        hashes = [int(K.rolling(own, np.array([i]), np.array([i + k]))[0]) for i in range(len(d) - k + 1)]
        for i in range(len(hashes) - w + 1):
            least = min(hashes[i : i + w])
            want |= {at + j for j in range(i, i + w) if hashes[j] == least}
        at += len(d)
    assert set(first.tolist()) == want


def test_long_inputs_hash_like_short_ones():
    word = "x" * 3_000_000
    w, counts = K.words(pa.array([f"a {word} b", word, "b a"]))
    assert counts.tolist() == [3, 1, 2] and w[1] == w[3] and w[0] == w[5] and w[2] == w[4]
