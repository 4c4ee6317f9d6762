import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmith.llm import textops as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té日,.Z0", max_size=40)), max_size=8)


@given(TEXTS)
@settings(max_examples=100, deadline=None)
def test_words(texts):
    for marks, gap in ((T.SPACED, T.SPACED_GAP), (T.ALNUM, T.ALNUM_GAP)):
        w = T.words(pa.array(texts, pa.string()), marks)
        got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.starts[lo:hi], w.ends[lo:hi])] for lo, hi in zip(w.offsets, w.offsets[1:])]
        assert got == [[x for x in re.split(gap, t or "") if x] for t in texts]
        flat = [x for one in got for x in one]
        h = T.word_hashes(w)
        assert len({*zip(flat, h.tolist())}) == len({*flat}) == len({*h.tolist()})


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 20))
@settings(max_examples=100, deadline=None)
def test_ngrams_and_sliding(values, n):
    x = T.mix(np.array(values, np.uint64))
    g = T.ngram_hashes(x, n)
    runs = [tuple(values[i : i + n]) for i in range(len(values) - n + 1)]
    assert len(g) == len(runs) and len({*zip(runs, g.tolist())}) == len({*runs}) == len({*g.tolist()})
    assert T.sliding(x, n, np.minimum).tolist() == [x[i : i + n].min() for i in range(len(values) - n + 1)]


def test_slices_cover_all():
    texts = pa.array(["a" * n for n in (1, 0, 50, 3, 3, 3, 100)])
    got = [*T.slices(texts, 10)]
    assert [i for lo, hi in got for i in range(lo, hi)] == [*range(7)]
    assert [*T.slices(pa.array([], pa.string()))] == []
    part = texts.slice(2, 3)
    assert T.raw(part)[0].tobytes() == b"a" * 56
