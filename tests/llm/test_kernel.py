from __future__ import annotations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import textkernel as tk

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té\x1c\xa0", max_size=120)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_shingles(texts, size):
    old, tk.SLICE = tk.SLICE, size
    try:
        raw, offsets = tk.text_bytes(pa.array(texts, pa.string()))
        h, bounds = tk.word_hashes(raw, offsets)
        s, at = tk.shingle_hashes(h, bounds)
    finally:
        tk.SLICE = old
    words = [(t or "").encode().split() for t in texts]
    assert [bounds[k + 1] - bounds[k] for k in range(len(texts))] == [len(w) for w in words]
    names: dict = {}
    for x, w in zip(h.tolist(), [w for ws in words for w in ws], strict=True):
        assert names.setdefault(x, w) == w
    assert len(set(names.values())) == len(names)
    runs = [[tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else [] for w in words]
    assert [at[k + 1] - at[k] for k in range(len(texts))] == [len(r) for r in runs]
    seen: dict = {}
    for x, r in zip(s.tolist(), [r for rs in runs for r in rs], strict=True):
        assert seen.setdefault(x, r) == r
    assert len(set(seen.values())) == len(seen)


def test_parts():
    import numpy as np

    assert list(tk.parts(np.array([0, 3, 6, 20, 21]), 6)) == [(0, 2), (2, 3), (3, 4)]
    assert list(tk.parts(np.array([0]), 6)) == []
