import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import textops as T

from helpers import words

texts = st.lists(st.text(alphabet="aBé É×.,-\n\tß0日", max_size=40), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_the_regular_expression(rows):
    w = T.words(*T.buffers(pa.array(rows)))
    seen = {}
    for i, text in enumerate(rows):
        want = words(text)
        got = w.hash[w.first[i] : w.first[i + 1]].tolist()
        assert len(got) == len(want)
        for a, b in zip(want, got, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_piece(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500))
    one = T.words(*T.buffers(pa.array([text]))).hash
    monkeypatch.setattr(T, "PIECE", 16)
    assert (T.words(*T.buffers(pa.array([text]))).hash == one).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 80))
def test_span_hash_names_spans(n, size):
    h = np.random.default_rng(size).integers(0, 4, size).astype(np.uint64)
    got = T.span_hash(h, n)
    assert len(got) == max(0, size - n + 1)
    names = {}
    for i, x in enumerate(got.tolist()):
        assert names.setdefault(tuple(h[i : i + n].tolist()), x) == x
    assert len(set(names.values())) == len(names)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 9))
def test_winnow_takes_the_last_of_the_smallest(values, w):
    g = np.array(values, np.uint64)
    start, pick = T.winnow(g, np.array([0]), np.array([len(g)]), w)
    want = []
    for s in range(max(1, len(g) - w + 1)) if len(g) else []:
        part = values[s : s + w]
        want.append((s, s + max(i for i, v in enumerate(part) if v == min(part))))
    assert sorted(zip(start.tolist(), pick.tolist(), strict=True)) == want


def test_nulls_and_empty_batches():
    w = T.words(*T.buffers(pa.array([None, "", "a b"], pa.string())))
    assert np.diff(w.first).tolist() == [0, 0, 2]
    assert len(T.words(*T.buffers(pa.array([], pa.string()))).hash) == 0
    assert [b.num_rows for b in T.text_chunks(iter([pa.RecordBatch.from_arrays([pa.array(["x" * 10] * 5)], ["text"])]), "text", 20)] == [2, 2, 1]
