"""Operator 6 against all pairs: none is left out, and a document is one row."""

import itertools

import numpy as np
import pytest
from helpers import awkward, documents, empty, prose, words
from test_bruteforce import planted

from plumbline.llm import neardup


def by_brute_force(text: dict) -> set:
    sets = {i: frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) for i, w in text.items()}
    links, top = dict.fromkeys(sets, 0), {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            low, high = sorted((top[a], top[b]))
            top = {i: low if t == high else t for i, t in top.items()}
    return {(i, top[i], links[i]) for i in sets}


def test_pairs_at_the_threshold_are_all_found(spark):
    """40 of 80 grams in common, a thousand times: keys of min-hashes miss one in a hundred."""
    rows = []
    for i in range(1000):
        w, v = prose(i, 62, 10**6).split(), prose(10**4 + i, 20, 10**6).split()
        rows += [(2 * i, " ".join(w), "s", "en"), (2 * i + 1, " ".join(w[:42] + v), "s", "en")]
    got = {(r.doc_a, r.doc_b): r.jaccard for r in neardup.similar_pairs(documents(spark, rows)).collect()}
    assert got == {(2 * i, 2 * i + 1): 0.5 for i in range(1000)}


@pytest.mark.parametrize(("tile", "limit"), [(1 << 20, 100), (300, 0)])
def test_links_are_those_of_brute_force(spark, monkeypatch, tile, limit):
    """Also where labels are compared tile by tile, which bounds what a task holds."""
    docs, text = planted(spark, 90)
    base = prose(77, 60).split()
    rows = []
    for i in range(40):  # a group of which each text differs
        w = [*base[: 60 - i % 13], *prose(500 + i, 4 + i).split()]
        text[1000 + i] = words(" ".join(w))
        rows.append((1000 + i, " ".join(w), "s", "en"))
    monkeypatch.setattr(neardup, "TILE", tile)
    got = [tuple(r) for r in neardup.linked(docs.unionByName(documents(spark, rows)), broadcast_ids=limit).collect()]
    assert len(got) == len(text) and set(got) == by_brute_force(text)
    assert max(r[2] for r in got) > 20


@pytest.mark.parametrize(("few", "size"), [(1000, 1 << 25), (0, 1 << 25), (0, 64)])
def test_overlaps_by_any_width_of_bitmaps(monkeypatch, few, size):
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 400, r.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    n = np.array([len(s) for s in sets])
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "MAP_BYTES", size)
    i, j = np.triu_indices(30, 1)
    got = neardup.Shared(np.concatenate(sets), np.cumsum(n) - n, n).overlaps(i, j)
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]


def test_rows_of_op6_are_those_of_documents(spark, sf):
    from plumbline.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op6_ngram_jaccard"](spark, sf).collect()
    assert len(rows) == docs.count()
    assert {tuple(r) for r in rows} == by_brute_force({r.doc_id: words(r.text) for r in docs.collect() if words(r.text)}) | {(r.doc_id, r.doc_id, 0) for r in docs.collect() if not words(r.text)}


def test_links_of_awkward_rows(spark):
    got = sorted(tuple(r) for r in neardup.linked(awkward(spark)).collect())
    assert got == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 1), (6, 5, 1), (7, 7, 0), (8, 8, 0), (9, 9, 0)]
    assert neardup.linked(empty(spark)).isEmpty()
