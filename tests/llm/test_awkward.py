"""Every operator on awkward and on empty tables: no crash, and the results that the docstrings define."""

import pytest

import corpus_pipeline
from plumbline.llm import decontaminate, langid, mixing, neardup, pii, quality, substring, tokens, urlfilter, warc

from helpers import LONG, awkward, empty, prose


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(1, 30)), (2, None), (None, prose(9, 40)), (3, "short"), (1, prose(1, 30))], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, None, None), (5, 1, 0), (9, 0, 0), (None, 1, 1), (5, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")


def test_decontamination(spark, bench):
    got = {(r.doc_id, r.item_id, r.n_words) for r in decontaminate.contaminated(awkward(spark), bench).collect()}
    assert got == {(5, 1, 30), (6, 1, 30), (None, 1, 30)}
    left = sorted(r.doc_id or -1 for r in decontaminate.decontaminate(awkward(spark), bench).collect())
    assert left == [-1, 1, 2, 3, 4, 7, 8, 9]  # the copy without an id goes too
    assert decontaminate.contaminated(empty(spark), bench).isEmpty()
    assert decontaminate.contaminated(awkward(spark), bench.limit(0)).isEmpty()


def test_quality(spark, labels):
    model = quality.fit(awkward(spark), labels)
    rows = quality.scores(awkward(spark), model).collect()
    assert len(rows) == 12
    assert all(r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 9))
    kept = quality.accepted(awkward(spark), model)
    assert kept.columns == awkward(spark).columns
    assert quality.accepted(empty(spark), quality.fit(empty(spark), labels)).isEmpty()
    nothing = quality.fit(awkward(spark), labels.limit(0))
    assert {r.doc_id for r in quality.scores(awkward(spark), nothing).collect() if r.score == 1} == {4, 5, 6, 7, 8, None}


def test_mixing(spark):
    lens = mixing.lengths(awkward(spark)).collect()
    assert sorted(r.n_tokens for r in lens if r.doc_id in (1, 2, 3, 9)) == [0, 0, 0, 0]
    assert next(r.n_tokens for r in lens if r.doc_id == 4) == len(LONG.split())
    out = mixing.mixed(awkward(spark), share=1.0)
    assert out.columns == awkward(spark).columns
    ids = [r.doc_id for r in out.collect()]
    assert 1 not in ids and 4 in ids and ids.count(6) == 2
    assert mixing.mixed(empty(spark)).isEmpty()


def test_tokens(spark):
    rows = tokens.token_counts(awkward(spark)).collect()
    assert len(rows) == 12
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert tokens.token_counts(empty(spark)).isEmpty()


def test_near_duplicates(spark):
    got = {(r.doc_a, r.doc_b): r.jaccard for r in neardup.similar_pairs(awkward(spark)).collect()}
    assert got == {(5, 6): 1.0}
    kept = neardup.deduplicated(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 8, 9]
    assert neardup.similar_pairs(empty(spark)).isEmpty()


def test_substrings(spark):
    rows = substring.repeats(awkward(spark)).collect()
    assert {(r.doc_id, r.start, r.end, r.later) for r in rows if r.doc_id in (5, 6)} == {(5, 0, 80, 0), (6, 0, 80, 80)}
    assert {r.doc_id for r in rows} <= {4, 5, 6}
    assert substring.repeats(empty(spark)).isEmpty()


def test_personal_data(spark):
    assert pii.spans(awkward(spark)).isEmpty()
    out = pii.redacted(awkward(spark))
    assert out.columns == awkward(spark).columns and out.count() == 12
    assert pii.spans(empty(spark)).isEmpty() and pii.redacted(empty(spark)).isEmpty()


def test_language(spark):
    d = awkward(spark)
    rows = langid.identify(d, langid.dictionaries(d)).collect()
    assert len(rows) == 12
    assert all(r.lang == "und" and not r.accepted for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.lang == "und" for r in langid.identify(d, {}).collect())
    assert langid.dictionaries(empty(spark)) == {}


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, None, "k"), (None, "http://a.b/", "x", "k"), (2, "no url", "", "k"), (2, "no url", "", "k")], "page_id long, url string, html string, key string")
    index = warc.write(pages, str(tmp_path / "w"))
    assert index.count() == 4
    assert warc.write(pages.limit(0), str(tmp_path / "e")).isEmpty()
    assert (tmp_path / "e" / "MANIFEST.json").exists()


def test_url_filters(spark):
    events = spark.createDataFrame(
        [("l", "b.com", "add", "2024-01-02"), ("l", "b.com", "add", "2024-01-02"), ("l", "b.com", "remove", "2024-02-01"), (None, "b.com", "add", "2024-01-01"), ("l", None, "add", "2024-01-01"), ("l", "c.com", "add", None), ("l", "c.com", "drop", "2024-01-01"), ("m", "D.com/x/", "add", "2024-01-01"), ("z", "e.com", "add", "2024-01-05"), ("z", "e.com", "remove", "2024-01-05")],
        "list string, entry string, action string, at string",
    )
    rows = [(1, "http://a.b.com/p", "2024-01-15"), (2, "http://a.b.com/p", "2024-02-01"), (3, "http://ab.com", "2024-01-15"), (4, None, "2024-01-15"), (5, "http://b.com", None), (6, "https://u@D.COM:8080/x/y?q", "2024-06-01"), (7, "http://d.com/xy", "2024-06-01"), (None, "http://c.com", "2024-06-01"), (8, "http://e.com", "2024-06-01"), (1, "http://a.b.com/p", "2024-01-15")]
    caps = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, fetched string, list string")
    for limit in (10, 0):
        got = sorted((r.page_id or -1, r.lists) for r in urlfilter.evaluate(caps, events, limit).collect())
        assert got == [(-1, ""), (1, "l"), (1, "l"), (2, ""), (3, ""), (4, ""), (5, ""), (6, "m"), (7, ""), (8, "")]
    assert urlfilter.evaluate(caps.limit(0), events).isEmpty()
    assert all(not r.blocked for r in urlfilter.evaluate(caps, events.limit(0)).collect())


def test_pipeline_stages(spark, bench, labels, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (awkward(spark), empty(spark)):
        docs, columns = start, start.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            path = str(tmp_path / f"{name}-{start.count()}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == columns, name
