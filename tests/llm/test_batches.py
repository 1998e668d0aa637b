"""Batches that go to workers: what they may hold, and that nothing depends on it."""

import pyarrow as pa
import pytest

import corpus_pipeline
from plumbline.llm import common

SF = "/root/testdata/sf0.001"
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture(autouse=True)
def unset(spark):
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY)


def test_batches_of_long_texts_are_bounded(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 4000) AS text")
    rows = common.pick(docs, "doc_id", "text").mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in rows) == 2000 and max(r.bytes for r in rows) < 5 << 20


def test_the_bound_of_the_session_stays(spark):
    spark.conf.set(KEY, "123456")
    common.ship(spark)
    assert spark.conf.get(KEY) == "123456"


def test_pipeline_is_that_of_batches_of_any_size(spark):
    found = []
    for most in ("64m", "20k"):
        spark.conf.set(KEY, most)
        found.append(sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()))
    assert found[0] and found[0] == found[1]
