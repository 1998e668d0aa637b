"""What must not grow with the rounds of a loop, or with the split of the input."""

from pyspark.sql import functions as F

from plumbline.functions.checkpoints import cut
from plumbline.operators import capset, graph, interproc


def size_in_bytes(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_cut_ends_the_estimate_of_size(spark):
    a = cut(spark.createDataFrame([(i, i) for i in range(9)], "k long, v long"))
    first = size_in_bytes(a)
    for _ in range(4):
        a = cut(a.join(a.select("k", F.col("v").alias("w")), "k").select("k", (F.col("v") + F.col("w") - F.col("v")).alias("v")))
    assert size_in_bytes(a) == first
    assert {tuple(r) for r in a.collect()} == {(i, i) for i in range(9)}
    assert [f.dataType.simpleString() for f in a.schema] == ["bigint", "bigint"]


def test_fixpoint_writes_one_table_a_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(interproc, "cut", lambda df: written.append(1) or cut(df))

    def tables(length):
        written.clear()
        nodes = spark.createDataFrame([(f"{i:02}", f"{i:02}") for i in range(length + 1)], "node string, fn string")
        edges = spark.createDataFrame([(f"{i:02}", f"{i + 1:02}") for i in range(length)], "src string, dst string")
        caps, states = interproc.summaries(nodes, edges, nodes.select("fn", F.lit("exec").alias("capability"), F.lit(0.9).alias("confidence")))
        return len(written), [r.depth for r in states.orderBy("node").collect()]

    (few, _), (many, depths) = tables(4), tables(8)
    assert depths == [0, 3, 2, 1, 0, 3, 2, 1, 0]
    assert many - few == 4


def test_searches_of_few_modules_are_spread(spark):
    modules = spark.range(400).groupBy((F.col("id") % 40).alias("module")).agg(F.max("id").alias("score"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(39)], "src long, dst long")
    assert graph.transitive_scores(modules, edges).select(F.spark_partition_id()).distinct().count() > 1


def test_a_mean_of_070_is_not_below_it(spark):
    rows = [(n, "exec", c) for n in range(1, 31) for c in [0.6] * 2 * n + [0.9] * n]
    got = capset.per_capability(spark.createDataFrame(rows, "package long, capability string, confidence double").coalesce(1))
    assert {(r.confidence, r.n_evidence == 3 * r.package) for r in got.collect()} == {(0.7, True)}
