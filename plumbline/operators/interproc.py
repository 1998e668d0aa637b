"""Interprocedural analysis: call-string cloning, summaries, propagation, taint through calls.

``functions`` (fn, package, name), ``calls`` (caller, callee: a multiset),
``direct`` (fn, capability, confidence). A node is a function in the context of its
immediate caller: fn@caller, or fn@<entry>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.checkpoints import cut
from ..model import MAX_HOPS
from . import graph, taint

ENTRY = "<entry>"


def entries(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """fn: callers that nobody calls, and functions named main or init; all, where there are none."""
    callers = calls.select(F.col("caller").alias("fn")).distinct()
    callees = calls.select(F.col("callee").alias("fn")).distinct()
    top = functions.join(callers, "fn", "left_semi").join(callees, "fn", "left_anti").select("fn")
    out = cut(top.unionByName(functions.filter(F.col("name").isin("main", "init")).select("fn")).distinct())
    return functions.select("fn").distinct() if out.isEmpty() else out


def _key(fn: Column, context: Column) -> Column:
    return F.concat(fn.cast("string"), F.lit("@"), F.coalesce(context.cast("string"), F.lit(ENTRY)))


def contexts(functions: DataFrame, calls: DataFrame, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, fn, context) and edges (src, dst, with multiplicity) of the cloned call graph.

    No search node by node: functions that entries reach are one closure, and each
    call of such a function is one node. k = 0 merges contexts, anything above is 1.
    """
    start = entries(functions, calls)
    reach = cut(graph.closure(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), start.select(F.col("fn").alias("node"))).select(F.col("node").alias("fn")))
    live = calls.join(reach.withColumnRenamed("fn", "caller"), "caller", "left_semi")
    none = F.lit(None).cast(calls.schema["caller"].dataType)
    context = F.col("caller") if k else none
    nodes = start.select("fn", none.alias("context")).unionByName(live.select(F.col("callee").alias("fn"), context.alias("context"))).distinct()
    nodes = cut(nodes.select(_key(F.col("fn"), F.col("context")).alias("node"), "fn", "context"))
    steps = live.select(F.col("caller").alias("fn"), "callee", _key(F.col("callee"), context).alias("dst"))
    edges = nodes.select(F.col("node").alias("src"), "fn").join(steps, "fn").select("src", "dst")
    return nodes, cut(edges)


def summaries(nodes: DataFrame, edges: DataFrame, direct: DataFrame, max_rounds: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Caps (node, kind, capability, confidence, n) and states (node, depth, confidence) at the fixpoint.

    kind is effect or transitive. Members of a component have the union of its effects,
    nothing transitive, depth 0. A callee at depth 3 gives nothing. All nodes are
    computed anew each round until nothing changes: the function isn't monotone, and
    outside of components the graph has no cycle, so the fixpoint is unique.
    """
    own = nodes.join(direct, "fn").select("node", "capability", F.col("confidence").alias("conf"))
    parts = cut(graph.components(edges).join(nodes.select("node"), "node", "left_semi"))
    shared = own.join(parts, "node").select("scc", "capability", "conf")
    shared = parts.join(shared, "scc").select("node", "capability", "conf")
    effects = own.join(parts.select("node"), "node", "left_anti").unionByName(shared)
    effects = cut(effects.groupBy("node", "capability").agg(F.avg("conf").alias("conf"), F.count("*").alias("n")))
    open_ = cut(edges.join(parts.select(F.col("node").alias("src")), "src", "left_anti").repartition("dst"))
    names = effects.groupBy("node").agg(F.sort_array(F.collect_list("capability")).alias("own"))
    none = F.array().cast("array<struct<capability:string,conf:double,n:bigint>>")
    state = nodes.select("node").join(names, "node", "left").select("node", F.coalesce("own", F.array().cast("array<string>")).alias("own"), F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"), none.alias("carried"), F.lit(True).alias("moved"))
    state = cut(state)
    rounds = 0
    while rounds < max_rounds:
        rounds += 1
        given = F.explode(F.concat("own", "carried.capability")).alias("capability")
        near = state.filter(F.col("depth") + 1 <= MAX_HOPS).select(F.col("node").alias("dst"), (F.col("depth") + 1).alias("d"), (F.col("confidence") * S.hop(F.col("depth") + 1)).alias("c"), given)
        # one shuffle by src serves both groupings and the join with the state
        got = open_.join(near, "dst").repartition("src").groupBy("src", "capability").agg(F.avg("c").alias("conf"), F.count("*").alias("n"), F.max("d").alias("d"), F.min("c").alias("c"))
        got = got.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("capability", "conf", "n"))).alias("got"), F.max("d").alias("d"), F.min("c").alias("c"))
        depth, conf, got_ = F.coalesce("d", F.lit(0)), F.coalesce(F.least("c", F.lit(1.0)), F.lit(1.0)), F.coalesce("got", none)
        moved = (depth != F.col("depth")) | (F.round(conf, 3) != F.round("confidence", 3)) | (got_["capability"] != F.col("carried.capability"))
        state = cut(state.drop("moved").join(got, "node", "left").select("node", "own", depth.alias("depth"), conf.alias("confidence"), got_.alias("carried"), moved.alias("moved")))
        if state.filter("moved").isEmpty():
            break
    carried = state.select("node", F.explode("carried").alias("x")).select("node", "x.capability", "x.conf", "x.n")
    caps = effects.withColumn("kind", F.lit("effect")).unionByName(carried.withColumn("kind", F.lit("transitive")))
    return caps.select("node", "kind", "capability", F.col("conf").alias("confidence"), "n"), state.select("node", "depth", "confidence")


def findings(nodes: DataFrame, caps: DataFrame, states: DataFrame, functions: DataFrame) -> DataFrame:
    """Rules whose source and sink a node has, directly in that role or by its callees; one per package and rule.

    Sinks are only what has the role of a sink, so rules that end in network, crypto or
    reflect need a callee.
    """
    spark = nodes.sparkSession
    rules = F.broadcast(taint.rules(spark))
    shown = caps.withColumn("role", S.role(F.col("capability")))
    able = lambda role: shown.filter((F.col("kind") == "transitive") | (F.col("role") == role)).select("node", "capability").distinct()
    best = caps.groupBy("node", "capability").agg(F.max(F.when(F.col("kind") == "effect", F.col("confidence"))).alias("e"), F.max(F.when(F.col("kind") == "transitive", F.col("confidence"))).alias("t"))
    best = best.join(states.select("node", F.col("confidence").alias("own")), "node").select("node", "capability", F.when(F.col("e") > 0, F.col("e")).when(F.col("t") > 0, F.col("t")).otherwise(F.col("own")).alias("c"))
    both = able("source").withColumnRenamed("capability", "source").join(rules, "source").join(able("sink").withColumnRenamed("capability", "sink"), ["node", "sink"])
    both = both.join(best.select("node", F.col("capability").alias("source"), F.col("c").alias("sc")), ["node", "source"]).join(best.select("node", F.col("capability").alias("sink"), F.col("c").alias("kc")), ["node", "sink"])
    conf = F.least("sc", "kc")
    rows = both.join(nodes.select("node", "fn"), "node").join(functions.select("fn", "package"), "fn", "left")
    rows = rows.select(F.coalesce(F.col("package").cast("string"), F.lit(".")).alias("package"), "node", "source", "sink", S.downgrade(F.col("risk"), conf).alias("risk"), "note", conf.alias("confidence"))
    return taint.first_of_each(rows, "node")


def traced(found: DataFrame, edges: DataFrame, caps: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings with the call path (array of nodes, empty where both ends are in one node) and whether it is uncertain."""
    effects = cut(caps.filter("kind = 'effect'").select("node", "capability"))
    at = effects.select("node", F.col("capability").alias("source"), F.lit(True).alias("s"))
    ends = found.join(at, ["node", "source"], "left").join(effects.select("node", F.col("capability").alias("sink"), F.lit(True).alias("k")), ["node", "sink"], "left")
    ends = cut(ends.withColumn("direct", F.coalesce(F.col("s") & F.col("k"), F.lit(False))).drop("s", "k"))
    way = graph.paths(edges, ends.filter("NOT direct").select(F.col("sink").alias("key"), "node"), effects.select(F.col("capability").alias("key"), "node"), limit)
    out = ends.join(way.select(F.col("key").alias("sink"), F.col("start").alias("node"), "path"), ["sink", "node"], "left")
    safe = effects.filter("capability = 'crypto'").select(F.col("node").alias("__n")).distinct()
    last = F.coalesce(F.element_at("path", -1), F.col("node"))
    out = out.withColumn("__last", last).join(safe.withColumn("__a", F.lit(True)), F.col("node") == F.col("__n"), "left").drop("__n").join(safe.withColumn("__b", F.lit(True)), F.col("__last") == F.col("__n"), "left").drop("__n")
    none = F.array().cast("array<string>")
    return out.select("package", "node", "source", "sink", "risk", "note", "confidence", F.coalesce("path", none).alias("path"), (~F.col("direct") & F.col("path").isNull()).alias("uncertain"), (F.coalesce("__a", F.lit(False)) | F.coalesce("__b", F.lit(False))).alias("sanitized"))


def hints(nodes: DataFrame, caps: DataFrame, functions: DataFrame) -> DataFrame:
    """package: those with a node that has a sink, or anything transitive."""
    live = caps.filter((F.col("kind") == "transitive") | (S.role(F.col("capability")) == "sink")).select("node").distinct()
    return nodes.join(live, "node", "left_semi").join(functions, "fn").select("package").distinct()


def rolled_up(nodes: DataFrame, caps: DataFrame, functions: DataFrame) -> DataFrame:
    """package, capability, confidence, n: transitive capabilities of all contexts of a package's functions."""
    t = caps.filter("kind = 'transitive'").join(nodes.select("node", "fn"), "node").join(functions, "fn")
    return t.groupBy("package", "capability").agg((F.sum(F.col("confidence") * F.col("n")) / F.sum("n")).alias("confidence"), F.sum("n").cast("long").alias("n"))


def within_package(functions: DataFrame, calls: DataFrame, direct: DataFrame, rounds: int = 3) -> DataFrame:
    """fn, capability, hops, confidence: what callees of the same package add in synchronous rounds."""
    p = functions.select("fn", "package")
    inside = calls.join(p.select(F.col("fn").alias("caller"), "package"), "caller").join(p.select(F.col("fn").alias("callee"), F.col("package").alias("q")), "callee").filter("package = q").select("caller", "callee").distinct()
    base = direct.groupBy("fn", "capability").agg(F.max("confidence").alias("confidence"))
    have = cut(base.withColumn("hops", F.lit(0)))
    frontier = have
    for r in range(1, rounds + 1):
        up = inside.join(frontier.withColumnRenamed("fn", "callee"), "callee").groupBy(F.col("caller").alias("fn"), "capability").agg(F.max("confidence").alias("c"))
        frontier = cut(up.join(have, ["fn", "capability"], "left_anti").select("fn", "capability", (F.col("c") * S.hop(F.lit(r)) / S.hop(F.lit(r - 1))).alias("confidence"), F.lit(r).alias("hops")))
        if frontier.isEmpty():
            break
        have = have.unionByName(frontier)
    return have.filter("hops > 0").select("fn", "capability", "hops", "confidence")
