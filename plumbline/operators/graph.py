"""Graph operators as loops of joins. Edges are (src, dst); a loop's state is checkpointed each round."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import cut

#: Edges up to which strongly connected components are found on the driver; beyond that by colouring.
DRIVER_EDGES = 200_000
#: Module edges up to which the graph is broadcast for depth-first scores; beyond that each root gathers its own part.
BROADCAST_EDGES = 500_000


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, uses, used_by: with multiplicity, self loops included."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("uses"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("used_by"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("used_by", F.lit(0)).alias("used_by"))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes without incoming edges."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return roots(reverse(edges))


def bfs(edges: DataFrame, seeds: DataFrame, start: int = 0, limit: int | None = None) -> DataFrame:
    """node and its least distance from the seeds (node), which have ``start``.

    Targets that are no package still get a distance. Only the frontier is joined
    with the edges; these are shuffled once.
    """
    steps = cut(edges.select("src", "dst").distinct().repartition("src"))
    frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(start)))
    found, depth = [frontier], start
    while limit is None or depth < limit:
        depth += 1
        seen = reduce(DataFrame.unionByName, found).select("node")
        reached = frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found.append(frontier)
    return reduce(DataFrame.unionByName, found)


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes that can be reached, the seeds among them."""
    return bfs(edges, seeds).select("node")


def longest(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node and the length of the longest path from the seeds, on an acyclic graph.

    Round k holds the nodes with a path of k edges; the last round a node is in wins.
    """
    steps = cut(edges.select("src", "dst").distinct().repartition("src"))
    frontier = cut(seeds.select("node").distinct())
    found, depth = [frontier.withColumn("depth", F.lit(0))], 0
    while True:
        depth += 1
        frontier = cut(frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct())
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.max("depth").alias("depth"))


def levels(edges: DataFrame) -> DataFrame:
    """Topological level of each node of an acyclic graph: 0 for roots."""
    return longest(edges, roots(edges))


def components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """node, scc: strongly connected components of two nodes or more, or of one with an edge to itself.

    A component is named by its smallest node. The number of edges is counted first.
    """
    edges = cut(edges.select("src", "dst").distinct())
    if edges.count() <= driver_edges:
        rows = edges.toPandas()
        found = tarjan(list(zip(rows.src.tolist(), rows.dst.tolist(), strict=True)))
        kind = edges.schema["src"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([(n, min(c)) for c in found for n in c], f"node {kind}, scc {kind}")
    return _coloured(edges)


def tarjan(edges: list[tuple]) -> list[list]:
    """Components of the kind above, without recursion."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict = {}
    low: dict = {}
    on, stack, found = set(), [], []
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for child in rest:
                if child not in index:
                    index[child] = low[child] = len(index)
                    stack.append(child)
                    on.add(child)
                    work.append((child, iter(out[child])))
                    break
                if child in on:
                    low[node] = min(low[node], index[child])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        n = stack.pop()
                        on.discard(n)
                        part.append(n)
                        if n == node:
                            break
                    if len(part) > 1 or node in out[node]:
                        found.append(part)
    return found


def _coloured(edges: DataFrame) -> DataFrame:
    """Components by rounds: trim, spread the least node forwards, collect backwards from it."""
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("scc"))
    left, found = cut(edges.filter("src <> dst")), []
    while True:
        while True:  # what has no way in, or no way out, is in no component
            kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            kept = cut(kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            done = kept.count() == left.count()
            left = kept
            if done:
                break
        if left.isEmpty():
            break
        colour = cut(left.select(F.col("src").alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            spread = left.join(colour, left["src"] == colour["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            new = cut(colour.join(spread, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c")))
            changed = not new.exceptAll(colour).isEmpty()
            colour = new
            if not changed:
                break
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), "c"), "dst").filter("cs = c").select("src", "dst", "c")
        back = bfs(reverse(inside), colour.filter("node = c").select("node"))
        part = cut(back.join(colour, "node").select("node", F.col("c").alias("scc")))
        found.append(part)
        left = cut(left.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    big = reduce(DataFrame.unionByName, found) if found else loops.limit(0)
    sized = big.groupBy("scc").agg(F.count("*").alias("n")).filter("n > 1").select("scc")
    big = cut(big.join(sized, "scc", "left_semi").select("node", "scc"))
    return big.unionByName(loops.join(big.select("node"), "node", "left_anti"))


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Acyclic edges between components, and (node, scc) of every node, one without a component standing for itself."""
    parts = components(edges)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    name = cut(nodes.join(parts, "node", "left").select("node", F.coalesce("scc", "node").alias("scc")))
    out = edges.join(name.select(F.col("node").alias("src"), F.col("scc").alias("a")), "src").join(name.select(F.col("node").alias("dst"), F.col("scc").alias("b")), "dst")
    return out.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), name


def impact(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """node, depth: what depends on the removed nodes, with the longest way to them.

    Ways through other removed nodes don't count; a cycle counts as one step.
    """
    back = reverse(edges)
    gone = removed.select("node").distinct()
    into = back.join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    acyclic, name = condensed(into)
    seeds = gone.join(name, "node").select(F.col("scc").alias("node"))
    far = longest(acyclic, seeds).withColumnRenamed("node", "scc")
    return name.join(far, "scc").join(gone, "node", "left_anti").select("node", F.col("depth"))


def module_edges(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """Distinct edges between different modules; packages of no module have none."""
    p = packages.filter(F.col("module").isNotNull())
    a, b = p.select(F.col("package").alias("src"), F.col("module").alias("a")), p.select(F.col("package").alias("dst"), F.col("module").alias("b"))
    return edges.join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def depth_first(root, score: dict, deps: dict, shares: dict | None = None) -> int:
    """Score of what a module pulls in: the i-th dependency's own and transitive score by i + 1, each module once.

    ``shares`` keeps what the dependencies of a module add if all have been seen, from root to root.
    """
    shares = {} if shares is None else shares

    def share(module) -> int:
        if module not in shares:
            shares[module] = sum(score.get(d, 0) // i for i, d in enumerate(deps.get(module, ()), 2))
        return shares[module]

    seen = {root}
    up: list[tuple] = []  # module, its divisor, and what it waits with: rest of dependencies, total so far
    module, by, rest, total = root, 1, enumerate(deps.get(root, ()), 2), share(root)
    while True:
        for i, dep in rest:
            if dep not in seen:
                seen.add(dep)
                up.append((module, by, rest, total))
                module, by, rest, total = dep, i, enumerate(deps.get(dep, ()), 2), share(dep)
                break
        else:
            if not up:
                return total
            own = score.get(module, 0)
            more = (own + total) // by - own // by
            module, by, rest, total = up.pop()
            total += more


def transitive_scores(modules: DataFrame, edges: DataFrame, limit: int = BROADCAST_EDGES) -> DataFrame:
    """module, direct, transitive, effective: dependencies in the order of their names.

    ``modules`` is (module, score). Few edges are sent to every executor; of more, each
    root gathers the edges it can reach.
    """
    edges = cut(edges.select("src", "dst").distinct())
    kind = modules.schema["module"].dataType.simpleString()
    out = f"module {kind}, direct long, transitive long, effective long"

    def result(names, score: dict, deps: dict) -> pd.DataFrame:
        shares: dict = {}
        rows = [(m, score.get(m, 0), depth_first(m, score, deps, shares)) for m in names]
        return pd.DataFrame([(m, d, t, min(100, d + t // 2)) for m, d, t in rows], columns=["module", "direct", "transitive", "effective"])

    if edges.count() <= limit:
        deps: dict = {}
        for e in edges.orderBy("src", "dst").toLocalIterator():
            deps.setdefault(e.src, []).append(e.dst)
        score = {r.module: r.score for r in modules.filter("score <> 0").toLocalIterator()}
        held = edges.sparkSession.sparkContext.broadcast((score, deps))
        # a module is a few bytes and a search of all edges: joined by size, all searches would be one task
        spread = modules.select("module").repartition(4 * edges.sparkSession.sparkContext.defaultParallelism, "module")
        return spread.mapInPandas(lambda it: (result(t.module.tolist(), *held.value) for t in it), out)
    pairs = cut(modules.select(F.col("module").alias("root"), F.col("module").alias("node")))
    frontier = pairs
    found = [pairs]
    while True:
        reached = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(reduce(DataFrame.unionByName, found), ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        found.append(frontier)
    part = reduce(DataFrame.unionByName, found).join(modules.withColumnRenamed("module", "node"), "node", "left")
    part = part.join(edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("deps")), "node", "left")

    def one(t: pd.DataFrame) -> pd.DataFrame:
        score = {n: 0 if pd.isna(s) else int(s) for n, s in zip(t.node, t.score, strict=True)}
        return result([t.root.iloc[0]], score, {n: list(d) for n, d in zip(t.node, t.deps, strict=True) if d is not None})

    return part.groupBy("root").applyInPandas(one, out)


def paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, limit: int | None = None) -> DataFrame:
    """Shortest way from each start to a goal of its key: (key, start, goal, path).

    ``starts`` (key, node), ``goals`` (key, node). Of equally short ways the one with
    the smallest nodes is taken. The start itself is no goal.
    """
    steps = cut(edges.select("src", "dst").distinct().repartition("src"))
    frontier = cut(starts.select("key", F.col("node").alias("start"), "node", F.array("node").alias("path")).distinct())
    aims = cut(goals.select("key", "node").distinct().withColumn("hit", F.lit(True)))
    seen, found, k = [frontier.select("key", "start", "node")], [], 0
    while limit is None or k < limit:
        k += 1
        far = frontier.join(steps, frontier["node"] == steps["src"]).select("key", "start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        far = far.groupBy("key", "start", "node").agg(F.min("path").alias("path")).join(reduce(DataFrame.unionByName, seen), ["key", "start", "node"], "left_anti")
        far = cut(far.join(aims, ["key", "node"], "left"))
        if far.isEmpty():
            break
        hit = cut(far.filter("hit").groupBy("key", "start").agg(F.min(F.struct("path", "node")).alias("m")).select("key", "start", F.col("m.node").alias("goal"), F.col("m.path").alias("path")))
        found.append(hit)
        frontier = far.join(hit, ["key", "start"], "left_anti").select("key", "start", "node", "path")
        seen.append(frontier.select("key", "start", "node"))
    node = edges.schema["src"].dataType.simpleString()
    key = starts.schema["key"].dataType.simpleString()
    return reduce(DataFrame.unionByName, found) if found else edges.sparkSession.createDataFrame([], f"key {key}, start {node}, goal {node}, path array<{node}>")
