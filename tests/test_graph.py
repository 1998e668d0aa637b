import random

import pytest

from plumbline.operators import graph, interproc


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def seeds(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node long")


def random_edges(seed, n=14, m=24, dag=False):
    r = random.Random(seed)
    out = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
    return sorted((min(a, b), max(a, b)) for a, b in out if a != b) if dag else sorted(out)


def test_bfs(spark):
    e = [(1, 2), (2, 3), (1, 3), (3, 1), (3, 9), (7, 8)]
    assert {tuple(r) for r in graph.bfs(frame(spark, e), seeds(spark, 1)).collect()} == {(1, 0), (2, 1), (3, 1), (9, 2)}
    assert {r.node for r in graph.bfs(frame(spark, e), seeds(spark, 1), limit=1).collect()} == {1, 2, 3}
    assert {tuple(r) for r in graph.bfs(frame(spark, e), seeds(spark, 42), 1).collect()} == {(42, 1)}
    assert graph.bfs(frame(spark, []), seeds(spark)).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    e = random_edges(seed)
    reach = {a: {b for x, b in e if x == a} for a in range(14)}
    for _ in range(14):
        for a in reach:
            reach[a] |= {c for b in reach[a] for c in reach[b]}
    want = {(a, min(b for b in reach[a] if a in reach[b])) for a in reach if a in reach[a]}
    df = frame(spark, e)
    assert {tuple(r) for r in graph.components(df).collect()} == want
    assert {tuple(r) for r in graph.components(df, driver_edges=0).collect()} == want


def test_longest_and_levels(spark):
    e = frame(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (5, 4)])
    assert {tuple(r) for r in graph.longest(e, seeds(spark, 1)).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {tuple(r) for r in graph.levels(e).collect()} == {(1, 0), (5, 0), (2, 1), (3, 2), (4, 3)}


def test_impact(spark):
    e = frame(spark, [(1, 2), (2, 3), (1, 3), (9, 8)])
    assert {tuple(r) for r in graph.impact(e, seeds(spark, 3)).collect()} == {(2, 1), (1, 2)}
    assert graph.impact(e, seeds(spark, 77)).isEmpty()
    cyclic = frame(spark, [(1, 2), (2, 1), (2, 3)])
    assert {tuple(r) for r in graph.impact(cyclic, seeds(spark, 3)).collect()} == {(1, 1), (2, 1)}


def recursive(root, score, deps, seen):
    if root in seen:
        return 0
    seen.add(root)
    return sum((score.get(d, 0) + recursive(d, score, deps, seen)) // (i + 2) for i, d in enumerate(deps.get(root, [])))


@pytest.mark.parametrize("seed", range(3))
def test_transitive_scores(spark, seed):
    e = [x for x in random_edges(seed, 10, 22) if x[0] != x[1]]
    score = {i: (i * 37) % 90 for i in range(10)}
    deps = {}
    for a, b in e:
        deps.setdefault(a, []).append(b)
    modules = spark.createDataFrame(list(score.items()), "module long, score long")
    want = {(m, s, recursive(m, score, deps, set())) for m, s in score.items()}
    for limit in (100, 0):
        got = {(r.module, r.direct, r.transitive) for r in graph.transitive_scores(modules, frame(spark, e), limit).collect()}
        assert got == want


def test_degrees_and_reverse(spark):
    e = frame(spark, [(1, 2), (1, 2), (3, 3)])
    assert {tuple(r) for r in graph.degrees(e).collect()} == {(1, 2, 0), (2, 0, 2), (3, 1, 1)}
    assert {tuple(r) for r in graph.reverse(e).collect()} == {(2, 1), (3, 3)}


def call_graph(spark, calls, direct, names=None):
    fns = sorted({x for c in calls for x in c} | {f for f, *_ in direct})
    functions = spark.createDataFrame([(f, "p" if f < "m" else "q", (names or {}).get(f, f)) for f in fns], "fn string, package string, name string")
    c = spark.createDataFrame(calls, "caller string, callee string")
    d = spark.createDataFrame(direct, "fn string, capability string, confidence double")
    return functions, c, d


def solve(spark, calls, direct):
    functions, c, d = call_graph(spark, calls, direct)
    nodes, edges = interproc.contexts(functions, c)
    caps, states = interproc.summaries(nodes, edges, d)
    return functions, nodes, edges, caps, states


def test_chain_decays_and_ends(spark):
    calls = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]
    *_, caps, states = solve(spark, calls, [("e", "exec", 0.9)])
    state = {r.node: (r.depth, round(r.confidence, 3)) for r in states.collect()}
    assert state == {"e@d": (0, 1.0), "d@c": (1, 0.7), "c@b": (2, 0.385), "b@a": (3, 0.154), "a@<entry>": (0, 1.0)}
    assert {r.node for r in caps.filter("kind = 'transitive'").collect()} == {"d@c", "c@b", "b@a"}


def test_cycle_is_one_summary(spark):
    functions, nodes, edges, caps, states = solve(spark, [("main", "a"), ("a", "b"), ("b", "a")], [("a", "network", 0.9)])
    rows = {(r.node, r.kind, r.capability) for r in caps.collect()}
    assert {("a@b", "effect", "network"), ("b@a", "effect", "network")} <= rows
    assert {r.node: r.depth for r in states.collect()}["a@b"] == 0
    assert ("main@<entry>", "transitive", "network") in rows


def test_contexts(spark):
    functions, c, d = call_graph(spark, [("a", "c"), ("b", "c"), ("x", "x")], [])
    nodes, edges = interproc.contexts(functions, c)
    assert {r.node for r in nodes.collect()} == {"a@<entry>", "b@<entry>", "c@a", "c@b"}
    assert {tuple(r) for r in edges.collect()} == {("a@<entry>", "c@a"), ("b@<entry>", "c@b")}
    merged, _ = interproc.contexts(functions, c, k=0)
    assert {r.node for r in merged.collect()} == {"a@<entry>", "b@<entry>", "c@<entry>"}
    loops, c, d = call_graph(spark, [("a", "b"), ("b", "a")], [])
    assert {r.fn for r in interproc.entries(loops, c).collect()} == {"a", "b"}


def test_taint_through_calls(spark):
    direct = [("a", "network", 0.9), ("c", "exec", 0.75), ("z", "env", 0.9), ("z", "exec", 0.9)]
    functions, nodes, edges, caps, states = solve(spark, [("a", "b"), ("b", "c"), ("z", "c")], direct)
    found = interproc.findings(nodes, caps, states, functions)
    rows = {(r.package, r.source, r.sink): r for r in interproc.traced(found, edges, caps).collect()}
    far = rows["p", "network", "exec"]
    assert list(far.path) == ["a@<entry>", "b@a", "c@b"] and not far.uncertain
    assert far.risk == "MEDIUM" and abs(far.confidence - 0.385) < 1e-9
    near = rows["q", "env", "exec"]
    assert list(near.path) == [] and not near.uncertain and near.risk == "HIGH"
    assert {r.package for r in interproc.hints(nodes, caps, functions).collect()} == {"p", "q"}


def synchronous(nodes, edges, effects, parts):
    """Rounds in plain Python, to hold the DataFrame loop against."""
    hop = (1.0, 0.7, 0.55, 0.4)
    state = {n: (0, 1.0, {}) for n in nodes}
    while True:
        new = {}
        for n in nodes:
            if n in parts:
                new[n] = (0, 1.0, {})
                continue
            depth, conf, got = 0, 1.0, {}
            for a, b in edges:
                d = state[b][0] + 1
                if a == n and d <= 3:
                    for cap in [*effects.get(b, {}), *state[b][2]]:
                        c = state[b][1] * hop[d]
                        got.setdefault(cap, []).append(c)
                        depth, conf = max(depth, d), min(conf, c)
            new[n] = (depth, conf, {k: sum(v) / len(v) for k, v in got.items()})
        if new == state:
            return state
        state = new


@pytest.mark.parametrize("seed", range(3))
def test_fixpoint_against_plain_rounds(spark, seed):
    r = random.Random(seed)
    calls = sorted({(f"f{r.randrange(9)}", f"f{r.randrange(9)}") for _ in range(13)})
    direct = [(f"f{i}", c, 0.75) for i in range(9) for c in r.sample(["exec", "env", "network"], r.randrange(2))]
    functions, nodes, edges, caps, states = solve(spark, calls, direct or [("f0", "exec", 0.75)])
    fn = {n.node: n.fn for n in nodes.collect()}
    e = [tuple(x) for x in edges.collect()]
    effects = {}
    for n, f in fn.items():
        for g, c, _ in direct:
            if g == f:
                effects.setdefault(n, {})[c] = 0.75
    parts = {n: c for c in graph.tarjan(e) for n in c}
    for n, c in parts.items():
        for m in c:
            for g, cap, _ in direct:
                if g == fn[m]:
                    effects.setdefault(n, {})[cap] = 0.75
    want = synchronous(list(fn), e, effects, parts)
    got = {x.node: (x.depth, round(x.confidence, 9)) for x in states.collect()}
    assert got == {n: (d, round(c, 9)) for n, (d, c, _) in want.items()}
    carried = {(x.node, x.capability): round(x.confidence, 9) for x in caps.filter("kind = 'transitive'").collect()}
    assert carried == {(n, k): round(v, 9) for n, (_, _, t) in want.items() for k, v in t.items()}


def test_within_package(spark):
    functions, c, d = call_graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "zz")], [("e", "exec", 1.0), ("zz", "env", 1.0)])
    got = {(r.fn, r.capability, r.hops, round(r.confidence, 2)) for r in interproc.within_package(functions, c, d).collect()}
    assert got == {("d", "exec", 1, 0.7), ("c", "exec", 2, 0.55), ("b", "exec", 3, 0.4)}
