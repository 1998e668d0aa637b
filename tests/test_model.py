import datetime
import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import capset, compare, engines, history, policy, score, taint
from plumbline.sinks import reports


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def evidence(spark):
    return spark.createDataFrame([("p", "env", 0.9), ("p", "exec", 0.8), ("p", "exec", 0.7), ("q", "network", 0.6), ("q", "exec", 0.8), ("r", "fs:read", 0.0)], "package string, capability string, confidence double")


@pytest.mark.parametrize(("value", "level"), [(0, "LOW"), (9, "LOW"), (10, "MEDIUM"), (29, "MEDIUM"), (30, "HIGH"), (100, "HIGH")])
def test_levels(spark, value, level):
    assert one(spark, S.risk_level(F.lit(value))) == level


def test_capability_sets(evidence):
    rows = {r.package: (r.caps, r.score) for r in capset.build(evidence).collect()}
    assert rows == {"p": (["env", "exec"], 25), "q": (["exec", "network"], 35), "r": (["fs:read"], 5)}
    conf = {(r.package, r.capability): round(r.confidence, 6) for r in capset.per_capability(evidence).collect()}
    assert conf["p", "exec"] == 0.75
    kept = {(r.package, r.capability) for r in capset.hide_low_confidence(capset.per_capability(evidence), 0.7).collect()}
    assert kept == {("p", "env"), ("p", "exec"), ("q", "exec"), ("r", "fs:read")}


def test_taint(evidence):
    rows = {(r.package, r.source, r.sink): (r.risk, r.confidence) for r in taint.pairs(capset.per_capability(evidence)).collect()}
    assert rows["p", "env", "exec"] == ("HIGH", pytest.approx(0.75))
    assert rows["q", "network", "exec"] == ("MEDIUM", pytest.approx(0.6))


def test_scores(spark):
    sets = spark.createDataFrame([("a", ["exec"], 20), ("b", ["exec"], 20), ("c", ["exec"], 20), ("d", ["x"], 90)], "package string, caps array<string>, score long")
    none = spark.createDataFrame([], "package string, n long, high long, medium long")
    hints = spark.createDataFrame([("a", True), ("b", False)], "package string, reachable boolean")
    cves = spark.createDataFrame([("c", 9), ("d", 1)], "package string, n_cve long")
    got = {r.package: round(r.composite, 6) for r in score.composite(sets, none, hints, cves).collect()}
    assert got == {"a": 26.0, "b": 10.0, "c": 40.0, "d": 100.0}
    eng = spark.createDataFrame([(1.0, 2.0, 3.0)], "diff double, integrity double, topology double")
    final = {r.package: (r.semantic, r.final, r.level) for r in score.final(sets, none, hints, eng).collect()}
    assert final["a"] == (26.0, 32.0, "HIGH") and final["d"][1] == 96.0
    assert {r.package: r.semantic for r in score.final(sets, none, hints, eng, unknown_as_false=True).collect()}["c"] == 10.0


def test_verdict(spark):
    gated = spark.createDataFrame([("b", "HIGH"), ("a", "LOW")], "package string, level string")
    denied = spark.createDataFrame([("b", "exec")], "package string, capability string")
    v = score.verdict(gated, denied).first()
    assert (v.passed, v.n_failing, v.reason) == (False, 2, "risk HIGH in package b")
    v = score.verdict(gated.filter("level = 'LOW'"), denied.limit(0)).first()
    assert (v.passed, v.n_failing, v.reason) == (True, 0, "")


def test_policy_patterns(spark):
    rows = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("c/d",)], "name string")
    left = {r.name for r in policy.excluded(rows, spark.createDataFrame([("a/*",), ("c",)], "pattern string")).collect()}
    assert left == {"ab", "c/d"}
    assert {r.name for r in policy.in_focus(rows, "a", "name").collect()} == {"a", "a/b"}
    for name, pattern, hit in [("x/y", "x/*", True), ("x", "x/*", True), ("xy", "x/*", False), ("x", "x", True)]:
        assert one(spark, S.matches(F.lit(name), F.lit(pattern))) is hit


def test_expiry(spark):
    ex = spark.createDataFrame([("a", None), ("b", ""), ("c", "2020-01-01"), ("d", "2099-01-01"), ("e", "tomorrow")], "package string, expires string").withColumn("taint", F.lit(None).cast("string"))
    now = F.lit("2026-01-01").cast("timestamp")
    assert {r.package for r in policy.active(ex, now).collect()} == {"a", "b", "d"}
    s = policy.stats(ex, now).first()
    assert (s.applied, s.expired, s.unreadable) == (3, 1, 1)


def test_comparisons(spark):
    old = spark.createDataFrame([("p", ["exec"]), ("q", ["env"]), ("s", ["env"])], "package string, caps array<string>")
    new = spark.createDataFrame([("p", ["exec", "network"]), ("r", ["unsafe"]), ("s", ["env"])], "package string, caps array<string>")
    got = {r.package: (r.added, r.removed, r.escalated) for r in compare.capabilities(old, new).collect()}
    assert got == {"p": (["network"], [], True), "q": ([], ["env"], False), "r": (["unsafe"], [], True)}
    a = spark.createDataFrame([("k", 1), ("l", 1)], "key string, v int")
    b = spark.createDataFrame([("k", 2), ("k", 3), ("m", 4)], "key string, v int")
    assert {tuple(r) for r in compare.merged(a, b, "key").collect()} == {("k", 2), ("k", 3), ("l", 1), ("m", 4)}
    x = spark.createDataFrame([("a", 1.0)], "key string, value double")
    assert compare.equal_sets(x, spark.createDataFrame([("a", 1.0005)], "key string, value double"))
    assert not compare.equal_sets(x, spark.createDataFrame([("a", 1.01)], "key string, value double"))


def test_symbols_and_scores(spark):
    old = spark.createDataFrame([("p", "f", "int"), ("p", "g", "int"), ("p", "h", "int")], "package string, symbol string, type string")
    new = spark.createDataFrame([("p", "f", "int"), ("p", "g", "str")], "package string, symbol string, type string")
    assert {(r.symbol, r.change) for r in compare.symbols(old, new).collect()} == {("g", "type changed"), ("h", "removed")}
    pk = spark.createDataFrame([("@s/n",), ("x",)], "package string")
    d = spark.createDataFrame([("@s/n@1.0", 15), ("y@2", 8)], "package string, delta int")
    assert {tuple(r) for r in compare.package_diff_score(pk, d).collect()} == {("@s/n", 15), ("x", 0)}


def snapshots(spark):
    return spark.createDataFrame([(1, "m", 5, "LOW"), (2, "m", 45, "HIGH"), (2, "n", 3, "LOW"), (3, "n", 3, "LOW"), (3, "m", 12, "MEDIUM")], "seq int, module string, score int, level string")


def test_history(spark):
    s = snapshots(spark)
    old, new = history.pair(s, 1, 2)
    assert {(r.module, r.change) for r in compare.snapshots(old, new).collect()} == {("m", "escalated"), ("n", "added")}
    assert {(r.module, r.change) for r in compare.snapshots(*history.pair(s)).collect()} == {("m", "improved"), ("n", "unchanged")}
    assert [(r.seq, r.high, r.delta) for r in history.high_delta(s).orderBy("seq").collect()] == [(1, 0, None), (2, 1, 1), (3, 0, -1)]
    t = {r.module: (r.scores, r.change, r.spark) for r in history.trend(s).collect()}
    assert t["m"] == ([5, 45, 12], 7, "▁▄▁") and t["n"] == ([0, 3, 3], 3, "▁▁▁")
    assert {r.seq for r in history.retained(s, 2).collect()} == {2, 3}
    more = reports.append_snapshot(s, spark.createDataFrame([("m", 1, "LOW")], "module string, score int, level string"), keep=2)
    assert sorted({r.seq for r in more.collect()}) == [3, 4]


def test_topology(spark):
    m = spark.createDataFrame([(120, 3, 1, 65.0, 9, 11, 12)], "direct long, total long, max_depth long, deep_pct double, skew long, duplicates long, churn long")
    points = {r.signal: r.points for r in engines.topology_signals(m).collect()}
    assert points == {"direct": 8, "deep_pct": 5, "skew": 3, "duplicates": 3, "churn": 4}
    assert engines.capped(engines.topology_signals(m)).first().score == 20
    low = m.select(*[F.lit(-1).cast("long").alias(c) if c == "churn" else F.lit(0).alias(c) for c in m.columns])
    assert engines.capped(engines.topology_signals(low)).first().score == 0


def test_integrity(spark):
    rows = [("p", f"m{i}", None, "https://r") for i in range(7)] + [("p", "ok", "sha", "https://r"), ("p", "loc", None, "file:x"), ("p", "git", None, "git+ssh://x")]
    got = engines.npm_integrity(spark.createDataFrame(rows, "project string, package string, integrity string, resolved string"))
    points = {}
    for r in got.collect():
        points[r.type] = points.get(r.type, 0) + r.points
    assert points == {"missing_integrity": 10, "path_dep": 5, "git_dep": 8}
    mods = lambda *x: spark.createDataFrame([(i,) for i in x], "package string")
    rep = spark.createDataFrame([("a", "../x"), ("b", "github.com/f/b"), ("c", "example.org/c")], "package string, target string")
    assert {(r.package, r.type, r.points) for r in engines.go_integrity(mods("a", "z"), mods("a"), rep).collect()} == {("z", "missing_checksum", 5), ("a", "local_replace", 6), ("b", "git_replace", 8)}


def test_health_and_licences(spark):
    today = datetime.date(2026, 1, 1)
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "module string")
    repos = spark.createDataFrame([("a", True, datetime.date(2020, 1, 1)), ("b", False, datetime.date(2025, 12, 1))], "module string, archived boolean, pushed date")
    rel = spark.createDataFrame([("b",)] * 6, "module string")
    vul = spark.createDataFrame([("c",), ("c",)], "module string")
    got = {r.module: r.score for r in engines.health(m, repos, rel, vul, F.lit(today)).collect()}
    assert got == {"a": 20, "b": 100, "c": 40}
    lic = spark.createDataFrame([("a", "MIT"), ("b", "CCDL-1.0")], "module string, license string")
    assert {(r.module, r.risky) for r in engines.license_risk(m, lic).collect()} == {("a", False), ("b", True), ("c", True)}


def test_scalars(spark):
    assert one(spark, S.owner_repo(F.lit("github.com/o/r/v2"))) == "o/r"
    assert one(spark, S.owner_repo(F.lit("x.y/o/r"))) is None
    assert one(spark, S.split_at(F.lit("@s/n@1.2"))[0]) == "@s/n" and one(spark, S.split_at(F.lit("@s/n"))[1]) == ""
    assert one(spark, S.bare_module(F.lit("@s/n/x"))) == "@s/n" and one(spark, S.bare_module(F.lit("a/b"))) == "a"
    assert one(spark, S.prefixes(F.lit("a::b::c"), "::")) == ["a::b::c", "a::b", "a"]
    assert one(spark, S.clojure_variants(F.lit("[a.b]"))) == ["a.b", "a", "a/b"]
    assert one(spark, S.caps_level(S.inferred_caps(F.lit("x/http"), "go"))) == "MEDIUM"
    assert one(spark, S.purl(F.lit("a/b"), F.lit("v1"))) == "pkg:golang/a/b@v1"
    assert one(spark, S.duration_text(F.lit(1500))) == "1.50s"


def test_reports(spark, evidence):
    caps = capset.build(evidence).withColumn("level", S.risk_level(F.col("score")))
    health = spark.createDataFrame([("m", 20), ("n", 90)], "module string, score int")
    doc = json.loads(reports.sarif_document(reports.sarif(caps, health)).first().value)
    assert [(r["ruleId"], r["level"]) for r in doc["runs"][0]["results"]] == [("high-risk-capability", "error"), ("low-health", "warning")]
    modules = spark.createDataFrame([("M", "v1", False), ("main", "", True)], "module string, version string, is_main boolean")
    packages = spark.createDataFrame([("p", "M", False), ("q", "M", False), ("r", "main", True)], "package string, module string, is_main boolean")
    bom = json.loads(reports.cyclonedx(reports.components(modules.drop("is_main"), packages, capset.build(evidence), health)).first().value)
    assert len(bom["components"]) == 1 and bom["components"][0]["properties"][0]["value"] == "env,exec,network" and bom["components"][0]["properties"][1]["value"] == "HIGH"
    edges = spark.createDataFrame([("M", "a"), ("a", "a"), ("a", "b<c")], "src string, dst string")
    c1 = reports.checksum(modules, edges).first().checksum
    assert len(c1) == 16 and c1 == reports.checksum(modules, edges.repartition(3)).first().checksum
    assert c1 == reports.checksum(modules.filter("NOT is_main"), edges).first().checksum
    more = modules.unionByName(spark.createDataFrame([("N", "v1", False)], modules.schema))
    assert c1 != reports.checksum(more, edges).first().checksum
    assert len(reports.checksum(modules.limit(0), edges.limit(0)).first().checksum) == 16
    levels = spark.createDataFrame([("M", "HIGH"), ("a", "HIGH"), ("b<c", "LOW")], "node string, level string")
    nodes, inner = reports.subgraph(edges, levels, "high")
    assert {tuple(r) for r in inner.collect()} == {("M", "a")}
    lines = [r.value for r in reports.dot(nodes, inner).collect()]
    assert lines[0] == "digraph deps {" and lines[-1] == "}" and '  "M" -> "a";' in lines
    assert json.loads(reports.node_link(nodes, inner).first().value)["links"] == [{"source": "M", "target": "a"}]
    assert "<li class=HIGH>M</li>" in reports.html(nodes, inner).first().value
    change = spark.createDataFrame([("x", "added", None, "1")], "package string, change string, old_version string, new_version string")
    assert [r.value for r in reports.markdown(change).collect()][-1] == "| added | x | - | 1 |"
    assert json.loads(reports.json_document(change, "changes", ["package"]).first().value)["changes"][0]["old_version"] is None
    assert json.loads(reports.json_rows(change).first().value)["package"] == "x"
    assert reports.table(change, {"package": 3, "change": 4}).first().value == "x    add…"
