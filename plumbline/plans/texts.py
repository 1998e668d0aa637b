"""Queries of sources and text detection: files are written from the driver's tables, so that SQL over the tables says what reading them must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import detect
from ..sources import files as inputs
from ..sources import manifests
from .registry import query



def _keys() -> tuple[Column, Column]:
    """What lines and projects are made of."""
    return F.col("c_custkey"), F.col("c_nationkey")


def _s(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("string")


def _cat(*parts) -> Column:
    return F.concat(*[_s(p) for p in parts])


def _files(rows: DataFrame, path, line: Column, head: str = "", foot: str = "", sep: str = "\n") -> DataFrame:
    """A file per project, of a line per row in the order of customers."""
    K, N = _keys()
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(K.alias("o"), line.alias("t")))), lambda x: x["t"]), sep)
    path = path if isinstance(path, Column) else F.lit(path)
    return rows.withColumn("__p", path).groupBy(_s(N).alias("project"), F.col("__p").alias("path")).agg(F.concat(F.lit(head), body, F.lit(foot)).alias("content"))


def _packages(lang: str, files: DataFrame) -> DataFrame:
    return manifests.packages(files, [lang]).select("project", "name", "version", F.array_join("dependencies", ",").alias("dependencies"), "direct")


# ---- go files --------------------------------------------------------------------


@query("src_go_mod", """SELECT CAST(c_nationkey AS STRING) AS project, 'require' AS kind, concat('x.y/c', CAST(c_custkey AS STRING)) AS module, concat('v1.', CAST(c_custkey % 9 AS STRING), '.0') AS version, c_custkey % 4 = 0 AS indirect, '' AS target FROM customer
  UNION ALL SELECT CAST(c_nationkey AS STRING), 'replace', concat('x.y/c', CAST(c_custkey AS STRING)), '', false, concat('../c', CAST(c_custkey AS STRING)) FROM customer WHERE c_custkey % 5 = 0""")
def _(get, spark):
    K, _ = _keys()
    c = get("customer")
    need = _files(c, "go.mod", _cat("\tx.y/c", K, " v1.", K % 9, ".0", F.when(K % 4 == 0, " // indirect").otherwise("")), "module m\n\nrequire (\n", "\n)\n")
    swap = _files(c.filter("c_custkey % 5 = 0"), "go.mod", _cat("\tx.y/c", K, " => ../c", K), "replace (\n", "\n)\n").withColumnRenamed("content", "more").drop("path")
    both = need.join(swap, "project", "left").select("project", "path", F.concat("content", F.coalesce("more", F.lit(""))).alias("content"))
    return inputs.go_mod(both).select("project", "kind", "module", "version", "indirect", "target")


@query("src_go_requires", """SELECT CAST(c_nationkey AS STRING) AS project, concat('x.y/c', CAST(c_custkey % 50 AS STRING)) AS package, concat('v1.', CAST(max(c_custkey) AS STRING)) AS version FROM customer GROUP BY c_nationkey, c_custkey % 50""")
def _(get, spark):
    K, _ = _keys()
    return inputs.go_requires(_files(get("customer"), "go.mod", _cat("require x.y/c", K % 50, " v1.", K)))


@query("src_go_sum", "SELECT DISTINCT CAST(c_nationkey AS STRING) AS project, concat('x.y/c', CAST(c_custkey % 200 AS STRING)) AS package FROM customer WHERE c_custkey % 3 <> 0")
def _(get, spark):
    K, _ = _keys()
    return inputs.go_sum(_files(get("customer"), "sub/go.sum", _cat("x.y/c", K % 200, " v1.0.0", F.when(K % 3 != 0, " h1:abc=").otherwise(""))))


@query("src_go_list", """SELECT concat('h/p', CAST(c_custkey AS STRING)) AS package, concat('h/m', CAST(c_nationkey AS STRING)) AS module, c_custkey % 10 = 0 AS is_main, concat('h/p', CAST(c_custkey + 1 AS STRING)) AS dst FROM customer WHERE c_custkey % 7 <> 0""")
def _(get, spark):
    K, N = _keys()
    value = F.to_json(F.struct(_cat("h/p", K).alias("ImportPath"), (K % 7 == 0).alias("Standard"), F.array(_cat("h/p", K + 1)).alias("Imports"), F.struct(_cat("h/m", N).alias("Path"), (K % 10 == 0).alias("Main")).alias("Module")))
    packages, edges = inputs.go_list(get("customer").select(value.alias("value")))
    return packages.select("package", "module", "is_main").join(edges.select(F.col("src").alias("package"), "dst"), "package")


@query("src_mod_graph", "SELECT DISTINCT m AS module FROM (SELECT concat('h/m', CAST(c_custkey % 400 AS STRING)) AS m FROM customer UNION ALL SELECT concat('h/m', CAST(c_custkey % 300 + 1 AS STRING)) FROM customer) x WHERE m NOT IN (SELECT concat('h/m', CAST(c_nationkey AS STRING)) FROM customer)")
def _(get, spark):
    K, N = _keys()
    c = get("customer")
    return inputs.mod_graph(c.select(_cat("h/m", K % 400, "@v1 h/m", K % 300 + 1, "@v2").alias("value")), c.select(_cat("h/m", N).alias("module")).distinct())


# ---- lockfiles and manifests -------------------------------------------------------


@query("src_npm_lock", """SELECT CAST(c_nationkey AS STRING) AS project, concat('p', CAST(c_custkey AS STRING)) AS name, concat('1.', CAST(c_custkey AS STRING)) AS version, CASE WHEN c_custkey % 4 > 0 THEN 'sha512-x' END AS integrity, concat('p', CAST(c_custkey + 1 AS STRING)) AS dependencies FROM customer WHERE c_custkey % 11 <> 0""")
def _(get, spark):
    K, _ = _keys()
    entry = _cat('"node_modules/p', K, '":{"version":"1.', K, '"', F.when(K % 4 > 0, ',"integrity":"sha512-x"').otherwise(""), F.when(K % 11 == 0, ',"link":true').otherwise(""), ',"dependencies":{"p', K + 1, '":"*"}}')
    rows = manifests.npm_lock(_files(get("customer"), "package-lock.json", entry, '{"lockfileVersion":3,"packages":{"":{"name":"root"},', "}}", ","))
    return rows.select("project", "name", "version", "integrity", F.array_join("dependencies", ",").alias("dependencies"))


@query("src_yarn_sources", """SELECT CAST(c_nationkey AS STRING) AS project, concat('p', CAST(c_custkey AS STRING)) AS package, '-' AS integrity, concat('https://r/p', CAST(c_custkey AS STRING), '.tgz') AS resolved FROM customer""")
def _(get, spark):
    K, _ = _keys()
    return manifests.yarn_sources(_files(get("customer"), "yarn.lock", _cat("p", K, '@^1.0.0:\n  version "1.', K, '"\n  resolved "https://r/p', K, '.tgz"\n')))


@query("src_yarn_lock", """SELECT CAST(c_nationkey AS STRING) AS project, concat('p', CAST(c_custkey AS STRING)) AS name, concat('1.', CAST(c_custkey AS STRING)) AS version, concat('p', CAST(c_custkey + 1 AS STRING)) AS dependencies, false AS direct FROM customer""")
def _(get, spark):
    K, _ = _keys()
    return _packages("node", _files(get("customer"), "yarn.lock", _cat("p", K, '@^1.0.0:\n  version "1.', K, '"\n  dependencies:\n    p', K + 1, ' "^1"\n')))


@query("src_pnpm_sources", """SELECT CAST(c_nationkey AS STRING) AS project, concat('p', CAST(c_custkey AS STRING)) AS package, '-' AS integrity, concat('^1.', CAST(c_custkey AS STRING)) AS resolved FROM customer""")
def _(get, spark):
    K, _ = _keys()
    return manifests.pnpm_sources(_files(get("customer"), "pnpm-lock.yaml", _cat("      p", K, ":\n        specifier: ^1.", K, "\n        version: 1.", K), "importers:\n\n  .:\n    dependencies:\n", "\n\npackages:\n"))


@query("src_composer_lock", """SELECT CAST(c_nationkey AS STRING) AS project, concat('v/c', CAST(c_custkey AS STRING)) AS name, concat('1.', CAST(c_custkey AS STRING)) AS version, false AS direct FROM customer""")
def _(get, spark):
    K, _ = _keys()
    return _packages("php", _files(get("customer"), "composer.lock", _cat('{"name":"v/c', K, '","version":"1.', K, '","require":{"v/c', K + 1, '":"*"}}'), '{"packages":[', "]}", ",")).drop("dependencies")


@query("src_requirements", """SELECT CAST(c_nationkey AS STRING) AS project, concat('p-', CAST(c_custkey AS STRING)) AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('1.', CAST(c_custkey AS STRING)) END AS version, '' AS dependencies, true AS direct FROM customer""")
def _(get, spark):
    K, _ = _keys()
    return _packages("python", _files(get("customer"), "requirements.txt", _cat("p-", K, F.when(K % 3 == 0, ">=2").otherwise(_cat("==1.", K)), "  # why"), "# all\n-r other.txt\n"))


@query("src_cargo_lock", """SELECT CAST(c_nationkey AS STRING) AS project, concat('c', CAST(c_custkey AS STRING)) AS name, concat('0.', CAST(c_custkey AS STRING), '.1') AS version, concat('c', CAST(c_custkey + 1 AS STRING)) AS dependencies, c_custkey % 6 = 0 AS direct FROM customer""")
def _(get, spark):
    K, _ = _keys()
    c = get("customer")
    lock = _files(c, "Cargo.lock", _cat('[[package]]\nname = "c', K, '"\nversion = "0.', K, '.1"\ndependencies = [\n "c', K + 1, '",\n]\n'))
    return _packages("rust", lock.unionByName(_files(c.filter("c_custkey % 6 = 0"), "Cargo.toml", _cat("c", K, ' = "0.1"'), '[package]\nname = "me"\n\n[dependencies]\n')))


@query("src_gemfile_lock", """SELECT CAST(c_nationkey AS STRING) AS project, concat('g', CAST(c_custkey AS STRING)) AS name, concat('1.', CAST(c_custkey AS STRING)) AS version, concat('g', CAST(c_custkey + 1 AS STRING)) AS dependencies FROM customer""")
def _(get, spark):
    K, _ = _keys()
    return _packages("ruby", _files(get("customer"), "Gemfile.lock", _cat("    g", K, " (1.", K, ")\n      g", K + 1, " (~> 1)"), "GEM\n  remote: https://r/\n  specs:\n", "\n\nPLATFORMS\n  ruby\n")).drop("direct")


@query("src_pom", """SELECT CAST(c_nationkey AS STRING) AS project, concat('g.h:a', CAST(c_custkey AS STRING)) AS name, concat('1.', CAST(c_custkey AS STRING)) AS version, '' AS dependencies, true AS direct FROM customer""")
def _(get, spark):
    K, _ = _keys()
    return _packages("java", _files(get("customer"), "pom.xml", _cat("<dependency>\n<groupId>g.h</groupId>\n<artifactId> a", K, " </artifactId><version>1.", K, "</version></dependency>"), "<project><dependencies>", "</dependencies></project>"))


@query("src_first_seen", """SELECT CAST(c_nationkey AS STRING) AS project, concat('p', CAST(c_custkey % 40 AS STRING)) AS name, concat('1.', CAST(min(c_custkey) AS STRING)) AS version FROM customer GROUP BY c_nationkey, c_custkey % 40""")
def _(get, spark):
    K, _ = _keys()
    return manifests.first_seen(manifests.packages(_files(get("customer"), "requirements.txt", _cat("p", K % 40, "==1.", K)), ["python"])).select("project", "name", "version")


@query("src_detect", """SELECT CAST(c_nationkey AS STRING) AS project, CASE c_nationkey % 4 WHEN 0 THEN 'multi' WHEN 1 THEN 'node' WHEN 2 THEN 'rust' ELSE 'go' END AS lang FROM customer GROUP BY c_nationkey""")
def _(get, spark):
    _, N = _keys()
    c = get("customer").select("c_nationkey").distinct()
    names = F.when(N % 4 == 0, F.array(F.lit("go.mod"), F.lit("package.json"))).when(N % 4 == 1, F.array(F.lit("a/yarn.lock"), F.lit("Cargo.lock"))).when(N % 4 == 2, F.array(F.lit("Cargo.toml"))).otherwise(F.array(F.lit("readme")))
    return manifests.detect(c.select(_s(N).alias("project"), F.explode(names).alias("path")))


@query("src_workspace_members", """SELECT concat(CAST(c_nationkey AS STRING), '/m', CAST(c_custkey % 7 AS STRING)) AS project, concat('f', CAST(c_custkey AS STRING), '.go') AS path FROM customer WHERE c_custkey % 7 < 4""")
def _(get, spark):
    K, N = _keys()
    c = get("customer")
    own = c.select(_s(N).alias("project"), _cat("m", K % 7, "/f", K, ".go").alias("path"), F.lit("").alias("content"))
    work = c.select("c_nationkey").distinct().select(_s(N).alias("project"), F.lit("go.work").alias("path"), F.lit("go 1.22\n\nuse (\n\t./m0\n\t./m1\n\t./m2/\n\t./m3\n)\n").alias("content"))
    return manifests.members(own.unionByName(work)).select("project", "path")


@query("src_diff_versions", """SELECT CAST(c_nationkey AS STRING) AS project, concat('x.y/c', CAST(c_custkey % 60 AS STRING)) AS package, 'v1.' || CAST(max(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END) AS STRING) || '.0' AS old_version,
  'v2.' || CAST(max(CASE WHEN c_custkey % 2 = 1 THEN c_custkey END) AS STRING) || '.0' AS new_version FROM customer GROUP BY c_nationkey, c_custkey % 60""")
def _(get, spark):
    K, _ = _keys()
    text = _files(get("customer"), "diff", F.when(K % 2 == 0, _cat("-\tx.y/c", K % 60, " v1.", K, ".0")).otherwise(_cat("+\tx.y/c", K % 60, " v2.", K, ".0")), "--- a/go.mod\n+++ b/go.mod\n@@ -1 +1 @@\n")
    before, after = inputs.diff_versions(text.drop("path"), "go")
    out = before.withColumnRenamed("version", "old_version").join(after.withColumnRenamed("version", "new_version"), ["project", "package"], "full_outer")
    return out.select("project", "package", "old_version", "new_version")


@query("src_owners", """SELECT CAST(c_nationkey AS STRING) AS project, concat('f', CAST(c_custkey AS STRING)) AS file, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('p', CAST(c_custkey AS STRING)) WHEN 2 THEN '@s/q' ELSE 'h/a/b' END AS module FROM customer""")
def _(get, spark):
    K, N = _keys()
    c = get("customer")
    path = F.when(K % 4 == 0, _cat("src/f", K, ".js")).when(K % 4 == 1, _cat("node_modules/p", K, "/dist/f", K, ".js")).when(K % 4 == 2, _cat("node_modules/p/node_modules/@s/q/f", K, ".js")).otherwise(_cat("vendor/h/a/b/c/f", K, ".go"))
    src = inputs.sources(c.select(_s(N).alias("project"), path.alias("path"), F.lit("").alias("content")))
    names = c.select(_s(N).alias("project"), F.explode(F.array(F.lit("h/a"), F.lit("h/a/b"))).alias("name")).distinct()
    return inputs.owners(src, names).select("project", F.regexp_extract("path", r"(f\d+)\.\w+$", 1).alias("file"), "module")


# ---- text detection ------------------------------------------------------------------


def _catalog(spark, *rows) -> DataFrame:
    return spark.createDataFrame(rows, "lang string, kind string, key string, capability string")


def _code(get, lang: str, suffix: str, text: Column) -> DataFrame:
    K, N = _keys()
    return get("customer").select(F.lit(lang).alias("lang"), _s(N).alias("project"), _cat("d", K % 5, "/f", K, suffix).alias("path"), text.alias("content"))


@query("text_imports", """SELECT CAST(c_nationkey AS STRING) AS project, c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'os' ELSE 'http' END AS key, CASE WHEN c_custkey % 3 = 0 THEN 'env' ELSE 'network' END AS capability, 2 AS line FROM customer WHERE c_custkey % 3 < 2
  UNION ALL SELECT CAST(c_nationkey AS STRING), c_custkey, 'http.client', 'exec', 2 FROM customer WHERE c_custkey % 3 = 1""")
def _(get, spark):
    K, _ = _keys()
    text = _cat("# x\n", F.when(K % 3 == 0, "import os").when(K % 3 == 1, "from http.client import get").otherwise("import nothing"))
    cat = _catalog(spark, ("python", "import", "os", "env"), ("python", "import", "http", "network"), ("python", "import", "http.client", "exec"))
    rows = detect.match_imports(detect.imports(detect.scan(_code(get, "python", ".py", text))), cat)
    return rows.select("project", F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("k"), "key", "capability", "line")


@query("text_call_sites", """SELECT c_custkey AS k, 'run(' AS key, 'exec' AS capability FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'fetch', 'network' FROM customer WHERE c_custkey % 6 = 0""")
def _(get, spark):
    K, _ = _keys()
    text = _cat("x = 1\n", F.when(K % 4 == 0, "sub.run(1) ").otherwise(""), F.when(K % 6 == 0, "fetch()").otherwise(""))
    cat = _catalog(spark, ("ruby", "call", "run(", "exec"), ("ruby", "call", "fetch", "network"), ("lua", "call", "x", "fs:read"))
    rows = detect.match_calls(detect.scan(_code(get, "ruby", ".rb", text)), cat)
    return rows.select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("k"), "key", "capability")


@query("text_js_calls", """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'cp.exec' WHEN 1 THEN 'spawn' ELSE 'get' END AS key, CASE WHEN c_custkey % 4 = 2 THEN 'network' ELSE 'exec' END AS capability, CAST(CASE WHEN c_custkey % 4 = 1 THEN 0.85 ELSE 0.80 END AS DOUBLE) AS confidence FROM customer WHERE c_custkey % 4 < 3""")
def _(get, spark):
    K, _ = _keys()
    text = F.when(K % 4 == 0, "const cp = require('child_process');\ncp.exec('x');").when(K % 4 == 1, "import { spawn } from 'node:child_process';\nspawn('x');").when(K % 4 == 2, "require('http').get('x');").otherwise("const a = require('b');\na.c();")
    cat = _catalog(spark, ("node", "import", "child_process", "exec"), ("node", "import", "http", "network"))
    lines = detect.scan(_code(get, "node", ".js", text))
    rows = detect.bound_calls(lines, detect.bindings(lines), cat)
    return rows.select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("k"), "key", "capability", "confidence")


@query("text_go_calls", """SELECT c_custkey AS k, 'exec.Command' AS key, 'exec' AS capability FROM customer WHERE c_custkey % 3 < 2""")
def _(get, spark):
    K, _ = _keys()
    text = F.when(K % 3 == 0, 'package a\nimport "os/exec"\nfunc f() { exec.Command("x") }').when(K % 3 == 1, 'package a\nimport (\n\tsh "os/exec"\n)\nfunc f() { sh.Command("x") }').otherwise('package a\nfunc f() { exec.Command("x") }')
    rows = detect.go_calls(detect.scan(_code(get, "go", ".go", text)), _catalog(spark, ("go", "call", "exec.Command", "exec")))
    return rows.select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("k"), "key", "capability")


@query("text_functions", """SELECT c_custkey AS k, concat('a', CAST(c_custkey AS STRING)) AS name, 1 AS first, 3 AS last, 'exec' AS caps, concat('b', CAST(c_custkey AS STRING), ',run') AS calls FROM customer
  UNION ALL SELECT c_custkey, concat('b', CAST(c_custkey AS STRING)), 5, 6, '', '' FROM customer""")
def _(get, spark):
    K, _ = _keys()
    text = _cat("def a", K, "(x):\n    b", K, "(x)\n    sh.run('(')\n\ndef b", K, "(y):\n    return y\n\nz = 1\n")
    rows = detect.functions(_code(get, "python", ".py", text), _catalog(spark, ("python", "call", "sh.run", "exec")), drop_header_self_calls=True)
    return rows.select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("k"), "name", "first", "last", F.array_join("caps", ",").alias("caps"), F.array_join("calls", ",").alias("calls"))


@query("text_brace_functions", """SELECT c_custkey AS k, concat('a', CAST(c_custkey AS STRING)) AS name, 2 AS first, 5 AS last, concat('b', CAST(c_custkey AS STRING)) AS calls FROM customer""")
def _(get, spark):
    K, _ = _keys()
    text = _cat("package m\nfunc a", K, "(x int) int {\n\ts := \"}{\" // }\n\treturn b", K, "(s)\n}\n\nvar q = 1\n")
    rows = detect.functions(_code(get, "go", ".go", text), _catalog(spark, ("go", "call", "none", "exec")), drop_header_self_calls=True)
    return rows.select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("k"), "name", "first", "last", F.array_join("calls", ",").alias("calls"))


@query("text_ir", """SELECT concat(CAST(c_nationkey AS STRING), '/d', CAST(c_custkey % 5 AS STRING), '.go') AS fn, CASE WHEN max_by(c_custkey, concat('f', CAST(c_custkey AS STRING))) % 2 = 0 THEN 'exec' END AS capability FROM customer GROUP BY c_nationkey, c_custkey % 5""")
def _(get, spark):
    K, _ = _keys()
    funcs = detect.functions(_code(get, "python", ".py", _cat("def go():\n    ", F.when(K % 2 == 0, "sh.run()").otherwise("pass"), "\n")), _catalog(spark, ("python", "call", "sh.run", "exec")))
    known, _calls, direct = detect.ir(funcs)
    return known.select("fn").join(direct.select("fn", "capability"), "fn", "left")


@query("text_reachability", """SELECT CAST(c_nationkey AS STRING) AS project, concat('p', CAST(c_custkey AS STRING)) AS package, c_custkey % 3 < 2 AS reachable FROM customer WHERE c_custkey % 3 < 3""")
def _(get, spark):
    K, N = _keys()
    packages = get("customer").select(_s(N).alias("project"), _cat("p", K).alias("name"), F.when(K % 3 == 0, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>")).alias("dependencies"))
    found = get("customer").filter("c_custkey % 3 < 2").select(_s(N).alias("project"), _cat("p", K).alias("module"))
    return detect.reachable(found, packages)


@query("trace_probes", "SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN 'filesystem' WHEN 1 THEN 'network' ELSE 'subprocess' END AS kind, concat('x ', CAST(user_id AS STRING)) AS detail FROM events")
def _(get, spark):
    k = F.col("event_id") % 3
    line = _cat(F.when(k == 0, "fs").when(k == 1, "net").otherwise("exec"), " x ", F.col("user_id"))
    return inputs.trace_events(get("events").select(line.alias("value")).unionByName(spark.createDataFrame([("other x",), ("fs",)], "value string")), "probes")


@query("health_gate", """SELECT module, CASE WHEN module % 7 = 0 THEN concat('module ', CAST(module AS STRING), ' is archived') ELSE concat('module ', CAST(module AS STRING), ' has health ', CAST(module % 90 AS STRING), ', below 40') END AS reason FROM d_modules WHERE module % 7 = 0 OR module % 90 < 40""")
def _(get, spark):
    from ..operators import score

    m = F.col("module")
    return score.health_gate(get("d_modules").select("module", (m % 90).alias("score"), (m % 7 == 0).alias("archived")), 40, True)


@query("suppress_by_module", "SELECT package, module FROM d_packages WHERE coalesce(module, package) % 4 <> 0")
def _(get, spark):
    from ..operators import policy

    rows = get("d_packages").select("package", "module")
    patterns = rows.select(F.coalesce("module", "package").cast("string").alias("pattern")).filter("CAST(pattern AS long) % 4 = 0").distinct()
    return policy.suppressed_modules(rows, patterns)
