"""Dependency manifests of 22 ecosystems, read by declarative specs.

``files`` is (project, path, content). Line formats share one DataFrame parser:
sections and blocks are carried forward by windows over a file's lines, and each block
becomes a package. JSON formats are decoded with from_json. Of several manifests of a
project and language, the one of the lowest rank counts.

Result: (lang, project, name, version, dependencies ARRAY<STRING>, direct, seq). Files
that can't be read as their format give no packages; nothing raises.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

PACKAGE = "lang string, project string, name string, version string, dependencies array<string>, direct boolean, seq int"


@dataclass(frozen=True)
class Lines:
    """How packages stand in the lines of a file.

    ``section``/``inside``: a line that begins a section, and the sections that count
    (regex on the first group). ``start``: begins a block; without it every line that
    ``name`` matches is a block. ``name``/``version``: first group of the first match in the block.
    ``dep_on``/``dep_off``/``dep``: lines between which dependencies are listed.
    """

    lang: str
    file: str
    rank: int
    name: str
    version: str = ""
    start: str = ""
    section: str = ""
    inside: str = ""
    dep: str = ""
    dep_on: str = ""
    dep_off: str = ""
    inline: str = ""  # a list of dependencies within one line
    direct: bool = False  # a manifest: all that it lists is direct
    skip: str = r"^\s*(?:#|//|--|;|%)"


_TOML = {"start": r"^\[\[(?:package|deps\..*)\]\]", "name": r'^\s*name\s*=\s*"([^"]+)"', "version": r'^\s*version\s*=\s*"([^"]+)"'}
_PY = r"([A-Za-z0-9][A-Za-z0-9_.\-]*)"

LINES = [
    # node
    Lines("node", r"yarn\.lock", 2, r'^"?(@?[^@"\s]+)@', r'^\s+version:? "?([^"\s]+)"?', start=r'^"?@?[^\s#"][^"]*@.*:\s*$', dep_on=r"^\s{2}(?:dependencies|optionalDependencies):\s*$", dep_off=r"^(?:\S|\s{2}\S)", dep=r'^\s{4}"?(@?[^\s":]+)"?:? '),
    Lines("node", r"pnpm-lock\.yaml", 3, r"^  ['\"]?/?(@?[^@'\"(\s]+)[@/][^:('\"]+.*:\s*$", r"^  ['\"]?/?@?[^@'\"(\s]+[@/]([^:('\"]+).*:\s*$", section=r"^(\w+):", inside="packages|snapshots", start=r"^  ['\"]?/?@?[^@'\"(\s]+[@/][^:]+.*:\s*$", dep_on=r"^    (?:dependencies|optionalDependencies):\s*$", dep_off=r"^ {0,4}\S", dep=r"^ {6}['\"]?(@?[^\s'\":]+)['\"]?: "),
    # python
    Lines("python", r"poetry\.lock", 1, **_TOML, dep_on=r"^\[package\.dependencies\]", dep_off=r"^\[", dep=rf'^"?{_PY}"?\s*='),
    Lines("python", r"requirements\.txt", 3, rf"^{_PY}\s*(?:\[[^\]]*\])?\s*(?:[=<>!~;@#]|$)", rf"^{_PY.replace('(', '(?:')}\s*(?:\[[^\]]*\])?\s*==\s*([^\s;#,]+)", direct=True, skip=r"^\s*(?:#|-)"),
    Lines("python", r"pyproject\.toml", 4, rf'^\s*"?{_PY}"?\s*(?:=|[<>=!~\[;"])', r'==\s*([^\s",;]+)|=\s*"[\^~]?([0-9][^"]*)"', section=r"^\[([^\]]+)\]|^(dependencies)\s*=\s*\[", inside=r"tool\.poetry\.(?:dev-)?dependencies|tool\.poetry\.group\..*\.dependencies|dependencies", direct=True),
    # java
    Lines("java", r"gradle\.lockfile", 2, r"^([^:=\s]+:[^:=\s]+):[^=\s]+", r"^[^:=\s]+:[^:=\s]+:([^=\s]+)", direct=True),
    Lines("java", r"build\.gradle(?:\.kts)?", 3, r"""(?:implementation|api|compileOnly|runtimeOnly|compile|testImplementation|annotationProcessor)\s*\(?\s*["']([^:"']+:[^:"']+)""", r"""["'][^:"']+:[^:"']+:([^"'@]+)""", direct=True),
    # rust
    Lines("rust", r"Cargo\.lock", 1, **_TOML, dep_on=r"^dependencies = \[\s*$", dep_off=r"^\]", dep=r'^\s+"([^\s"]+)', inline=r'^dependencies = \[(.+)\]'),
    Lines("rust", r"Cargo\.toml", 2, r'^([A-Za-z0-9_\-]+)\s*=', r'=\s*"[\^~=]?([^"]+)"|version\s*=\s*"([^"]+)"', section=r"^\[([^\]]+)\]", inside=r"(?:dev-|build-)?dependencies", direct=True),
    # ruby
    Lines("ruby", r"Gemfile\.lock", 1, r"^ {4}([^\s(]+) \(", r"^ {4}[^\s(]+ \(([^)]+)\)", start=r"^ {4}[^\s(]+ \(", section=r"^([A-Z]+)\s*$", inside="GEM|GIT|PATH", dep_on=r"^ {4}[^\s(]+ \(", dep_off=r"^ {0,4}\S", dep=r"^ {6}([^\s(]+)"),
    Lines("ruby", r"Gemfile", 2, r"""^\s*gem\s+["']([^"']+)["']""", r"""^\s*gem\s+["'][^"']+["']\s*,\s*["'][~><= ]*([^"']+)["']""", direct=True),
    # dart
    Lines("dart", r"pubspec\.lock", 1, r"^  (\S+):\s*$", r'^    version: "?([^"\s]+)"?', start=r"^  \S+:\s*$", section=r"^(\w+):", inside="packages"),
    Lines("dart", r"pubspec\.yaml", 2, r"^  ([A-Za-z0-9_]+):", r"^  [A-Za-z0-9_]+:\s*[\^]?([0-9][^\s#]*)", section=r"^(\w+):", inside="dependencies|dev_dependencies", direct=True),
    # elixir
    Lines("elixir", r"mix\.lock", 1, r'^\s*"([^"]+)":\s*\{', r'^\s*"[^"]+":\s*\{:\w+,\s*:?"?[^,]+,\s*"([^"]+)"', inline=r"\[(\{:.+\})\]"),
    Lines("elixir", r"mix\.exs", 2, r"\{:(\w+)\s*,", r'\{:\w+\s*,\s*"[~><= ]*([^"]+)"', direct=True),
    # swift
    Lines("swift", r"Package\.swift", 2, r'\.package\([^)]*url:\s*"(?:[^"]*/)?([^/"]+?)(?:\.git)?"', r'(?:from|exact):\s*"([^"]+)"', direct=True),
    # dotnet
    Lines("dotnet", r".*\.csproj", 2, r'<PackageReference\s+[^>]*Include="([^"]+)"', r'Version="([^"]+)"', direct=True),
    # kotlin
    Lines("kotlin", r"libs\.versions\.toml", 1, r"""(?:module\s*=\s*|=\s*)"([^":]+:[^":]+)(?::[^"]*)?\"""", r"""version\s*=\s*"([^"]+)"|=\s*"[^":]+:[^":]+:([^"]+)\"""", section=r"^\[([^\]]+)\]", inside="libraries", direct=True),
    Lines("kotlin", r"build\.gradle(?:\.kts)?", 3, r"""(?:implementation|api|compileOnly|runtimeOnly|testImplementation|kapt|ksp)\s*\(?\s*["']([^:"']+:[^:"']+)""", r"""["'][^:"']+:[^:"']+:([^"'@]+)""", direct=True),
    # scala
    Lines("scala", r"build\.sbt", 1, r'"[^"]+"\s*%%?%?\s*"([^"]+)"', r'"[^"]+"\s*%%?%?\s*"[^"]+"\s*%\s*"([^"]+)"', direct=True),
    # cpp
    Lines("cpp", r"conanfile\.txt", 3, r"^([A-Za-z0-9_.+\-]+)/", r"^[^/\s]+/([^@\s#]+)", section=r"^\[([^\]]+)\]", inside="requires|build_requires|tool_requires", direct=True),
    Lines("cpp", r"conanfile\.py", 2, r"""requires\s*(?:=|\()\s*[(\[]?\s*["']([^/"']+)/""", r"""["'][^/"']+/([^@"']+)""", direct=True),
    # haskell
    Lines("haskell", r"cabal\.project\.freeze", 1, r"any\.([A-Za-z0-9\-]+)\s*==", r"any\.[A-Za-z0-9\-]+\s*==\s*([0-9.]+)"),
    Lines("haskell", r"stack\.yaml\.lock", 2, r"hackage:\s*([A-Za-z0-9\-]+?)-[0-9.]+(?:@|$)", r"hackage:\s*[A-Za-z0-9\-]+?-([0-9.]+)(?:@|$)"),
    Lines("haskell", r".*\.cabal", 3, r"^\s*(?:build-depends:\s*|,\s*|\s+)([A-Za-z][A-Za-z0-9\-]*)\s*(?:[><=^&,]|$)", r"==\s*([0-9.]+)", section=r"^\s*([a-z\-]+):", inside="build-depends", direct=True),
    # clojure
    Lines("clojure", r"deps\.edn", 1, r"([A-Za-z0-9_.\-]+/?[A-Za-z0-9_.\-]*)\s+\{:mvn/version", r':mvn/version\s+"([^"]+)"', direct=True),
    Lines("clojure", r"project\.clj", 2, r'\[([A-Za-z0-9_./\-]+)\s+"', r'\[[A-Za-z0-9_./\-]+\s+"([^"]+)"', direct=True),
    # erlang
    Lines("erlang", r"rebar\.lock", 1, r'\{<<"([^"]+)">>\s*,\s*\{', r'<<"[^"]+">>\s*,\s*<<"([^"]+)">>'),
    Lines("erlang", r"rebar\.config", 2, r"\{(\w+)\s*,\s*[\"{]", r'\{\w+\s*,\s*"[~><= ]*([^"]+)"', direct=True),
    # ocaml
    Lines("ocaml", r"(?:.*\.)?opam\.locked", 1, r'^\s*"([A-Za-z0-9_\-]+)"', r'(?<![<>!])=\s*"([^"]+)"', section=r"^(\w+):", inside="depends"),
    Lines("ocaml", r".*\.opam", 3, r'^\s*"([A-Za-z0-9_\-]+)"', r'(?<![<>!])=\s*"([^"]+)"', section=r"^(\w+):", inside="depends", direct=True),
    # julia
    Lines("julia", r"Manifest\.toml", 1, r"^\[\[(?:deps\.)?([A-Za-z0-9_]+)\]\]", r'^version = "([^"]+)"', start=r"^\[\[(?:deps\.)?[A-Za-z0-9_]+\]\]"),
    Lines("julia", r"Project\.toml", 2, r"^([A-Za-z0-9_]+)\s*=", section=r"^\[([^\]]+)\]", inside="deps", direct=True),
    # r
    Lines("r", r"DESCRIPTION", 2, r"^(?:Imports:|Depends:|LinkingTo:|\s+)\s*([A-Za-z][A-Za-z0-9.]*)", r"\(>?=+\s*([^)]+)\)", section=r"^([A-Za-z]+):", inside="Imports|Depends|LinkingTo", direct=True),
    # perl
    Lines("perl", r"cpanfile\.snapshot", 1, r"^  ([A-Za-z0-9_:\-]+?)-v?[0-9][0-9._]*\s*$", r"^  [A-Za-z0-9_:\-]+?-(v?[0-9][0-9._]*)\s*$", start=r"^  \S+-v?[0-9][0-9._]*\s*$"),
    Lines("perl", r"cpanfile", 2, r"""^\s*requires\s+["']([^"']+)["']""", r"""^\s*requires\s+["'][^"']+["']\s*(?:,|=>)\s*["']?[>=< ]*([0-9][^"';]*)""", direct=True),
    # lua
    Lines("lua", r"luarocks\.lock", 1, r'\[?"?([A-Za-z0-9_\-]+)"?\]?\s*=\s*"[0-9]', r'=\s*"([0-9][^"]*)"'),
    Lines("lua", r".*\.rockspec", 2, r'^\s*"([A-Za-z0-9_\-]+)', r'(?:==|~>|>=)\s*([0-9][^",\s]*)', section=r"^\s*(\w+)\s*=\s*\{", inside="dependencies", direct=True),
]

_DEP = "struct<version:string,link:boolean,resolved:string,integrity:string,dependencies:map<string,string>>"
LOCK_V2 = f"packages map<string,{_DEP}>"
_V1 = "struct<version:string,resolved:string,integrity:string,requires:map<string,string>,dependencies:map<string,struct<version:string,requires:map<string,string>>>>"

#: lang, file, rank, schema of the content, and the packages as an array of (name, version, dependencies) or a map
_PHP = "name:string,version:string,require:map<string,string>"
JSON = [
    ("php", r"composer\.lock", 1, f"packages array<struct<{_PHP}>>, `packages-dev` array<struct<{_PHP}>>", "transform(concat(coalesce(packages, array()), coalesce(`packages-dev`, array())), p -> struct(p.name AS name, p.version AS version, filter(map_keys(coalesce(p.require, map())), k -> k <> 'php' AND NOT startswith(k, 'ext-')) AS dependencies))"),
    ("python", r"Pipfile\.lock", 2, "default map<string,struct<version:string>>, develop map<string,struct<version:string>>", "transform(map_entries(map_concat(coalesce(default, map()), map_filter(coalesce(develop, map()), (k, v) -> NOT map_contains_key(coalesce(default, map()), k)))), e -> struct(e.key AS name, regexp_replace(e.value.version, '^==', '') AS version, CAST(array() AS array<string>) AS dependencies))"),
    ("swift", r"Package\.resolved", 1, "pins array<struct<identity:string,state:struct<version:string>>>, object struct<pins:array<struct<package:string,state:struct<version:string>>>>", "concat(transform(coalesce(pins, array()), p -> struct(p.identity AS name, p.state.version AS version, CAST(array() AS array<string>) AS dependencies)), transform(coalesce(object.pins, array()), p -> struct(p.package AS name, p.state.version AS version, CAST(array() AS array<string>) AS dependencies)))"),
    ("dotnet", r"packages\.lock\.json", 1, "dependencies map<string,map<string,struct<type:string,resolved:string,dependencies:map<string,string>>>>", "flatten(transform(map_values(coalesce(dependencies, map())), m -> transform(map_entries(m), e -> struct(e.key AS name, e.value.resolved AS version, map_keys(coalesce(e.value.dependencies, map())) AS dependencies))))"),
    ("cpp", r"vcpkg\.json", 1, "dependencies array<string>", "transform(coalesce(dependencies, array()), d -> struct(coalesce(get_json_object(d, '$.name'), d) AS name, get_json_object(d, '$.version>=') AS version, CAST(array() AS array<string>) AS dependencies))"),
    ("r", r"renv\.lock", 1, "Packages map<string,struct<Package:string,Version:string,Requirements:array<string>>>", "transform(map_entries(coalesce(Packages, map())), e -> struct(coalesce(e.value.Package, e.key) AS name, e.value.Version AS version, coalesce(e.value.Requirements, CAST(array() AS array<string>)) AS dependencies))"),
]

#: what a project's own manifest names as direct, where the lockfile doesn't say
DIRECT_JSON = {"node": (r"package\.json", ["dependencies", "devDependencies"]), "php": (r"composer\.json", ["require", "require-dev"])}


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _named(files: DataFrame, pattern: str) -> DataFrame:
    return files.filter(base(F.col("path")).rlike(f"^(?:{pattern})$"))


def lines(files: DataFrame) -> DataFrame:
    """project, path, no (from 1), value: the lines of each file."""
    return files.select("project", "path", F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\r?\n")).alias("no", "value")).withColumn("no", F.col("no") + 1)


def _first(value: Column, pattern: str) -> Column:
    """The first group of the pattern that took part, else null."""
    groups = [F.nullif(F.regexp_extract(value, pattern, g), F.lit("")) for g in range(1, 3) if g <= _groups(pattern)]
    return F.coalesce(*groups) if groups else F.lit(None).cast("string")


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def parse_lines(files: DataFrame, spec: Lines) -> DataFrame:
    """Packages of the files that a spec is for."""
    value = F.col("value")
    order = Window.partitionBy("project", "path").orderBy("no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(_named(files, spec.file)).filter(~value.rlike(spec.skip))
    if spec.section:
        rows = rows.withColumn("section", F.last(_first(value, spec.section), ignorenulls=True).over(so_far)).filter(F.col("section").rlike(f"^(?:{spec.inside})$"))
    start = value.rlike(spec.start or spec.name)
    rows = rows.withColumn("block", F.sum(start.cast("int")).over(so_far)).filter("block > 0")
    none = F.lit(None).cast("string")
    dep = none
    if spec.dep:
        switch = F.when(value.rlike(spec.dep_on), True).when(value.rlike(spec.dep_off), False)
        rows = rows.withColumn("listing", F.coalesce(F.last(switch, ignorenulls=True).over(Window.partitionBy("project", "path", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
        dep = F.when(F.col("listing") & ~value.rlike(spec.dep_on), _first(value, spec.dep))
    inline = F.array().cast("array<string>")
    if spec.inline:
        inline = F.array_compact(F.transform(F.split(F.regexp_extract(value, spec.inline, 1), r"\},\s*|,\s*"), lambda x: F.nullif(F.regexp_extract(x, r'^\s*(?:\{:|")?([A-Za-z0-9_.\-]+)', 1), F.lit(""))))
        if spec.lang == "elixir":
            inline = F.transform(F.regexp_extract_all(F.regexp_extract(value, spec.inline, 1), F.lit(r"\{:(\w+)"), 1), lambda x: x)
    got = rows.select("project", "path", "block", "no", _first(value, spec.name).alias("name"), (_first(value, spec.version) if spec.version else none).alias("version"), dep.alias("dep"), inline.alias("inline"))
    each = got.groupBy("project", "path", "block").agg(
        F.min("no").alias("seq"),
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("no"))).alias("name"),
        F.min_by("version", F.when(F.col("version").isNotNull(), F.col("no"))).alias("version"),
        F.array_sort(F.array_distinct(F.concat(F.collect_list("dep"), F.flatten(F.collect_list("inline"))))).alias("dependencies"),
    )
    return each.filter("name IS NOT NULL").select(F.lit(spec.lang).alias("lang"), "project", "name", F.coalesce("version", F.lit("")).alias("version"), "dependencies", F.lit(spec.direct).alias("direct"), "seq", F.lit(spec.rank).alias("rank"))


def _json(files: DataFrame, lang: str, pattern: str, rank: int, schema: str, packages: str) -> DataFrame:
    doc = _named(files, pattern).select("project", F.from_json("content", schema).alias("d")).filter("d IS NOT NULL").select("project", "d.*")
    rows = doc.select("project", F.posexplode(F.expr(packages)).alias("seq", "p"))
    return rows.select(F.lit(lang).alias("lang"), "project", "p.name", F.coalesce("p.version", F.lit("")).alias("version"), F.array_sort("p.dependencies").alias("dependencies"), F.lit(False).alias("direct"), "seq", F.lit(rank).alias("rank"))


def npm_lock(files: DataFrame) -> DataFrame:
    """package-lock.json of any version, with (project, name, version, resolved, integrity, dependencies, seq).

    Rows come in the order of their path in the lockfile.
    """
    found = _named(files, r"package-lock\.json").select("project", F.from_json("content", LOCK_V2).alias("new"), F.from_json("content", f"dependencies map<string,{_V1}>").alias("old"))
    new = found.select("project", F.explode("new.packages").alias("path", "p")).filter("path <> '' AND NOT coalesce(p.link, false)")
    new = new.select("project", "path", F.regexp_replace("path", r"^.*node_modules/", "").alias("name"), "p.version", "p.resolved", "p.integrity", F.map_keys(F.coalesce("p.dependencies", F.expr("CAST(map() AS map<string,string>)"))).alias("dependencies"))
    top = found.filter("new.packages IS NULL").select("project", F.explode("old.dependencies").alias("path", "p"))
    keys = lambda c: F.map_keys(F.coalesce(c, F.expr("CAST(map() AS map<string,string>)")))
    old = top.select("project", "path", F.col("path").alias("name"), "p.version", "p.resolved", "p.integrity", keys(F.col("p.requires")).alias("dependencies"))
    deep = top.select("project", "path", F.explode("p.dependencies").alias("name", "q")).select("project", F.concat_ws("/", "path", "name").alias("path"), "name", F.col("q.version").alias("version"), F.lit(None).cast("string").alias("resolved"), F.lit(None).cast("string").alias("integrity"), keys(F.col("q.requires")).alias("dependencies"))
    rows = new.unionByName(old).unionByName(deep)
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("project").orderBy("path"))).drop("path")


def maven(files: DataFrame) -> DataFrame:
    """Dependencies of pom.xml: group:artifact and version."""
    blocks = _named(files, r"pom\.xml").select("project", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("seq", "b"))
    tag = lambda n: F.trim(F.regexp_extract("b", rf"(?s)<{n}>\s*(.*?)\s*</{n}>", 1))
    rows = blocks.select(F.lit("java").alias("lang"), "project", F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"), tag("version").alias("version"), F.array().cast("array<string>").alias("dependencies"), F.lit(True).alias("direct"), "seq", F.lit(1).alias("rank"))
    return rows.filter("name <> ':' AND name <> ''")


def present(files: DataFrame) -> set[str]:
    """The file patterns of specs that some file has: one pass over the names, one row to the driver."""
    patterns = sorted({s.file for s in LINES} | {j[1] for j in JSON} | {p for p, _ in DIRECT_JSON.values()} | {r"package-lock\.json", r"pom\.xml"})
    row = files.agg(*[F.bool_or(base(F.col("path")).rlike(f"^(?:{p})$")).alias(f"p{i}") for i, p in enumerate(patterns)]).first()
    return {p for p, hit in zip(patterns, row, strict=True) if hit}


def direct_names(files: DataFrame, there: set[str]) -> DataFrame:
    """lang, project, name: what manifests name beside their lockfiles."""
    out = [files.sparkSession.createDataFrame([], "lang string, project string, name string")]
    for lang, (pattern, fields) in DIRECT_JSON.items():
        if pattern not in there:
            continue
        doc = _named(files, pattern).select("project", F.from_json("content", ", ".join(f"`{f}` map<string,string>" for f in fields)).alias("d"))
        for f in fields:
            out.append(doc.select(F.lit(lang).alias("lang"), "project", F.explode(F.map_keys(F.col(f"d.`{f}`"))).alias("name")))
    for s in LINES:
        if s.direct and s.file in there:
            out.append(parse_lines(files, s).select("lang", "project", "name"))
    gem = lines(_named(files, r"Gemfile\.lock"))
    w = Window.partitionBy("project", "path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    gem = gem.withColumn("section", F.last(_first(F.col("value"), r"^([A-Z]+)\s*$"), ignorenulls=True).over(w)).filter("section = 'DEPENDENCIES'")
    if r"Gemfile\.lock" in there:
        out.append(gem.select(F.lit("ruby").alias("lang"), "project", _first(F.col("value"), r"^  ([^\s(!]+)").alias("name")).dropna())
    return reduce(DataFrame.unionByName, out).distinct()


def packages(files: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """Packages of all projects; of each name and version of a project the first stands."""
    want = lambda lang: langs is None or lang in langs
    unknown = set(langs or []) - {*LANGUAGES}
    if unknown:
        raise ValueError(f"unknown languages: {', '.join(sorted(unknown))}")
    there = present(files)
    parts = [files.sparkSession.createDataFrame([], PACKAGE + ", rank int")]
    parts += [parse_lines(files, s) for s in LINES if want(s.lang) and s.file in there]
    parts += [_json(files, *j) for j in JSON if want(j[0]) and j[1] in there]
    if want("node") and r"package-lock\.json" in there:
        parts.append(npm_lock(files).select(F.lit("node").alias("lang"), "project", "name", F.coalesce("version", F.lit("")).alias("version"), "dependencies", F.lit(False).alias("direct"), "seq", F.lit(1).alias("rank")))
    if want("java") and r"pom\.xml" in there:
        parts.append(maven(files))
    rows = reduce(DataFrame.unionByName, parts)
    best = rows.withColumn("best", F.min("rank").over(Window.partitionBy("lang", "project"))).filter("rank = best")
    once = best.withColumn("r", F.row_number().over(Window.partitionBy("lang", "project", "name", "version").orderBy("seq"))).filter("r = 1")
    named = direct_names(files, there).withColumn("named", F.lit(True)).withColumnRenamed("lang", "l").withColumnRenamed("project", "p").withColumnRenamed("name", "n")
    fold = lambda c, lang: F.when(lang == "python", S.python_name(c)).otherwise(c)
    hit = (F.col("lang") == F.col("l")) & (F.col("project") == F.col("p")) & (fold(F.col("name"), F.col("lang")) == fold(F.col("n"), F.col("l")))
    return once.join(named, hit, "left").select("lang", "project", "name", "version", "dependencies", (F.col("direct") | F.coalesce("named", F.lit(False))).alias("direct"), "seq").distinct()


def first_seen(pkgs: DataFrame) -> DataFrame:
    """One row a name: the first of its versions."""
    w = Window.partitionBy("lang", "project", "name").orderBy("seq", "version")
    return pkgs.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def edges(pkgs: DataFrame) -> DataFrame:
    """lang, project, src, dst, pos: names a package depends on (they may not be packages)."""
    return pkgs.select("lang", "project", F.col("name").alias("src"), F.posexplode("dependencies").alias("pos", "dst"))


LANGUAGES = ["go", "node", "php", "python", "java", "rust", "ruby", "dart", "elixir", "swift", "dotnet", "kotlin", "scala", "cpp", "haskell", "clojure", "erlang", "ocaml", "julia", "r", "perl", "lua"]

#: manifest names in the order in which they decide a project's language
DETECT = [
    ("go", r"go\.mod|go\.work"), ("node", r"package\.json|package-lock\.json|yarn\.lock|pnpm-lock\.yaml"), ("php", r"composer\.lock|composer\.json"), ("python", r"poetry\.lock|Pipfile\.lock|requirements\.txt|pyproject\.toml"),
    ("kotlin", r"libs\.versions\.toml|build\.gradle\.kts"), ("java", r"pom\.xml|gradle\.lockfile|build\.gradle"), ("rust", r"Cargo\.lock|Cargo\.toml"), ("ruby", r"Gemfile\.lock|Gemfile"), ("dart", r"pubspec\.lock|pubspec\.yaml"),
    ("elixir", r"mix\.lock|mix\.exs"), ("swift", r"Package\.resolved|Package\.swift"), ("dotnet", r"packages\.lock\.json|.*\.csproj|.*\.sln"), ("scala", r"build\.sbt"), ("cpp", r"vcpkg\.json|conanfile\.py|conanfile\.txt"),
    ("haskell", r"cabal\.project\.freeze|stack\.yaml\.lock|.*\.cabal"), ("clojure", r"deps\.edn|project\.clj"), ("erlang", r"rebar\.lock|rebar\.config"), ("ocaml", r"(?:.*\.)?opam\.locked|.*\.opam|dune-project"),
    ("julia", r"Manifest\.toml|Project\.toml"), ("r", r"renv\.lock|DESCRIPTION"), ("perl", r"cpanfile\.snapshot|cpanfile"), ("lua", r"luarocks\.lock|.*\.rockspec"),
]


def detect(files: DataFrame) -> DataFrame:
    """project, lang: the first language whose manifest is there; go with package.json is multi; else go."""
    names = files.groupBy("project").agg(F.collect_set(base(F.col("path"))).alias("names"))
    has = lambda p: F.exists("names", lambda x: x.rlike(f"^(?:{p})$"))
    lang = F.when(has(r"go\.mod") & has(r"package\.json"), "multi")
    for name, pattern in DETECT:
        lang = lang.when(has(pattern), name)
    return names.select("project", lang.otherwise("go").alias("lang"))


def features(lang: str) -> dict[str, bool]:
    """What can be done for a language; ``multi`` stands for go here. An unknown one is a ValueError."""
    lang = "go" if lang == "multi" else lang
    if lang not in LANGUAGES:
        raise ValueError(f"unknown language {lang!r}")
    return {"manifest": True, "imports": True, "functions": lang != "php", "pr_diff": True, "integrity": lang in ("go", "node"), "topology": True}


def yarn_sources(files: DataFrame) -> DataFrame:
    """project, package, resolved of each yarn.lock block; the format has no digest that counts, so integrity is set."""
    rows = lines(_named(files, r"yarn\.lock")).filter(~F.col("value").rlike(r"^\s*(?:#|$)"))
    head = F.when(~F.col("value").rlike(r"^\s"), F.regexp_extract("value", r'^"?(@?[^@",:]+)', 1))
    w = Window.partitionBy("project", "path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.sum(head.isNotNull().cast("int")).over(w)).withColumn("head", head)
    resolved = F.nullif(F.regexp_extract("value", r'^\s+(?:resolved|resolution:) "?([^"]+)"?', 1), F.lit(""))
    return rows.filter("block > 0").groupBy("project", "block").agg(F.max("head").alias("package"), F.max(resolved).alias("resolved")).select("project", "package", F.lit("-").alias("integrity"), "resolved")


def pnpm_sources(files: DataFrame) -> DataFrame:
    """project, package, resolved of the importers in pnpm-lock.yaml; its store keeps the digests."""
    rows = lines(_named(files, r"pnpm-lock\.yaml"))
    w = Window.partitionBy("project", "path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(_first(F.col("value"), r"^(\w+):"), ignorenulls=True).over(w)).filter("section = 'importers'")
    dep = F.when(F.col("value").rlike(r"^ {6,}\S.*:\s*$"), F.regexp_extract("value", r"^\s+['\"]?([^'\":]+)['\"]?:\s*$", 1))
    rows = rows.withColumn("package", F.last(dep, ignorenulls=True).over(w)).withColumn("resolved", F.nullif(F.regexp_extract("value", r"^\s*specifier:\s*['\"]?([^'\"\s]+)", 1), F.lit("")))
    return rows.filter("resolved IS NOT NULL AND package IS NOT NULL").select("project", "package", F.lit("-").alias("integrity"), F.regexp_replace("resolved", "^gitlab:", "git+").alias("resolved"))


def workspace_members(files: DataFrame) -> DataFrame:
    """project, rank, pattern: member folders that a workspace file names (go.work, else pnpm, else npm); * is one folder."""
    go = lines(_named(files, r"go\.work")).withColumn("m", F.regexp_extract("value", r"^\s*(?:use\s+)?\(?\s*(\.\.?/?[^\s()]*)", 1)).filter("m <> ''")
    pnpm = lines(_named(files, r"pnpm-workspace\.yaml")).withColumn("m", F.regexp_extract("value", r"^\s*-\s*['\"]?([^'\"!\s]+)", 1)).filter("m <> ''")
    doc = _named(files, r"package\.json").filter(~F.contains("path", F.lit("/")))
    npm = doc.select("project", F.posexplode(F.coalesce(F.from_json(F.get_json_object("content", "$.workspaces.packages"), "array<string>"), F.from_json(F.get_json_object("content", "$.workspaces"), "array<string>"))).alias("no", "m"))
    kinds = [(0, go), (1, pnpm), (2, npm)]
    rows = reduce(DataFrame.unionByName, [d.select("project", F.lit(k).alias("kind"), F.col("no").alias("rank"), F.regexp_replace("m", r"^\./|/+$", "").alias("pattern")) for k, d in kinds])
    best = F.min("kind").over(Window.partitionBy("project"))
    return rows.withColumn("best", best).filter("kind = best").select("project", "rank", "pattern")


def members(files: DataFrame) -> DataFrame:
    """Files of workspace members, each member a project of its own (project/folder), with its rank.

    A project's few patterns are one row, which its files meet by the project's name.
    """
    like = F.concat(F.lit("^("), F.regexp_replace(F.regexp_replace("pattern", r"([.+()\[\]{}^$|?])", r"\\$1"), r"\*+", "[^/]+"), F.lit(")/"))
    m = workspace_members(files).groupBy("project").agg(F.collect_list(F.struct("rank", like.alias("like"))).alias("patterns"))
    hit = files.join(m, "project").withColumn("m", F.explode("patterns")).filter(F.expr("path RLIKE m.like"))
    folder = F.expr("regexp_extract(path, m.like, 1)")
    return hit.select(F.concat("project", F.lit("/"), folder).alias("project"), F.substring("path", F.length(folder) + 2, F.length("path")).alias("path"), "content", "m.rank")
