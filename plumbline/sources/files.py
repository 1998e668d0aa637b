"""Other inputs: source trees, go files and command output, diffs, history, policy, traces."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .manifests import lines

EXTENSIONS = {
    "go": ["go"], "node": ["js", "mjs", "cjs", "ts", "tsx"], "php": ["php"], "python": ["py"], "java": ["java"], "rust": ["rs"], "ruby": ["rb"], "dart": ["dart"], "elixir": ["ex", "exs"], "swift": ["swift"], "dotnet": ["cs"],
    "kotlin": ["kt", "kts"], "scala": ["scala"], "cpp": ["c", "cc", "cpp", "cxx", "h", "hpp"], "haskell": ["hs", "lhs"], "clojure": ["clj", "cljc", "cljs"], "erlang": ["erl", "hrl"], "ocaml": ["ml", "mli"], "julia": ["jl"], "r": ["r", "R"], "perl": ["pl", "pm", "t"], "lua": ["lua"],
}
#: folders that hold what tools made; in what others ship only those of version control and caches
SKIP = [".git", "target", "build", "dist", "__pycache__", ".venv", "venv", "_build"]
SKIP_SHIPPED = [".git", "__pycache__"]
#: where the code of dependencies lies, and the group that names its owner
OWNERS = [
    r"^(?:.*/)?node_modules/((?:@[^/]+/)?[^/]+)/", r"^(?:.*/)?gems/([^/]+)-\d[^/]*/", r"^(?:.*/)?site-packages/([^/]+)/", r"^(?:.*/)?deps/([^/]+)/",
]
VENDORED = r"^(?:.*/)?vendor/(.+)/[^/]*$"


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """project, path, content of the files below a folder of projects; the name filter reaches the listing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    below = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/") + "/", "")
    return raw.select(F.split(below, "/")[0].alias("project"), F.regexp_replace(below, "^[^/]+/", "").alias("path"), F.col("content").cast("string").alias("content"))


def owner(path: Column) -> Column:
    """The dependency whose folder a file lies in, by the folder's name; null for a project's own files."""
    return F.coalesce(*[F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in OWNERS])


def sources(files: DataFrame) -> DataFrame:
    """Source files with their lang, a project's own and those of its dependencies."""
    ext = F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)
    lang = F.try_element_at(F.create_map(*[F.lit(x) for la, es in EXTENSIONS.items() for e in es for x in (e, la)]), ext)
    shipped = owner(F.col("path")).isNotNull() | F.col("path").rlike(VENDORED)
    below = F.regexp_replace("path", r"^(?:.*/)?(?:node_modules|site-packages|gems|deps|vendor)/", "")
    skip = lambda c, names: F.exists(F.split(c, "/"), lambda x: x.isin(*names))
    keep = F.when(shipped, ~skip(below, SKIP_SHIPPED)).otherwise(~skip(F.col("path"), SKIP))
    return files.filter(keep).withColumn("lang", lang).filter("lang IS NOT NULL")


def owners(src: DataFrame, packages: DataFrame) -> DataFrame:
    """project, path, module: the dependency that each file belongs to, null for a project's own.

    In vendor folders it is the longest beginning of the path that names one of
    ``packages`` (project, name), else the folder. Folders of installed packages are
    compared with names as their language folds them.
    """
    fold = S.python_name
    named = packages.select("project", fold(F.col("name")).alias("folded"), F.col("name").alias("known")).groupBy("project", "folded").agg(F.min("known").alias("known"))
    at = F.when(owner(F.col("path")).isNull(), F.nullif(F.regexp_extract("path", VENDORED, 1), F.lit("")))
    paths = src.select("project", "path", owner(F.col("path")).alias("folder"), at.alias("at")).distinct()
    each = paths.select("*", F.explode_outer(F.coalesce(S.prefixes(F.col("at"), "/"), F.array(F.col("folder")))).alias("p")).withColumn("folded", fold(F.col("p")))
    best = F.max_by("known", F.when(F.col("known").isNotNull(), F.length("p")))
    return each.join(named, ["project", "folded"], "left").groupBy("project", "path").agg(F.coalesce(best, F.first("folder"), F.first("at")).alias("module"))


def go_list(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages and edges from captured package listings, one JSON object per row in ``value``; the standard library is left out."""
    schema = "ImportPath string, Name string, Dir string, Standard boolean, GoFiles array<string>, Imports array<string>, Module struct<Path:string,Version:string,Main:boolean,Indirect:boolean>"
    p = rows.select(F.from_json("value", schema).alias("p")).select("p.*").filter(~F.coalesce("Standard", F.lit(False)))
    packages = p.select(F.col("ImportPath").alias("package"), F.col("Name").alias("name"), F.col("Module.Path").alias("module"), F.col("Module.Version").alias("version"), F.coalesce("Module.Main", F.lit(False)).alias("is_main"), F.coalesce("Module.Indirect", F.lit(False)).alias("indirect"), F.col("Dir").alias("dir"))
    return packages, p.select(F.col("ImportPath").alias("src"), F.posexplode("Imports").alias("pos", "dst"))


def mod_graph(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Modules named in a module graph (lines ``from to``) that ``known`` (module) lacks."""
    two = rows.select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") == 2)
    names = two.select(F.explode("f").alias("x")).select(F.regexp_replace("x", "@[^@]*$", "").alias("module")).distinct()
    return names.join(known.select("module"), "module", "left_anti")


def go_mod(files: DataFrame, single_line_direct: bool = False) -> DataFrame:
    """project, kind (require or replace), module, version, indirect, target of go.mod files.

    With ``single_line_direct`` a one-line require counts as direct even when marked
    indirect, as the topology metrics have it. ``go_requires`` has it as the comparison of
    versions does.
    """
    rows = lines(files.filter(F.col("path").rlike(r"(^|/)go\.mod$")))
    w = Window.partitionBy("project", "path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.regexp_extract("value", r"^\s*(require|replace|exclude|retract)\s*\(", 1)
    mark = F.when(open_ != "", open_).when(F.col("value").rlike(r"^\s*\)\s*$"), "")
    rows = rows.withColumn("block", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit("")))
    one = F.regexp_extract("value", r"^\s*(require|replace)\s+[^(\s]", 1)
    kind = F.when(one != "", one).when((F.col("block") != "") & (open_ == ""), F.col("block"))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"\s*//.*$", ""), r"^\s*(?:(?:require|replace)\s+)?", ""), r"\s+$", "")
    rows = rows.select("project", kind.alias("kind"), body.alias("body"), F.contains("value", F.lit("// indirect")).alias("marked"), (one != "").alias("single"), "no").filter("kind IN ('require', 'replace') AND body <> '' AND body <> ')'")
    left = F.split(F.split("body", r"\s*=>\s*")[0], r"\s+")
    target = F.trim(F.regexp_extract("body", r"=>\s*(.*)$", 1))
    indirect = F.col("marked") & ~F.col("single") if single_line_direct else F.col("marked")
    return rows.select("project", "kind", left[0].alias("module"), F.coalesce(F.get(left, F.lit(1)), F.lit("")).alias("version"), indirect.alias("indirect"), target.alias("target"), F.col("no").alias("seq"))


def go_requires(files: DataFrame) -> DataFrame:
    """project, package, version of requires that have both; of several of a module the last."""
    rows = go_mod(files).filter("kind = 'require' AND version <> ''")
    return rows.groupBy("project", F.col("module").alias("package")).agg(F.max_by("version", "seq").alias("version"))


def go_sum(files: DataFrame) -> DataFrame:
    """project, package: first field of lines of three fields or more."""
    f = F.split(F.trim("value"), r"\s+")
    return lines(files.filter(F.col("path").rlike(r"(^|/)go\.sum$"))).filter(F.size(f) >= 3).select("project", f[0].alias("package")).distinct()


def diff_lines(diffs: DataFrame) -> DataFrame:
    """project, file, no, sign, text: added and removed lines of unified diffs (project, content)."""
    rows = lines(diffs.withColumn("path", F.lit("diff")))
    w = Window.partitionBy("project").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract("value", r"^\+\+\+ (?:b/)?(\S+)", 1), F.lit(""))
    rows = rows.withColumn("file", F.last(head, ignorenulls=True).over(w))
    sign = F.substring("value", 1, 1)
    return rows.filter(sign.isin("+", "-") & ~F.col("value").rlike(r"^(?:\+\+\+|---) ")).select("project", "file", "no", sign.alias("sign"), F.expr("substring(value, 2)").alias("text"))


#: name and version of a dependency in one line of each ecosystem's manifest
DIFF_LINE = {
    "go": r"^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/\S+)\s+(v\S+)", "node": r'^\s*"(@?[^"]+)":\s*"([^"]+)"', "php": r'^\s*"([\w.\-]+/[\w.\-]+)":\s*"([^"]+)"', "python": r'^\s*"?([A-Za-z0-9][\w.\-]*)"?\s*(?:==|=\s*")\s*([^\s",;]+)', "java": r"""["']([^:"']+:[^:"']+):([^"'@]+)["']|^([^:=\s]+:[^:=\s]+):([^=\s]+)=""",
    "rust": r'^\s*([A-Za-z0-9_\-]+)\s*=\s*(?:\{\s*version\s*=\s*)?"([^"]+)"', "ruby": r"""^\s*(?:gem\s+["'])?([a-z][\w\-]*)(?:["'],\s*["'][~>= ]*| \()([^"')]+)""", "dart": r"^\s+([a-z]\w*):\s*\^?([0-9]\S*)", "elixir": r'\{:(\w+),\s*"[~>= ]*([^"]+)"', "swift": r'url:\s*"(?:[^"]*/)?([^/"]+?)(?:\.git)?".*?"([0-9][^"]*)"',
    "dotnet": r'Include="([^"]+)".*Version="([^"]+)"', "kotlin": r"""["']([^:"']+:[^:"']+):([^"'@]+)["']""", "scala": r'"[^"]+"\s*%%?%?\s*"([^"]+)"\s*%\s*"([^"]+)"', "cpp": r'^\s*"?([A-Za-z0-9_.+\-]+)/([0-9][^@"\s]*)', "haskell": r"(?:any\.)?([A-Za-z][A-Za-z0-9\-]*)\s*==\s*([0-9.]+)", "clojure": r'\[?([A-Za-z0-9_./\-]+)\s+(?:\{:mvn/version\s+)?"([^"]+)"',
    "erlang": r'\{(?:<<")?(\w+)(?:">>)?,\s*(?:\{pkg,\s*<<"[^"]+">>,\s*<<)?"([^"]+)"', "ocaml": r'^\s*"([A-Za-z0-9_\-]+)"\s*\{.*?"([^"]+)"', "julia": r'^\s*([A-Za-z0-9_]+)\s*=\s*"([^"]+)"', "r": r"^\s*([A-Za-z][A-Za-z0-9.]*)\s*\(>?=+\s*([^)]+)\)", "perl": r"""requires\s+["']([^"']+)["']\s*(?:,|=>)\s*["']?([0-9][^"';]*)""", "lua": r'"([A-Za-z0-9_\-]+)\s*(?:==|~>|>=)\s*([0-9][^",\s]*)',
}


def diff_versions(diffs: DataFrame, lang: str) -> tuple[DataFrame, DataFrame]:
    """(project, package, version) before and after a diff; the same package twice keeps the last."""
    p = DIFF_LINE[lang]
    n = 3 if lang == "java" else 1
    pick = lambda g: F.coalesce(*[F.nullif(F.regexp_extract("text", p, i), F.lit("")) for i in range(g, g + n, 2)], F.lit(""))
    rows = diff_lines(diffs).select("project", "sign", "no", pick(1).alias("package"), pick(2).alias("version")).filter("package <> ''")
    side = lambda s: rows.filter(F.col("sign") == s).groupBy("project", "package").agg(F.max_by("version", "no").alias("version"))
    return side("-"), side("+")


def history(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots (seq, ts, commit, module, version, level, score, capabilities) of a history file; none if it is missing."""
    schema = "snapshots array<struct<timestamp:string,commit:string,modules:array<struct<module:string,version:string,risk_level:string,effective_score:int,capabilities:array<string>>>>>"
    try:
        raw = spark.read.schema(schema).option("multiLine", True).json(path)
        raw.take(1)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], schema)
    snaps = raw.select(F.posexplode("snapshots").alias("seq", "s")).select((F.col("seq") + 1).alias("seq"), F.try_to_timestamp("s.timestamp").alias("ts"), "s.commit", F.explode("s.modules").alias("m"))
    return snaps.select("seq", "ts", "commit", "m.module", "m.version", F.col("m.risk_level").alias("level"), F.col("m.effective_score").alias("score"), "m.capabilities")


@dataclass
class Policy:
    """What a scan is gated by. ``read`` refuses unknown fields unless lenient."""

    version: int = 1
    fail_on: str = "high"
    deny_capabilities: list[str] = field(default_factory=list)
    allow_exceptions: list[dict] = field(default_factory=list)
    exclude_packages: list[str] = field(default_factory=list)
    suppress: dict = field(default_factory=dict)
    confidence_threshold: float = 0.0
    max_health_score: int = 0
    min_health_score: int = 0
    block_archived: bool = False
    max_dep_depth: int = 0

    @classmethod
    def read(cls, text: str, lenient: bool = False, env: dict[str, str] | None = None) -> Policy:
        given = json.loads(text)
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(given) - known)
        if unknown and not lenient:
            raise ValueError(f"unknown policy field {unknown[0]}: did you mean {closest(unknown[0], sorted(known)) or '?'}")
        out = cls(**{k: v for k, v in given.items() if k in known})
        for name, value in (env or {}).items():
            if name in known:
                setattr(out, name, type(getattr(out, name))(value))
        return out

    def exceptions(self, spark: SparkSession) -> DataFrame:
        """package, capability, taint (source>sink), expires: one row per capability or taint."""
        rows = []
        for e in self.allow_exceptions:
            rows += [(e.get("package"), c.lower(), None, e.get("expires")) for c in e.get("capabilities", [])]
            rows += [(e.get("package"), None, t.replace("→", ">").replace("->", ">").replace(" ", ""), e.get("expires")) for t in e.get("taint", [])]
        return spark.createDataFrame(rows, "package string, capability string, taint string, expires string")


def glob(pattern: str) -> str:
    """A regular expression of a path pattern: * is within a folder, ** any depth."""
    parts = re.split(r"(\*\*/?|\*|\?)", pattern)
    return "^" + "".join({"**": ".*", "**/": "(?:.*/)?", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "$"


def closest(word: str, of: list[str], most: int = 3) -> str | None:
    """The nearest name by edit distance, if that is at most ``most``."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    best = min(of, key=lambda x: (distance(word, x), x), default=None)
    return best if best is not None and distance(word, best) <= most else None


def trace_events(rows: DataFrame, form: str = "calls") -> DataFrame:
    """kind, detail: file, network and process events in ``value``, each once.

    ``calls`` are system calls with arguments, ``probes`` lines of a kind (fs, net, exec) and a detail.
    """
    if form == "probes":
        line = F.trim("value")
        kind = F.try_element_at(F.create_map(*[F.lit(x) for x in ("fs", "filesystem", "net", "network", "exec", "subprocess")]), F.substring_index(line, " ", 1))
        return rows.filter(F.contains(line, F.lit(" "))).select(kind.alias("kind"), F.regexp_replace(line, "^[^ ]* ", "").alias("detail")).filter("kind IS NOT NULL").dropDuplicates(["kind", "detail"])
    call = F.regexp_extract("value", r"(?:^|\s|\])(\w+)\(", 1)
    text = F.regexp_extract("value", r'"([^"]*)"', 1)
    port, host = F.regexp_extract("value", r"sin6?_port=htons\((\d+)\)", 1), F.coalesce(F.nullif(F.regexp_extract("value", r'inet_addr\("([^"]+)"\)', 1), F.lit("")), F.nullif(F.regexp_extract("value", r'inet_pton\(AF_INET6, "([^"]+)"', 1), F.lit("")), F.lit(""))
    kind = F.when(call.isin("open", "openat", "creat", "unlink", "unlinkat", "rename", "mkdir"), "filesystem").when(call.isin("connect", "sendto", "bind"), "network").when(call.isin("execve", "execveat"), "subprocess")
    detail = F.when(kind == "network", F.when(host != "", F.concat_ws(":", host, port)).otherwise(text)).otherwise(text)
    return rows.select(kind.alias("kind"), detail.alias("detail")).filter("kind IS NOT NULL AND detail <> ''").dropDuplicates(["kind", "detail"])


def commits(rows: DataFrame) -> DataFrame:
    """ts, commit, file from log lines ``commit|ISO time|file``."""
    f = F.split("value", r"\|")
    return rows.select(F.try_to_timestamp(F.get(f, F.lit(1))).alias("ts"), f[0].alias("commit"), F.get(f, F.lit(2)).alias("file")).filter("ts IS NOT NULL")


def install_scripts(files: DataFrame) -> DataFrame:
    """Evidence of packages whose install hooks fetch or run something."""
    doc = files.filter(F.col("path").rlike(r"(^|/)package\.json$")).select("project", "path", F.from_json("content", "name string, scripts map<string,string>").alias("d"))
    hooks = doc.select("project", "path", F.coalesce("d.name", "project").alias("package"), F.explode("d.scripts").alias("hook", "script")).filter(F.col("hook").isin("preinstall", "install", "postinstall"))
    bad = hooks.filter(F.col("script").rlike(r"curl|wget|bash|sh |/bin/sh"))
    return bad.select("project", "package", F.explode(F.array(F.lit("exec"), F.lit("network"))).alias("capability"), F.col("path").alias("file"), F.lit(0).alias("line"), F.concat("hook", F.lit(": "), F.substring("script", 1, 80)).alias("context"), F.lit("installScript").alias("via"), F.lit(0.85).alias("confidence"))


def workspace(member_graphs: list[tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """Member graphs (packages, edges) as one: a later member's rows replace those of the same key."""
    from ..operators.compare import merged

    pk, ed = member_graphs[0]
    for p, e in member_graphs[1:]:
        pk, ed = merged(pk, p, "package"), merged(ed, e, "src")
    return pk, ed

