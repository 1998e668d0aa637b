"""Capability evidence from source text: imports, call sites, bindings, functions and their calls.

``files`` is (lang, project, path, content); evidence rows are (lang, project, path,
line, key, capability, via, confidence).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Catalog rows up to which the catalog is broadcast; beyond that imports join by a shuffle.
BROADCAST_CATALOG = 200_000
CONFIDENCE = {"go": (0.90, 0.75), "node": (0.90, 0.60), "python": (0.90, 0.60), "java": (0.90, 0.60), "rust": (0.90, 0.60), "ruby": (0.90, 0.60)}
OTHER = (0.90, 0.75)

#: what names an imported module in a line; the first group that takes part counts
IMPORTS = {
    "go": [r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*$'],
    "node": [r"""require\(\s*['"]([^'"]+)['"]\s*\)""", r"""^\s*import\s+(?:[^'"]*?\s+from\s+)?['"]([^'"]+)['"]""", r"""^\s*export\s+[^'"]*\s+from\s+['"]([^'"]+)['"]"""],
    "php": [r"^\s*use\s+\\?([A-Za-z_][\w\\]*)"],
    "python": [r"^\s*from\s+([A-Za-z_][\w.]*)\s+import", r"^\s*import\s+([A-Za-z_][\w.]*)"],
    "java": [r"^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*)"],
    "rust": [r"^\s*(?:pub\s+)?use\s+(?:::)?([A-Za-z_][\w:]*)", r"^\s*extern\s+crate\s+(\w+)"],
    "ruby": [r"""^\s*require(?:_relative)?\s*\(?\s*['"]([^'"]+)['"]"""],
    "dart": [r"""^\s*import\s+['"](?:package:)?([^'"/]+)"""],
    "elixir": [r"^\s*(?:alias|import|use|require)\s+([A-Z][\w.]*)"],
    "swift": [r"^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|enum|protocol|func|var|let|typealias)\s+)?(\w+)"],
    "dotnet": [r"^\s*(?:global\s+)?using\s+(?:static\s+)?([A-Za-z_][\w.]*)\s*;"],
    "kotlin": [r"^\s*import\s+([A-Za-z_][\w.]*)"],
    "scala": [r"^\s*import\s+([A-Za-z_][\w.]*)"],
    "cpp": [r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'],
    "haskell": [r"^\s*import\s+(?:qualified\s+)?([A-Z][\w.]*)"],
    "clojure": [r"[\[(]([a-z][\w.\-]*(?:/[\w.\-]+)?)(?=\s+:(?:as|refer)|\]|\))"],
    "erlang": [r'^\s*-include_lib\("([^/"]+)/', r"^\s*-(?:behaviou?r|import)\((\w+)"],
    "ocaml": [r"^\s*open!?\s+([A-Z][\w.]*)"],
    "julia": [r"^\s*(?:using|import)\s+([A-Za-z_][\w.]*)"],
    "r": [r"""(?:library|require)\(\s*['"]?([A-Za-z][\w.]*)""", r"\b([A-Za-z][\w.]*):::?\w"],
    "perl": [r"^\s*(?:use|require)\s+([A-Z][\w:]*)"],
    "lua": [r"""require\s*\(?\s*['"]([^'"]+)['"]"""],
}
LONGEST = {"java": ".", "dotnet": ".", "kotlin": ".", "scala": "."}
EVERY = {"rust": "::", "python": "."}


def scan(files: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """lang, project, path, line, value: lines from 1; a line of more than ``limit`` characters ends its file."""
    rows = files.select("lang", "project", "path", F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\r?\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)
    cut = F.min(F.when(F.length("value") > limit, F.col("line"))).over(Window.partitionBy("project", "path"))
    return rows.withColumn("__cut", cut).filter(F.col("__cut").isNull() | (F.col("line") < F.col("__cut"))).drop("__cut")


def _each(value: Column, patterns: list[str]) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(value, F.lit(p), 1) for p in patterns]))


def imports(lines: DataFrame) -> DataFrame:
    """lang, project, path, line, module: every import."""
    found = F.lit(None).cast("array<string>")
    for lang, patterns in IMPORTS.items():
        found = F.when(F.col("lang") == lang, _each(F.col("value"), patterns)).otherwise(found)
    rows = lines.withColumn("module", F.explode(found)).filter("module <> ''").drop("value")
    return rows.withColumn("module", F.regexp_replace("module", r"[:.]+$", ""))


def candidates(lang: Column, module: Column) -> Column:
    """The catalog keys to look an import up under, best first."""
    low, top = F.lower(module), F.substring_index(module, ".", 1)
    dash = lambda c: F.translate(c, "_", "-")
    file = F.regexp_replace(module, r"\.(?:h|hpp|hh|hxx)$", "")
    forms = {
        "ruby": [module, F.translate(module, "/", "-"), dash(module)],
        "elixir": [F.lower(top), low, F.regexp_replace(top, "([a-z])([A-Z])", "$1_$2"), F.lower(F.regexp_replace(top, "([a-z])([A-Z])", "$1_$2")), dash(F.lower(F.regexp_replace(top, "([a-z])([A-Z])", "$1_$2")))],
        "swift": [module, low, F.initcap(module)],
        "haskell": [low, F.lower(F.translate(module, ".", "-")), F.lower(F.regexp_replace(module, r"^[^.]+\.", "")), F.lower(F.translate(F.regexp_replace(module, r"^[^.]+\.", ""), ".", "-"))],
        "cpp": [file, module, F.translate(file, "/", "-"), F.substring_index(module, "/", 1)],
        "ocaml": [F.lower(top)],
        "julia": [module, top],
        "php": [F.lower(F.concat_ws("/", F.slice(F.split(module, r"\\"), 1, 2))), module],
    }
    out = F.array(module)
    for name, form in forms.items():
        out = F.when(lang == name, F.array(*form)).otherwise(out)
    out = F.when(lang == "clojure", S.clojure_variants(module)).otherwise(out)
    for name, sep in (LONGEST | EVERY).items():
        out = F.when(lang == name, S.prefixes(module, sep)).otherwise(out)
    return F.array_distinct(out)


def match_imports(found: DataFrame, catalog: DataFrame, limit: int = BROADCAST_CATALOG) -> DataFrame:
    """Evidence of imports. Prefixes and spellings are expanded, so that all joins are by equality.

    python and rust take all that match; the others the first.
    """
    keys = catalog.filter("kind = 'import'").groupBy("lang", "key").agg(F.array_sort(F.collect_set("capability")).alias("caps"))
    if catalog.count() <= limit:
        keys = F.broadcast(keys)
    rows = found.withColumn("__id", F.struct("project", "path", "line", "module")).select("*", F.posexplode(candidates(F.col("lang"), F.col("module"))).alias("pos", "key"))
    hit = rows.join(keys, ["lang", "key"])
    first = F.min("pos").over(Window.partitionBy("lang", "__id"))
    hit = hit.withColumn("__first", first).filter(F.col("lang").isin(*EVERY) | (F.col("pos") == F.col("__first")))
    return hit.select("lang", "project", "path", "line", "key", F.explode("caps").alias("capability"), F.lit("import").alias("via"), _confidence(0).alias("confidence"))


def _confidence(kind: int) -> Column:
    out = F.lit(OTHER[kind])
    for lang, c in CONFIDENCE.items():
        out = F.when(F.col("lang") == lang, c[kind]).otherwise(out)
    return out


def _few(catalog: DataFrame, limit: int):
    """broadcast where the catalog has at most ``limit`` rows; beyond that nothing, and joins shuffle."""
    return F.broadcast if catalog.count() <= limit else lambda df: df


def match_calls(lines: DataFrame, catalog: DataFrame, limit: int = BROADCAST_CATALOG) -> DataFrame:
    """Evidence of call sites: catalog keys that a line contains.

    There is no key to join containment by: lines meet a language's keys as one array.
    Beyond ``limit`` rows of catalog, they meet only the keys that begin with three
    characters that the line has somewhere, by a shuffle.
    """
    calls = catalog.filter("kind = 'call'").select("lang", "key", "capability").distinct()
    if catalog.count() <= limit:
        pairs = calls.groupBy("lang").agg(F.array_sort(F.collect_set(F.struct("key", "capability"))).alias("pairs"))
        hits = lines.join(F.broadcast(pairs), "lang").withColumn("hit", F.explode(F.filter("pairs", lambda p: F.contains(F.col("value"), p["key"])))).select("*", "hit.key", "hit.capability")
    else:
        begin = lambda c, at: F.substring(c, at, 3) if isinstance(at, int) else c.substr(at, F.lit(3))
        keys = calls.withColumn("g", begin(F.col("key"), 1))
        short = keys.filter(F.length("key") < 3).select("lang", "key", "capability")
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("value") - 2, F.lit(1))), lambda i: begin(F.col("value"), i)))
        some = lines.withColumn("g", F.explode(grams)).join(keys.filter(F.length("key") >= 3), ["lang", "g"]).drop("g")
        hits = some.unionByName(lines.join(short, "lang")).filter(F.contains("value", F.col("key")))
    return hits.select("lang", "project", "path", "line", "key", "capability", F.lit("callSite").alias("via"), _confidence(1).alias("confidence"))


# ---- JavaScript bindings ---------------------------------------------------------


def bindings(lines: DataFrame) -> DataFrame:
    """project, path, local, module, export, line: what names in a file are bound to; the last binding counts.

    export is * for a whole module and default for a default import.
    """
    js = lines.filter("lang = 'node'")
    v = F.col("value")
    mod = r"""['"]([^'"]+)['"]"""
    one = lambda p, export, local=1, module=2: js.filter(v.rlike(p)).select("project", "path", "line", F.regexp_extract(v, p, local).alias("local"), F.regexp_extract(v, p, module).alias("module"), F.lit(export).alias("export"))
    names = lambda p: js.filter(v.rlike(p)).select("project", "path", "line", F.explode(F.split(F.regexp_extract(v, p, 1), ",")).alias("n"), F.regexp_extract(v, p, 2).alias("module")).select("project", "path", "line", F.trim(F.regexp_extract("n", r"(?:.*(?:\bas\b|:))?\s*([\w$]+)\s*$", 1)).alias("local"), "module", F.trim(F.regexp_extract("n", r"^\s*([\w$]+)", 1)).alias("export"))
    rows = (
        one(rf"(?:const|let|var)\s+([\w$]+)\s*=\s*require\(\s*{mod}\s*\)\s*;?\s*$", "*")
        .unionByName(names(rf"(?:const|let|var)\s+\{{([^}}]*)\}}\s*=\s*require\(\s*{mod}"))
        .unionByName(one(rf"^\s*import\s+([\w$]+)\s*(?:,\s*\{{[^}}]*\}})?\s*from\s+{mod}", "default"))
        .unionByName(names(rf"^\s*import\s+(?:[\w$]+\s*,\s*)?\{{([^}}]*)\}}\s*from\s+{mod}"))
        .unionByName(one(rf"^\s*import\s+\*\s+as\s+([\w$]+)\s+from\s+{mod}", "*"))
    ).filter("local <> ''")
    w = Window.partitionBy("project", "path", "local").orderBy(F.desc("line"), "module")
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def bound_calls(lines: DataFrame, bound: DataFrame, catalog: DataFrame, limit: int = BROADCAST_CATALOG) -> DataFrame:
    """Evidence of calls through bindings: x.f() and chained requires 0.80, destructured f() 0.85."""
    js = lines.filter("lang = 'node'")
    caps = _few(catalog, limit)(catalog.filter("lang = 'node' AND kind = 'import'").select(F.regexp_replace("key", "^node:", "").alias("module"), "capability"))
    calls = js.select("project", "path", "line", F.explode(F.regexp_extract_all("value", F.lit(r"(?:^|[^\w$.])([\w$]+(?:\.[\w$]+)?)\s*\("), 1)).alias("call"))
    calls = calls.select("project", "path", "line", "call", F.substring_index("call", ".", 1).alias("local"), F.contains("call", F.lit(".")).alias("dotted"))
    b = bound.select("project", "path", "local", F.regexp_replace("module", "^node:", "").alias("module"), "export")
    via = calls.join(b, ["project", "path", "local"]).filter(F.col("dotted") | ~F.col("export").isin("*", "default")).join(caps, "module")
    via = via.select("project", "path", "line", F.col("call").alias("key"), "capability", F.when(F.col("dotted"), 0.80).otherwise(0.85).alias("confidence"))
    p = r"""require\(\s*['"]([^'"]+)['"]\s*\)\s*\.\s*([\w$]+)\s*\("""
    chained = js.filter(F.col("value").rlike(p)).select("project", "path", "line", F.regexp_replace(F.regexp_extract("value", p, 1), "^node:", "").alias("module"), F.regexp_extract("value", p, 2).alias("key")).join(caps, "module").select("project", "path", "line", "key", "capability", F.lit(0.80).alias("confidence"))
    return via.unionByName(chained).select(F.lit("node").alias("lang"), "project", "path", "line", "key", "capability", F.lit("callSite").alias("via"), "confidence")


def go_calls(lines: DataFrame, catalog: DataFrame, limit: int = BROADCAST_CATALOG) -> DataFrame:
    """Evidence of go calls ``alias.Func(``, the alias resolved by the file's imports."""
    go = lines.filter("lang = 'go'")
    p = r'^\s*(?:import\s+)?(?:([\w.]+)\s+)?"([^"]+)"\s*$'
    named = go.filter(F.col("value").rlike(p)).select("project", "path", F.regexp_extract("value", p, 1).alias("a"), F.regexp_extract("value", p, 2).alias("module"))
    base = F.element_at(F.split(S.module_base(F.col("module")), "/"), -1)
    named = named.select("project", "path", F.when(F.col("a") == "", base).otherwise(F.col("a")).alias("alias"), base.alias("base"))
    calls = go.select("project", "path", "line", F.explode(F.regexp_extract_all("value", F.lit(r"\b(\w+\.[A-Z]\w*)"), 1)).alias("call"))
    calls = calls.select("project", "path", "line", F.substring_index("call", ".", 1).alias("alias"), F.substring_index("call", ".", -1).alias("fn"))
    hit = calls.join(named, ["project", "path", "alias"]).withColumn("key", F.concat_ws(".", "base", "fn"))
    keys = _few(catalog, limit)(catalog.filter("lang = 'go' AND kind = 'call'").select("key", "capability"))
    return hit.join(keys, "key").select(F.lit("go").alias("lang"), "project", "path", "line", "key", "capability", F.lit("callSite").alias("via"), F.lit(0.75).alias("confidence"))


def evidence(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """All evidence of source files."""
    lines = scan(files)
    out = match_imports(imports(lines), catalog).unionByName(match_calls(lines.filter("lang <> 'go'"), catalog)).unionByName(go_calls(lines, catalog))
    return out.unionByName(bound_calls(lines, bindings(lines), catalog))


# ---- functions -------------------------------------------------------------------

_W = r"[A-Za-z_$][\w$]*"
HEADS = {
    "go": rf"^func\s+(?:\(\s*\w*\s*\*?\w+[^)]*\)\s*)?({_W})\s*[\[(]",
    "node": rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_W})\s*\(|^\s*(?:export\s+)?(?:const|let|var)\s+({_W})\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|{_W}\s*=>)|^\s+(?:async\s+|static\s+)*({_W})\s*\([^)]*\)\s*\{{\s*$",
    "python": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",
    "java": rf"^\s*(?:(?:public|private|protected|static|final|synchronized|abstract|native)\s+)+[\w<>\[\],.? ]+\s+({_W})\s*\(",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)",
    "kotlin": r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\(",
    "scala": r"^\s*(?:\w+\s+)*def\s+(\w+)",
    "swift": r"^\s*(?:\w+\s+)*func\s+(\w+)",
    "dart": rf"^\s*(?:static\s+)?[\w<>?]+\s+({_W})\s*\([^;]*\{{\s*$",
    "dotnet": rf"^\s*(?:(?:public|private|protected|internal|static|async|override|virtual|sealed)\s+)+[\w<>\[\],.? ]+\s+({_W})\s*\(",
    "cpp": rf"^[\w:*&<>, ]+[\s*&]({_W})\s*\([^;]*$",
    "perl": r"^\s*sub\s+(\w+)",
    "r": r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*\(",
    "haskell": r"^([a-z]\w*)\s+(?:[^=:]*)=",
    "ocaml": r"^\s*let\s+(?:rec\s+)?([a-z_]\w*)",
    "ruby": r"^\s*def\s+(?:self\.)?(\w+[?!]?)",
    "lua": r"^\s*(?:local\s+)?function\s+([\w.:]+)\s*\(",
    "julia": r"^\s*function\s+(\w+[!]?)\s*\(",
    "elixir": r"^\s*defp?\s+(\w+[?!]?)",
    "clojure": r"^\s*\(defn-?\s+(\S+)",
    "erlang": r"^([a-z]\w*)\s*\([^)]*\)\s*(?:when\b.*)?->",
}
STYLE = {**dict.fromkeys(["go", "node", "java", "rust", "kotlin", "scala", "swift", "dart", "dotnet", "cpp", "perl", "r"], "brace"), **dict.fromkeys(["python", "haskell", "ocaml"], "indent"), **dict.fromkeys(["ruby", "lua", "julia", "elixir"], "end"), "clojure": "paren", "erlang": "clause"}
_OPENERS = {"ruby": r"\b(?:def|class|module|do|begin|case)\b|^\s*(?:if|unless|while|until|for)\b", "lua": r"\bfunction\b|\bthen\b|\bdo\b", "julia": r"\b(?:function|if|for|while|begin|let|try|struct|do|quote)\b", "elixir": r"\bdo\b(?!:)|\bfn\b"}
KEYWORDS = set("if else for while switch catch return new def fn func function fun sizeof match when case do try elif with assert print not and or in is lambda await yield super self this throw typeof instanceof using lock foreach until unless end then let var const class struct enum interface impl where loop move".split())
FALLBACK = 100


def strip_strings(text: str, lang: str) -> str:
    """The text with the contents of strings and comments blanked, lines kept."""
    quotes = "\"'`" if lang == "node" else '"' if lang in ("rust", "clojure", "ocaml", "haskell", "erlang") else "\"'"
    line_marks = {"python": ["#"], "ruby": ["#"], "perl": ["#"], "r": ["#"], "julia": ["#"], "elixir": ["#"], "lua": ["--"], "haskell": ["--"], "clojure": [";"], "erlang": ["%"]}.get(lang, ["//"])
    block = None if lang in ("python", "ruby", "perl", "r", "julia", "elixir", "lua", "haskell", "clojure", "erlang") else ("(*", "*)") if lang == "ocaml" else ("/*", "*/")
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c in quotes:
            j = i + 1
            while j < n and text[j] != c and not (text[j] == "\n" and c != "`"):
                j += 2 if text[j] == "\\" else 1
            j = min(j, n)
            out.append(c + re.sub(r"[^\n]", " ", text[i + 1 : j]) + text[j : j + 1])
            i = j + 1
        elif any(text.startswith(m, i) for m in line_marks):
            j = text.find("\n", i)
            j = n if j < 0 else j
            out.append(" " * (j - i))
            i = j
        elif block and text.startswith(block[0], i):
            j = text.find(block[1], i + 2)
            j = n if j < 0 else j + 2
            out.append(re.sub(r"[^\n]", " ", text[i:j]))
            i = j
        else:
            out.append(c)
            i += 1
    return "".join(out)


def function_spans(text: str | None, lang: str) -> list[tuple[str, int, int]]:
    """name, first and last line (from 1) of each function. Never raises."""
    if not text or lang not in HEADS:
        return []
    raw = text.replace("\r\n", "\n").split("\n")
    bare = strip_strings(text.replace("\r\n", "\n"), lang).split("\n")
    head, style, out = re.compile(HEADS[lang]), STYLE[lang], []
    for i, line in enumerate(raw):
        m = head.search(line)
        name = next((g for g in m.groups() if g), None) if m else None
        if name is None or name in KEYWORDS:
            continue
        end = None
        if style == "brace":
            depth = seen = 0
            for j in range(i, len(bare)):
                depth += bare[j].count("{") - bare[j].count("}")
                seen = seen or "{" in bare[j]
                if seen and depth <= 0:
                    end = j
                    break
                if not seen and j > i + 3:
                    break
            if end is None:
                end = min(len(raw) - 1, i + FALLBACK) if seen else i
        elif style == "indent":
            indent = len(line) - len(line.lstrip())
            end = i
            for j in range(i + 1, len(raw)):
                if raw[j].strip() and len(raw[j]) - len(raw[j].lstrip()) <= indent:
                    break
                if raw[j].strip():
                    end = j
        elif style == "end":
            opener, depth = re.compile(_OPENERS[lang]), 0
            for j in range(i, len(bare)):
                depth += len(opener.findall(bare[j])) - len(re.findall(r"\bend\b", bare[j]))
                if depth <= 0:
                    end = j
                    break
            end = min(len(raw) - 1, i + FALLBACK) if end is None else end
        elif style == "paren":
            depth = 0
            for j in range(i, len(bare)):
                depth += sum(bare[j].count(c) for c in "([{") - sum(bare[j].count(c) for c in ")]}")
                if depth <= 0:
                    end = j
                    break
            end = min(len(raw) - 1, i + FALLBACK) if end is None else end
        else:
            end = next((j for j in range(i, len(bare)) if bare[j].rstrip().endswith(".")), min(len(raw) - 1, i + FALLBACK))
        out.append((name, i + 1, end + 1))
    return out


FUNCTIONS = "lang string, project string, path string, name string, first int, last int, caps array<string>, calls array<string>"


def functions(files: DataFrame, catalog: DataFrame, drop_header_self_calls: bool = False) -> DataFrame:
    """Functions with the call-site capabilities and the called names of their bodies.

    Finding where a function ends is a scan with state, so whole files go through
    Arrow batches. A body holds its own header; with ``drop_header_self_calls`` the
    header doesn't count as a call.
    """
    keys: dict[str, list[tuple[str, str]]] = {}
    for r in catalog.filter("kind = 'call'").toLocalIterator():
        keys.setdefault(r.lang, []).append((r.key, r.capability))
    called = re.compile(r"([A-Za-z_$][\w$]*[?!]?)\s*\(")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for f in t.itertuples():
                lines_ = (f.content or "").split("\n")
                for name, a, b in function_spans(f.content, f.lang):
                    body = "\n".join(lines_[a - 1 : b])
                    caps = sorted({c for k, c in keys.get(f.lang, []) if k in body})
                    text = "\n".join(lines_[a:b]) if drop_header_self_calls else body
                    calls = sorted(set(called.findall(text)) - KEYWORDS)
                    rows.append((f.lang, f.project, f.path, name, a, b, caps, calls))
            yield pd.DataFrame(rows, columns=["lang", "project", "path", "name", "first", "last", "caps", "calls"])

    return files.select("lang", "project", "path", "content").mapInPandas(run, FUNCTIONS)


def folder(project: str = "project", path: str = "path") -> Column:
    """A project's folder of a file, as a package name."""
    return F.concat_ws("/", project, F.nullif(F.regexp_replace(path, r"/?[^/]*$", ""), F.lit("")))


def ir(funcs: DataFrame, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """functions, calls and direct capabilities for ``interproc``: a callee is a function of the same package.

    A package is the column of this name, else the folder. Of several functions of a name in a
    package the last counts for capabilities; calls of all do. Calls that are resolved
    through bindings (``found``, evidence of node files) count with their own confidence, the
    names of catalog keys in a body with 0.75.
    """
    f = funcs if "package" in funcs.columns else funcs.withColumn("package", folder())
    f = f.withColumn("fn", F.concat_ws(".", "package", "name"))
    known = f.select("fn", "package", "name").distinct()
    calls = f.select("package", F.col("fn").alias("caller"), F.explode("calls").alias("name")).join(known.select("package", "name", F.col("fn").alias("callee")), ["package", "name"]).select("caller", "callee")
    last = f.groupBy("fn").agg(F.max_by(F.struct("project", "path", "first", "last", "caps"), F.struct("path", "first")).alias("l")).select("fn", "l.*")
    direct = last.select("fn", F.explode("caps").alias("capability"), F.lit(0.75).alias("confidence"))
    if found is not None:
        inside = last.join(found.select("project", "path", "line", F.col("capability"), "confidence"), ["project", "path"]).filter("line BETWEEN first AND last")
        direct = direct.unionByName(inside.select("fn", "capability", "confidence"))
    return known, calls, direct.groupBy("fn", "capability").agg(F.max("confidence").alias("confidence"))


def reachable(found: DataFrame, packages: DataFrame) -> DataFrame:
    """project, package, reachable: packages that a project's imports reach over dependency edges.

    ``found`` are imports (project, module), ``packages`` (project, name, dependencies).
    ``risky`` adds what packages can do.
    """
    from . import graph

    node = lambda c: F.concat_ws("|", "project", c)
    seeds = found.select(node(F.col("module")).alias("node")).unionByName(found.select(node(S.bare_module(F.col("module"))).alias("node"))).distinct()
    edges = packages.select(node(F.col("name")).alias("src"), F.explode("dependencies").alias("d"), "project").select("src", node(F.col("d")).alias("dst"))
    reached = graph.closure(edges, seeds).withColumn("reachable", F.lit(True))
    own = packages.select("project", F.col("name").alias("package"), node(F.col("name")).alias("node"))
    return own.join(reached, "node", "left").select("project", "package", F.coalesce("reachable", F.lit(False)).alias("reachable"))


def risky(reached: DataFrame, sets: DataFrame, least: str = "low") -> DataFrame:
    """project, package, reachable, caps, score, level: of packages with capabilities (project, package, caps, score) at least of a level."""
    rows = reached.join(sets, ["project", "package"]).withColumn("level", S.risk_level(F.col("score")))
    return rows.filter((F.size("caps") > 0) & S.meets(F.col("level"), least)).select("project", "package", "reachable", "caps", "score", "level")


def by_package(functions: DataFrame, reached: DataFrame) -> DataFrame:
    """package, reachable: whether any function (node, package) of it is among the reached nodes (node)."""
    hit = functions.join(reached.select("node").distinct().withColumn("r", F.lit(True)), "node", "left")
    return hit.groupBy("package").agg(F.coalesce(F.bool_or("r"), F.lit(False)).alias("reachable"))


def loc(files: DataFrame) -> DataFrame:
    """project, path, loc: lines that aren't blank."""
    return files.select("project", "path", F.size(F.filter(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.trim(x) != "")).alias("loc"))
