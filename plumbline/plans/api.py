"""What a user calls: a scanner over projects, plugins, and a command per report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.checkpoints import cut
from ..operators import capset, compare, detect, engines, graph, history, interproc, policy, score, taint
from ..sinks import reports
from ..sources import catalog as catalogs
from ..sources import files as inputs
from ..sources import manifests


@dataclass
class ScanOptions:
    """How a scan is done. ``catalog`` replaces the built-in one."""

    langs: list[str] | None = None
    fail_on: str = "high"
    focus: str | None = None
    top: int | None = None
    hide_low_confidence: float = 0.0
    policy: inputs.Policy = field(default_factory=inputs.Policy)
    catalog: DataFrame | None = None
    unknown_as_false: bool = False
    workspace: bool = False
    now: str | None = None
    interprocedural: bool = True


@dataclass
class ScanResult:
    findings: DataFrame
    taint: DataFrame
    verdict: DataFrame
    evidence: DataFrame
    hints: DataFrame


@dataclass
class Upgrade:
    """Versions that change, symbols that break, and dependencies that are new (by name), with what they can do."""

    changes: DataFrame
    breaking: DataFrame
    added: DataFrame


class Analyzer(Protocol):
    """What a language's analysis gives: packages and their edges, and evidence."""

    def packages(self, files: DataFrame) -> DataFrame: ...

    def evidence(self, files: DataFrame) -> DataFrame: ...


class Differ(Protocol):
    """What a language's comparison gives: versions that change in a diff."""

    def pr(self, diffs: DataFrame, lang: str) -> DataFrame: ...


class Upgrader(Protocol):
    def upgrade(self, old: DataFrame, new: DataFrame) -> Upgrade: ...


class CapDiffer(Protocol):
    def diff(self, old: DataFrame, new: DataFrame) -> DataFrame: ...


class Reachability(Protocol):
    def reachability(self, files: DataFrame, entry: str | None = None) -> DataFrame: ...


class Plugins:
    """Detectors (path, content) -> [(capability, confidence)] and scorers (package, caps) -> 0..20, by name."""

    def __init__(self):
        self.detectors: dict[str, tuple[str, Callable]] = {}
        self.scorers: dict[str, Callable] = {}

    def detector(self, name: str, lang: str):
        return lambda f: self.detectors.__setitem__(name, (lang, f)) or f

    def scorer(self, name: str):
        return lambda f: self.scorers.__setitem__(name, f) or f

    def installed(self) -> list[tuple[str, str]]:
        return sorted([(n, "detector") for n in self.detectors] + [(n, "scorer") for n in self.scorers])

    def remove(self, name: str) -> bool:
        return (self.detectors.pop(name, None) or self.scorers.pop(name, None)) is not None

    def evidence(self, files: DataFrame) -> DataFrame:
        """Evidence of all detectors, in Arrow batches of files."""
        found = self.detectors

        def run(batches):
            for t in batches:
                rows = [(f.lang, f.project, f.path, 0, n, c, "plugin", float(p)) for f in t.itertuples() for n, (lang, d) in found.items() if lang == f.lang for c, p in d(f.path, f.content or "")]
                yield pd.DataFrame(rows, columns=["lang", "project", "path", "line", "key", "capability", "via", "confidence"])

        return files.select("lang", "project", "path", "content").mapInPandas(run, "lang string, project string, path string, line int, key string, capability string, via string, confidence double")

    def points(self, sets: DataFrame) -> DataFrame:
        """package, points: the sum of all scorers, each held to 0..20."""
        found = self.scorers

        @F.pandas_udf("double")
        def points(package: pd.Series, caps: pd.Series) -> pd.Series:
            return pd.Series([sum(min(20.0, max(0.0, float(f(p, list(c))))) for f in found.values()) for p, c in zip(package, caps, strict=True)], dtype=float)

        return sets.select("package", points(F.col("package").cast("string"), "caps").alias("points"))


def package_of(module: Column) -> Column:
    """project:module for a dependency's code, else the project's folder of ``path``."""
    return F.when(module.isNull(), detect.folder()).otherwise(F.concat_ws(":", "project", module))


class Scanner:
    """Scan (project, path, content) files: evidence to capability sets, taint, scores and a verdict per project.

    A package is a folder of a project (project/folder), or a dependency (project:name) whose
    code lies in a folder of its own. With ``workspace`` each member that a workspace file
    names is a project.
    """

    def __init__(self, spark: SparkSession, options: ScanOptions | None = None, plugins: Plugins | None = None):
        self.spark, self.options, self.plugins = spark, options or ScanOptions(), plugins or Plugins()

    def _sources(self, files: DataFrame) -> DataFrame:
        """Source files with the dependency they belong to (module) and their package."""
        src = inputs.sources(files)
        if self.options.langs:
            src = src.filter(F.col("lang").isin(*self.options.langs))
        owners = inputs.owners(src, manifests.packages(files)).withColumn("package", package_of(F.col("module")))
        return src.join(cut(owners), ["project", "path"])

    def _catalog(self) -> DataFrame:
        return self.options.catalog if self.options.catalog is not None else catalogs.builtin(self.spark)

    def evidence(self, files: DataFrame) -> DataFrame:
        """Evidence rows, with the project and, for a dependency's code, its name (module)."""
        return self._evidence(files, self._sources(files))

    def _evidence(self, files: DataFrame, src: DataFrame) -> DataFrame:
        found = detect.evidence(src, self._catalog())
        if self.plugins.detectors:
            found = found.unionByName(self.plugins.evidence(src))
        rows = found.join(src.select("project", "path", "module", "package").distinct(), ["project", "path"])
        rows = rows.select("project", "module", "package", "capability", F.col("path").alias("file"), "line", F.col("key").alias("context"), "via", "confidence")
        hooks = inputs.install_scripts(files).withColumn("module", inputs.owner(F.col("file"))).withColumn("path", F.col("file")).withColumn("package", package_of(F.col("module")))
        return cut(rows.unionByName(hooks.select(rows.columns)))

    def scan(self, files: DataFrame, engine_scores: DataFrame | None = None, health: DataFrame | None = None) -> ScanResult:
        """``engine_scores`` is one row (diff, integrity, topology), or a row per project; ``health`` is (module, score, archived)."""
        o = self.options
        if o.workspace:
            files = files.join(manifests.workspace_members(files).select("project").distinct(), "project", "left_anti").unionByName(manifests.members(files).drop("rank"))
        now = F.current_timestamp() if o.now is None else F.lit(o.now).cast("timestamp")
        exceptions = policy.active(o.policy.exceptions(self.spark), now)
        src = self._sources(files)
        evidence = self._evidence(files, src)
        if o.focus:
            evidence = policy.in_focus(evidence, o.focus, "package", "module")
        for via in o.policy.suppress.get("by_capability_via", []):
            evidence = evidence.filter(F.col("via") != via)
        for pattern in o.policy.suppress.get("by_file_pattern", []):
            evidence = evidence.filter(~F.col("file").rlike(inputs.glob(pattern)))
        least = o.hide_low_confidence or o.policy.confidence_threshold
        per_cap = capset.per_capability(evidence)
        if least:
            per_cap = capset.hide_low_confidence(per_cap, least)
            evidence = evidence.join(per_cap.select("package", "capability"), ["package", "capability"], "left_semi")
        owners = evidence.groupBy("package").agg(F.first("project").alias("project"), F.first("module").alias("module"))
        sets = capset.build(evidence)
        hints = self.spark.createDataFrame([], "package string, reachable boolean")
        findings = taint.pairs(per_cap)
        if o.interprocedural:
            cat = self._catalog()
            funcs = detect.functions(src, cat).join(src.select("project", "path", "package").distinct(), ["project", "path"])
            lines = detect.scan(src)
            known, calls, direct = detect.ir(funcs, detect.bound_calls(lines, detect.bindings(lines), cat))
            nodes, edges = interproc.contexts(known, calls)
            caps, states = interproc.summaries(nodes, edges, direct)
            hints = interproc.hints(nodes, caps, known).withColumn("reachable", F.lit(True))
            deep = interproc.findings(nodes, caps, states, known)
            if not deep.isEmpty():
                findings = deep.withColumn("rule_risk", F.col("risk"))
        findings = taint.keep_confident(findings.select("package", "source", "sink", "risk", "note", "confidence"), least)
        excepted = exceptions.filter("taint IS NOT NULL").select("package", F.substring_index("taint", ">", 1).alias("source"), F.substring_index("taint", ">", -1).alias("sink"))
        findings = taint.suppressed(findings, excepted)
        scored = self._scored(sets, findings, hints, engine_scores, owners)
        if self.plugins.scorers:
            scored = scored.join(self.plugins.points(sets), "package", "left").withColumn("final", F.least(F.lit(100.0), F.col("final") + F.coalesce("points", F.lit(0.0)))).withColumn("level", S.risk_level(F.col("final"))).drop("points")
        gated = scored
        patterns = lambda names: self.spark.createDataFrame([(p,) for p in names], "pattern string")
        if o.policy.exclude_packages:
            gated = policy.excluded(gated, patterns(o.policy.exclude_packages), "package")
        if o.policy.suppress.get("by_module"):
            gated = policy.suppressed_modules(gated, patterns(o.policy.suppress["by_module"]))
        deny = self.spark.createDataFrame([(c.lower(),) for c in o.policy.deny_capabilities], "capability string")
        denied = policy.denied(per_cap.join(gated.select("package"), "package", "left_semi"), deny, exceptions.filter("capability IS NOT NULL")).join(owners, "package")
        failing = score.verdict(gated, denied, o.policy.fail_on if o.policy.fail_on != "high" else o.fail_on)
        verdict = files.select("project").distinct().join(failing, "project", "left").select("project", F.coalesce("passed", F.lit(True)).alias("passed"), F.coalesce("n_failing", F.lit(0)).alias("n_failing"), F.coalesce("reason", F.lit("")).alias("reason"))
        if health is not None and (o.policy.min_health_score > 0 or o.policy.block_archived):
            ill = score.health_gate(health, o.policy.min_health_score, o.policy.block_archived)
            uses = manifests.packages(files).select("project", F.col("name").alias("module")).distinct()
            verdict = score.gated_by_health(verdict, uses.join(ill, "module"))
        shown = scored.orderBy(F.desc("score"), "package").limit(o.top) if o.top else scored
        return ScanResult(shown, findings, verdict.orderBy("project"), evidence, hints)

    def _scored(self, sets: DataFrame, findings: DataFrame, hints: DataFrame, engines_: DataFrame | None, owners: DataFrame) -> DataFrame:
        none = self.spark.createDataFrame([(0.0, 0.0, 0.0)], "diff double, integrity double, topology double")
        out = score.final(sets, taint.counts(findings), hints, none if engines_ is None or "project" in engines_.columns else engines_, self.options.unknown_as_false).join(owners, "package")
        if engines_ is not None and "project" in engines_.columns:
            more = F.coalesce(F.col("diff") + F.col("integrity") + F.col("topology"), F.lit(0.0))
            out = out.join(engines_, "project", "left").withColumn("final", F.least(F.lit(100.0), F.col("final") + more)).withColumn("level", S.risk_level(F.col("final"))).drop("diff", "integrity", "topology")
        return out

    def exit_code(self, result: ScanResult) -> int:
        """0 where all projects pass, else 1. (2 stands for failures of a run, which are exceptions here.)"""
        return 0 if result.verdict.filter("NOT passed").isEmpty() else 1

    def sarif(self, result: ScanResult, health: DataFrame) -> DataFrame:
        """The result as one SARIF document; ``health`` is (module, score)."""
        return reports.sarif_document(reports.sarif(result.findings.select("package", "level", "caps"), health))

    def text(self, result: ScanResult, health: DataFrame, vulns: DataFrame) -> DataFrame:
        """The result as lines of text: capabilities, health, taint flows, verdicts."""
        last = result.verdict.select(F.when(F.col("passed"), F.concat("project", F.lit(": PASSED"))).otherwise(F.concat("project", F.lit(": FAILED: "), "reason")).alias("value"))
        parts = [reports.capability_lines(result.findings), reports.health_lines(health, vulns), reports.taint_lines(result.taint), last]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _node(name: Column) -> Column:
    return F.concat_ws(_MARK, "project", name)


def _plain(df: DataFrame, *names: str) -> DataFrame:
    """Columns made by ``_node`` as names again, the first one's project beside them."""
    out = df.withColumn("project", F.substring_index(names[0], _MARK, 1))
    return out.withColumns({n: F.substring_index(n, _MARK, -1) for n in names})


#: between project and name in nodes of graphs, so that projects never share one
_MARK = "\x1f"


class Commands:
    """A report per command, over (project, path, content) files; each returns a DataFrame. Projects are apart throughout."""

    def __init__(self, spark: SparkSession, options: ScanOptions | None = None):
        self.spark, self.scanner = spark, Scanner(spark, options)

    def capabilities(self, files: DataFrame, min_risk: str = "low") -> DataFrame:
        s = capset.build(self.scanner.evidence(files)).withColumn("level", S.risk_level(F.col("score")))
        return s.filter(S.meets(F.col("level"), min_risk)).orderBy("package")

    def explain(self, files: DataFrame, capability: str | None = None) -> DataFrame:
        """Evidence by package and capability, packages of the highest score first."""
        e = self.scanner.evidence(files)
        scores = capset.build(e).select("package", "score")
        rows = reports.explained(capset.top_evidence(e if capability is None else e.filter(F.col("capability") == capability)))
        return rows.join(scores, "package").orderBy(F.desc("score"), "package", "capability")

    def taint(self, files: DataFrame) -> DataFrame:
        """Taint flows of packages, as explain shows them beside the evidence."""
        return reports.taint_lines(taint.pairs(capset.per_capability(self.scanner.evidence(files))))

    def reachability(self, files: DataFrame, entry: str | None = None, min_risk: str | None = None) -> DataFrame:
        """project, package, reachable; with ``min_risk`` only of packages that can do something, with what and their score."""
        src = inputs.sources(files).filter(inputs.owner(F.col("path")).isNull())
        if entry:
            src = src.filter(F.col("path") == entry)
        reached = detect.reachable(detect.imports(detect.scan(src)).select("project", "module"), manifests.packages(files))
        if min_risk is None:
            return reached
        sets = self._dependency_sets(files).withColumnRenamed("module", "package")
        return detect.risky(reached, sets, min_risk).orderBy(F.desc("score"), "project", "package")

    def _dependency_sets(self, files: DataFrame) -> DataFrame:
        """project, module, caps, score: what the code of each dependency can do."""
        e = self.scanner.evidence(files).filter("module IS NOT NULL")
        names = e.select("package", "project", "module").distinct()
        return capset.build(e).join(names, "package").select("project", "module", "caps", "score")

    def _edges(self, files: DataFrame) -> DataFrame:
        """src, dst of each project's dependencies, as nodes."""
        return manifests.edges(manifests.packages(files)).select(_node(F.col("src")).alias("src"), _node(F.col("dst")).alias("dst")).filter("src <> dst").distinct()

    def graph(self, files: DataFrame, min_risk: str = "low") -> DataFrame:
        """Risk of each project's dependencies, from the evidence in their code and that of what they pull in; the riskiest first."""
        names = manifests.packages(files).select(_node(F.col("name")).alias("module")).distinct()
        own = self._dependency_sets(files).select(_node(F.col("module")).alias("module"), "score")
        scored = names.join(own, "module", "left").select("module", F.coalesce("score", F.lit(0)).cast("long").alias("score"))
        out = graph.transitive_scores(scored, self._edges(files)).withColumn("level", S.risk_level(F.col("effective")))
        return _plain(out.filter(S.meets(F.col("level"), min_risk)), "module").orderBy(F.desc("effective"), "project", "module")

    def impact(self, files: DataFrame, module: str) -> DataFrame:
        """project, node, depth, loc: the dependencies that rest on a module, and the lines of their code."""
        nodes = files.select("project").distinct().select(_node(F.lit(module)).alias("node"))
        src = self.scanner._sources(files).filter("module IS NOT NULL")
        loc = detect.loc(src).join(src.select("project", "path", "module").distinct(), ["project", "path"]).groupBy("project", F.col("module").alias("node")).agg(F.sum("loc").alias("loc"))
        hit = _plain(graph.impact(self._edges(files), nodes), "node").join(loc, ["project", "node"], "left")
        return hit.select("project", "node", "depth", F.coalesce("loc", F.lit(0)).alias("loc"))

    def diff(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return compare.capabilities(capset.build(self.scanner.evidence(old)), capset.build(self.scanner.evidence(new)))

    def upgrade(self, old: DataFrame, new: DataFrame, module: str | None = None, symbols: tuple[DataFrame, DataFrame] | None = None) -> Upgrade:
        """What changes between two states of the files.

        ``module`` is the one being upgraded, which isn't new by itself; ``symbols`` are the
        exported symbols (package, symbol, type) before and after, where they are known.
        """
        name = lambda f: manifests.packages(f).select(F.col("name").alias("package"), "version").groupBy("package").agg(F.max_by("version", F.col("version")).alias("version"))
        changes = compare.versions(name(old), name(new))
        added = changes.filter("change = 'added'").filter(F.lit(True) if module is None else F.col("package") != module)
        caps = self._dependency_sets(new).groupBy("module").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("caps")))).alias("caps")).withColumnRenamed("module", "package")
        added = added.join(caps, "package", "left").select("package", F.col("new_version").alias("version"), F.coalesce("caps", F.array().cast("array<string>")).alias("caps")).orderBy("package")
        broken = compare.symbols(*symbols) if symbols else self.spark.createDataFrame([], "package string, symbol string, type string, new_type string, change string")
        return Upgrade(changes.orderBy("package"), broken.orderBy("package", "symbol"), added)

    def pr(self, diffs: DataFrame, lang: str) -> DataFrame:
        before, after = inputs.diff_versions(diffs, lang)
        return compare.versions(before.select("package", "version"), after.select("package", "version"))

    def diff_risk(self, diffs: DataFrame, lang: str, caps: DataFrame | None = None) -> DataFrame:
        """Points of each change, from what new versions can do (``caps``: package, caps) or from their names."""
        return compare.risk_deltas(self.pr(diffs, lang), "node" if lang == "node" else "go", caps)

    def topology(self, files: DataFrame, churn: int = -1) -> DataFrame:
        pk = manifests.packages(files)
        direct = pk.filter("direct").select(_node(F.col("name")).alias("node"))
        depths = _plain(graph.bfs(self._edges(files), direct, 1), "node").withColumnRenamed("node", "package")
        return engines.topology_signals(engines.topology_metrics(depths, pk.filter("direct").select("project", F.col("name").alias("package")), pk.select("project", S.module_base(F.col("name")).alias("base"), "version"), churn))

    def integrity(self, files: DataFrame) -> DataFrame:
        """project, package, type, points: violations of npm, yarn, pnpm and go lockfiles."""
        cols = ("project", "package", "integrity", "resolved")
        node = manifests.npm_lock(files).withColumnRenamed("name", "package").select(*cols).unionByName(manifests.yarn_sources(files).select(*cols)).unionByName(manifests.pnpm_sources(files).select(*cols))
        npm = engines.npm_integrity(node)
        mods = inputs.go_mod(files)
        of = lambda kind, *more: mods.filter(F.col("kind") == kind).select("project", F.col("module").alias("package"), *more)
        return npm.unionByName(engines.go_integrity(of("require"), inputs.go_sum(files), of("replace", "target")))

    @staticmethod
    def exit_code(report: DataFrame, most: int = 0, points: str = "points") -> int:
        """1 where the points of a report (capped at 20) are more than ``most``: integrity, diff_risk (points="delta"), licenses (points="risky")."""
        return int(engines.capped(report.withColumn("__points", F.col(points).cast("int")), "__points").first().score > most)

    def licenses(self, files: DataFrame, licenses: DataFrame) -> DataFrame:
        return engines.license_risk(manifests.packages(files).select(F.col("name").alias("module")).distinct(), licenses)

    def sbom(self, files: DataFrame, health: DataFrame) -> DataFrame:
        """One document of the dependencies of all projects, each with what its code can do."""
        pk = manifests.first_seen(manifests.packages(files))
        modules = pk.groupBy(F.col("name").alias("module")).agg(F.min_by("version", F.struct("project", "seq")).alias("version"))
        inside = pk.select(F.col("name").alias("module"), F.concat_ws(":", "project", "name").alias("package"), F.lit(False).alias("is_main")).distinct()
        return reports.cyclonedx(reports.components(modules, inside, capset.build(self.scanner.evidence(files)), health, "generic"))

    def viz(self, files: DataFrame, kind: str = "json", least: str = "low") -> DataFrame:
        """The dependency graph as json, dot or html; where projects are several, each name begins with its own."""
        one = files.select("project").distinct().count() <= 1
        name = lambda c: F.substring_index(c, _MARK, -1) if one else F.translate(c, _MARK, ":")
        risk = self.graph(files).select((F.col("module") if one else F.concat_ws(":", "project", "module")).alias("node"), "level")
        nodes, edges = reports.subgraph(self._edges(files).select(name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst")), risk, least)
        return {"json": reports.node_link, "dot": reports.dot, "html": reports.html}[kind](nodes, edges)

    def record(self, files: DataFrame, past: DataFrame) -> DataFrame:
        """History (seq, module, score, level) of one project, with a snapshot of its modules' effective scores."""
        now = self.graph(files).select("module", F.col("effective").cast("int").alias("score"), "level")
        return reports.append_snapshot(past, now)

    def changes(self, past: DataFrame, old: int | None = None, new: int | None = None) -> DataFrame:
        return compare.snapshots(*history.pair(past, old, new))

    def trend(self, past: DataFrame, module: str | None = None) -> DataFrame:
        t = history.trend(past)
        return t if module is None else t.filter(F.col("module") == module)

    def trace(self, rows: DataFrame, limit: int = 24, form: str = "calls") -> DataFrame:
        return inputs.trace_events(rows, form).orderBy("kind", "detail").limit(limit)


def views(frames: dict[str, DataFrame]) -> None:
    """Give DataFrames names for SQL."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
