"""Report writers: JSON, text, SARIF, CycloneDX, graph exports, markdown, explain, checksum, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import RETENTION


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def json_document(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """One document {name: [...]}; the rows are gathered, so this is for reports, not for tables."""
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), F.struct(*df.columns).alias("v"))))
    return df.agg(F.to_json(F.struct(F.transform(rows, lambda x: x["v"]).alias(name)), {"ignoreNullFields": "false"}).alias("value"))


def fitted(c: Column, width: int) -> Column:
    """Padded to a width; what is longer ends in an ellipsis."""
    c = c.cast("string")
    return F.rpad(F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c), width, " ")


def table(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Lines of text of fixed columns."""
    return df.select(F.concat_ws("  ", *[fitted(F.coalesce(F.col(c).cast("string"), F.lit("")), w) for c, w in widths.items()]).alias("value"))


def capability_lines(sets: DataFrame) -> DataFrame:
    """Text lines of packages (package, caps, score, level), the highest score first."""
    rows = sets.select("package", F.array_join("caps", ", ").alias("capabilities"), "score", "level").orderBy(F.desc("score"), "package")
    return table(rows, {"package": 50, "capabilities": 35, "score": 5, "level": 6})


def health_lines(health: DataFrame, vulns: DataFrame) -> DataFrame:
    """Text lines of modules (module, version, score, n_cve, archived), then of their vulnerabilities (module, id)."""
    status = F.when(F.coalesce("archived", F.lit(False)), "ARCHIVED").otherwise("OK")
    top = table(health.select("module", "version", "score", "n_cve", status.alias("status")), {"module": 50, "version": 12, "score": 5, "n_cve": 4, "status": 8})
    below = table(vulns.select("module", "id"), {"module": 50, "id": 20})
    return top.withColumn("o", F.lit(0)).unionByName(below.withColumn("o", F.lit(1))).orderBy("o", "value").select("value")


def taint_lines(findings: DataFrame) -> DataFrame:
    """Text lines of findings (package, source, sink, risk, note, confidence), each flow once, the highest risk first."""
    once = findings.groupBy("package", "source", "sink").agg(F.min_by(F.struct("risk", "note", "confidence"), F.struct(-S.risk_value(F.col("risk")), -F.col("confidence"), "note")).alias("f")).select("package", "source", "sink", "f.*")
    sure = F.when(F.col("confidence") > 0, F.format_string(" [conf: %.2f]", F.col("confidence").cast("double"))).otherwise("")
    line = F.concat_ws("  ", fitted(F.col("risk"), 6), fitted(F.col("package").cast("string"), 40), fitted(F.concat_ws(" → ", "source", "sink"), 18), F.concat(F.coalesce("note", F.lit("")), sure))
    return once.orderBy(F.desc(S.risk_value(F.col("risk"))), "package", "source", "sink").select(line.alias("value"))


def upgrade_lines(changes: DataFrame, breaking: DataFrame, added: DataFrame) -> DataFrame:
    """Text lines of an upgrade: versions (package, old_version, new_version), broken symbols (package, symbol, change, type, new_type), new dependencies (package, version)."""
    v = changes.select(F.lit(0).alias("o"), F.concat_ws(" ", F.col("package"), F.col("old_version"), F.lit("→"), F.col("new_version")).alias("value"))
    b = breaking.select(F.lit(1).alias("o"), F.concat(F.lit("  ["), F.col("change"), F.lit("] "), F.concat_ws(".", "package", "symbol"), F.lit(" old: "), F.coalesce("type", F.lit("")), F.lit(" new: "), F.coalesce("new_type", F.lit(""))).alias("value"))
    n = added.select(F.lit(2).alias("o"), F.concat(F.lit("  + "), F.concat_ws("@", "package", "version")).alias("value"))
    return v.unionByName(b).unionByName(n).orderBy("o", "value").select("value")


def impact_lines(affected: DataFrame, mains: DataFrame, loc: DataFrame) -> DataFrame:
    """Text lines of what a removal touches: affected (node, depth), which of them are mains (node), and their lines of code (node, loc)."""
    hit = affected.join(mains.select("node").distinct().withColumn("main", F.lit(True)), "node", "left").join(loc, "node", "left")
    head = hit.agg(F.count("*").alias("n"), F.count("main").alias("m"), F.coalesce(F.sum("loc"), F.lit(0)).alias("l"), F.coalesce(F.max("depth"), F.lit(0)).alias("d"))
    named = (("Affected packages: ", "n"), ("Affected binaries: ", "m"), ("Lines of code: ", "l"), ("Depth: ", "d"))
    top = head.select(F.posexplode(F.array(*[F.concat(F.lit(k), F.col(c).cast("string")) for k, c in named])).alias("o", "value"))
    rows = hit.select(F.lit(9).alias("o"), F.concat(F.lit("  "), F.col("node").cast("string"), F.when(F.col("main"), " (binary)").otherwise("")).alias("value"))
    return top.unionByName(rows).orderBy("o", "value").select("value")


def capability_diff_lines(diffs: DataFrame) -> DataFrame:
    """Text lines of (package, added, removed, escalated): a mark for what escalates, a line per capability, a last one as a warning."""
    sign = lambda c, mark: F.transform(F.col(c), lambda x: F.concat(F.lit(f"    {mark} "), x))
    head = F.array(F.concat(F.when(F.col("escalated"), "! ").otherwise("  "), F.col("package").cast("string")))
    rows = diffs.select(F.lit(0).alias("o"), F.col("package").cast("string").alias("p"), F.posexplode(F.concat(head, sign("added", "+"), sign("removed", "-"))).alias("no", "value"))
    n = diffs.agg(F.count("*").alias("n"), F.coalesce(F.bool_or("escalated"), F.lit(False)).alias("bad"))
    last = n.select(F.lit(1).alias("o"), F.lit("").alias("p"), F.lit(0).alias("no"), F.when(F.col("n") == 0, "No capability changes.").when(F.col("bad"), "Capabilities escalate: review before upgrading").alias("value")).filter("value IS NOT NULL")
    return rows.unionByName(last).orderBy("o", "p", "no").select("value")


def health_band(score: Column) -> Column:
    return F.when(score < 40, "HIGH").when(score < 70, "MEDIUM").otherwise("LOW")


def sarif(capabilities: DataFrame, health: DataFrame) -> DataFrame:
    """SARIF results: an error per HIGH package (package, level, caps), a warning per health (module, score) below 40."""
    at = F.array(F.struct(F.struct(F.struct(F.lit("go.mod").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    result = lambda rule, level, text: F.struct(F.lit(rule).alias("ruleId"), F.lit(level).alias("level"), F.struct(text.alias("text")).alias("message"), at.alias("locations"))
    high = capabilities.filter("level = 'HIGH'").select(F.lit("high-risk-capability").alias("rule"), F.col("package").cast("string").alias("name"), F.to_json(result("high-risk-capability", "error", F.concat(F.col("package").cast("string"), F.lit(" can "), F.array_join("caps", ", ")))).alias("result"))
    low = health.filter("score < 40").select(F.lit("low-health").alias("rule"), F.col("module").cast("string").alias("name"), F.to_json(result("low-health", "warning", F.concat(F.col("module").cast("string"), F.lit(" has health "), F.col("score").cast("string")))).alias("result"))
    return high.unionByName(low)


def sarif_document(results: DataFrame, tool: str = "plumbline") -> DataFrame:
    head = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"' + tool + '"}},"results":['
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("rule", "name", "result"))), lambda x: x["result"])
    return results.agg(F.concat(F.lit(head), F.array_join(sorted_, ","), F.lit("]}]}")).alias("value"))


def components(modules: DataFrame, packages: DataFrame, sets: DataFrame, health: DataFrame, kind: str = "golang") -> DataFrame:
    """SBOM components: module, version, purl, capabilities of all its packages, largest risk, health. Mains are left out."""
    inside = packages.filter(~F.col("is_main") & F.col("module").isNotNull()).join(sets, "package", "left")
    per = inside.groupBy("module").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("caps")))).alias("capabilities"), F.max(S.risk_value(S.risk_level(F.col("score")))).alias("risk"))
    out = modules.join(per, "module").join(health.select("module", F.col("score").alias("health")), "module", "left")
    level = F.when(F.col("risk") == 3, "HIGH").when(F.col("risk") == 2, "MEDIUM").otherwise("LOW")
    return out.select("module", "version", S.purl(F.col("module").cast("string"), F.col("version"), kind).alias("purl"), "capabilities", level.alias("risk_level"), "health")


def cyclonedx(parts: DataFrame) -> DataFrame:
    """One CycloneDX 1.4 document."""
    prop = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    row = F.struct(F.lit("library").alias("type"), F.col("module").cast("string").alias("name"), "version", "purl", F.array(prop("capabilities", F.array_join("capabilities", ",")), prop("risk_level", F.col("risk_level")), prop("health_score", F.coalesce(F.col("health").cast("string"), F.lit("")))).alias("properties"))
    return parts.agg(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.4").alias("specVersion"), F.lit(1).alias("version"), F.array_sort(F.collect_list(row)).alias("components"))).alias("value"))


def subgraph(edges: DataFrame, levels: DataFrame, least: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, level, uses, used_by) of at least a risk level, and the edges among them; loops are dropped."""
    from ..operators.graph import degrees

    nodes = levels.filter(S.meets(F.col("level"), least))
    inside = edges.filter("src <> dst").join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    return nodes.join(degrees(edges), "node", "left").select("node", "level", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("used_by", F.lit(0)).alias("used_by")), inside


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph, in order."""
    colour = F.when(F.col("level") == "HIGH", "red").when(F.col("level") == "MEDIUM", "orange").otherwise("green")
    q = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    n = nodes.select(F.lit(1).alias("o"), F.concat(F.lit("  "), q(F.col("node")), F.lit(" [label="), q(S.short_label(F.col("node").cast("string"))), F.lit(", color="), colour, F.lit("];")).alias("value"))
    e = edges.select(F.lit(2).alias("o"), F.concat(F.lit("  "), q(F.col("src")), F.lit(" -> "), q(F.col("dst")), F.lit(";")).alias("value"))
    ends = nodes.sparkSession.createDataFrame([(0, "digraph deps {"), (3, "}")], "o int, value string")
    return n.unionByName(e).unionByName(ends).orderBy("o", "value").select("value")


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One document {nodes, links} for force layouts."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(F.col("node").cast("string").alias("id"), "level", "uses", "used_by"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target")))).alias("links"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "links")).alias("value"))


def html(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A page that holds the graph as data and lists its nodes."""
    rows = F.array_join(F.transform(F.from_json(F.get_json_object("value", "$.nodes"), "array<struct<id:string,level:string>>"), lambda x: F.concat(F.lit("<li class="), x["level"], F.lit(">"), x["id"], F.lit("</li>"))), "")
    return node_link(nodes, edges).select(F.concat(F.lit("<!doctype html><meta charset=utf-8><title>Dependencies</title><script id=graph type=application/json>"), F.regexp_replace("value", "</", "<\\\\/"), F.lit("</script><ul>"), rows, F.lit("</ul>")).alias("value"))


def markdown(changes: DataFrame) -> DataFrame:
    """Lines of a pull request comment from (package, change, old_version, new_version)."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    rows = changes.select(F.lit(1).alias("o"), F.concat(F.lit("| "), F.concat_ws(" | ", F.col("change"), cell("package"), cell("old_version"), cell("new_version")), F.lit(" |")).alias("value"))
    head = changes.sparkSession.createDataFrame([(0, "### Dependency changes"), (0, "| Change | Package | Before | After |"), (0, "|---|---|---|---|")], "o int, value string").withColumn("n", F.monotonically_increasing_id())
    return head.unionByName(rows.withColumn("n", F.lit(0).cast("long"))).orderBy("o", "n", "value").select("value")


def explained(top: DataFrame) -> DataFrame:
    """Lines per package and capability: the first pieces of evidence, and how many more there are."""
    text = F.concat(F.col("file").cast("string"), F.lit(":"), F.col("line").cast("string"), F.lit(" via "), F.col("via"))
    rows = top.groupBy("package", "capability").agg(F.max("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]).alias("shown"))
    more = F.col("total") - F.size("shown")
    return rows.select("package", "capability", F.concat(F.array_join("shown", "; "), F.when(more > 0, F.concat(F.lit(" (and "), more.cast("string"), F.lit(" more)"))).otherwise("")).alias("text"))


def checksum(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """16 hex digits that name a graph: modules (module, version, is_main) but the main one, and edges, in order.

    Text is escaped as JSON with <, > and & as code points.
    """
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<", "\\\\\\\\u003c"), ">", "\\\\\\\\u003e"), "&", "\\\\\\\\u0026")
    m = modules.filter(~F.col("is_main")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("module").cast("string").alias("module"), "version")))).alias("m"))
    e = edges.agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))))).alias("e"))
    return m.crossJoin(e).select(F.substring(F.sha2(esc(F.concat("m", "e")), 256), 1, 16).alias("checksum"))


def append_snapshot(history: DataFrame, snapshot: DataFrame, keep: int = RETENTION) -> DataFrame:
    """History with one more snapshot, its seq the next, of which the last ``keep`` stay."""
    last = history.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    new = snapshot.crossJoin(F.broadcast(last)).withColumn("seq", F.col("last") + 1).drop("last")
    both = history.unionByName(new, allowMissingColumns=True)
    kept = both.select("seq").distinct().orderBy(F.desc("seq")).limit(keep)
    return both.join(F.broadcast(kept), "seq", "left_semi")
