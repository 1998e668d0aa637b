"""All queries of the engine by name, with the SQL that gives the same rows.

Queries take (spark, sf_dir) and read the derived relations of ``derived``. Integers
come out as BIGINT or INT and doubles rounded to 6 places, alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import capset, compare, engines, graph, history, interproc, policy, score, taint
from .derived import oracle, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (get, spark) under a name; ``get`` reads a derived relation."""

    def add(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(lambda n: relation(spark, sf_dir, n), spark)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return make

    return add


def _r(c: str):
    return F.round(F.col(c), 6).alias(c)


def _per_cap(get) -> DataFrame:
    return capset.per_capability(get("d_evidence"))


def _taints(get) -> DataFrame:
    return taint.pairs(_per_cap(get))


# ---- capability sets -------------------------------------------------------------


@query("cap_set_build", "SELECT package, string_agg(capability, ',' ORDER BY capability) AS caps, CAST(sum(weight) AS BIGINT) AS score FROM d_percap JOIN capability ON name = capability GROUP BY package")
def _(get, spark):
    return capset.build(get("d_evidence")).select("package", capset.text(F.col("caps")).alias("caps"), "score")


@query("cap_set_merge", """SELECT package, string_agg(capability, ',' ORDER BY capability) AS caps, CAST(sum(weight) AS BIGINT) AS score
  FROM (SELECT DISTINCT package, capability FROM d_evidence WHERE via = 'import' OR confidence < 0.7) e JOIN capability ON name = capability GROUP BY package""")
def _(get, spark):
    e = get("d_evidence")
    return capset.build(capset.merge(e.filter("via = 'import'"), e.filter("confidence < 0.7"))).select("package", capset.text(F.col("caps")).alias("caps"), "score")


@query("cap_confidence", "SELECT package, capability, round(confidence, 6) AS confidence, n AS n_evidence FROM d_percap")
def _(get, spark):
    return _per_cap(get).select("package", "capability", _r("confidence"), "n_evidence")


@query("cap_accessors", "SELECT package, bool_or(capability = 'exec') AS has_exec, false AS is_empty, count(*) AS n FROM d_percap GROUP BY package")
def _(get, spark):
    c = F.col("caps")
    return capset.build(get("d_evidence")).select("package", capset.has(c, "exec").alias("has_exec"), capset.is_empty(c).alias("is_empty"), F.size(c).cast("long").alias("n"))


@query("role_classification", "SELECT role, count(*) AS n FROM d_evidence JOIN capability ON name = capability GROUP BY role")
def _(get, spark):
    return get("d_evidence").groupBy(S.role(F.col("capability")).alias("role")).agg(F.count("*").alias("n"))


@query("risk_levels", """SELECT package, score, CASE WHEN score >= 30 THEN 'HIGH' WHEN score >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  CASE WHEN score >= 30 THEN 3 WHEN score >= 10 THEN 2 ELSE 1 END AS value FROM d_sets""")
def _(get, spark):
    s = capset.build(get("d_evidence")).withColumn("level", S.risk_level(F.col("score")))
    return s.select("package", "score", "level", S.risk_value(F.col("level")).alias("value"))


@query("min_risk_filter", "SELECT package, score FROM d_sets WHERE score >= 10")
def _(get, spark):
    s = capset.build(get("d_evidence"))
    return s.filter(S.meets(S.risk_level(F.col("score")), "medium")).select("package", "score")


@query("hide_low_confidence", "SELECT package, string_agg(capability, ',' ORDER BY capability) AS caps FROM d_percap WHERE confidence >= 0.7 GROUP BY package")
def _(get, spark):
    kept = capset.hide_low_confidence(_per_cap(get), 0.7)
    return kept.groupBy("package").agg(F.array_join(F.array_sort(F.collect_list("capability")), ",").alias("caps"))


@query("capability_exceptions", """SELECT package, CAST(sum(weight) AS BIGINT) AS score FROM d_percap JOIN capability ON name = capability
  WHERE NOT (package % 10 = 0 AND capability IN ('exec', 'network')) GROUP BY package""")
def _(get, spark):
    ex = get("d_packages").filter("package % 10 = 0").select("package", F.explode(F.array(F.lit("EXEC"), F.lit("network"))).alias("capability"))
    return capset.build(capset.without(get("d_evidence"), ex)).select("package", "score")


@query("evidence_top3", """SELECT package, capability, file, line, via, round(confidence, 6) AS confidence, CAST(rank AS INT) AS rank, total FROM
  (SELECT *, row_number() OVER (PARTITION BY package, capability ORDER BY confidence DESC, file, line, via) AS rank, count(*) OVER (PARTITION BY package, capability) AS total FROM d_evidence) x WHERE rank <= 3""")
def _(get, spark):
    return capset.top_evidence(get("d_evidence")).select("package", "capability", "file", "line", "via", _r("confidence"), "rank", "total")


@query("module_max_score", "SELECT module, CAST(coalesce(max(score), 0) AS BIGINT) AS score FROM d_packages LEFT JOIN d_sets USING (package) WHERE module IS NOT NULL AND NOT is_main GROUP BY module")
def _(get, spark):
    return capset.module_max(capset.build(get("d_evidence")), get("d_packages"))


@query("module_argmax", """SELECT module, package, score FROM (SELECT module, package, score, row_number() OVER (PARTITION BY module ORDER BY score DESC, package) AS r
  FROM d_packages JOIN d_sets USING (package) WHERE module IS NOT NULL AND NOT is_main) x WHERE r = 1""")
def _(get, spark):
    return capset.module_argmax(capset.build(get("d_evidence")), get("d_packages"))


@query("pkg_module_left_join", "SELECT p.package, p.module, m.version FROM d_packages p LEFT JOIN d_modules m ON m.module = p.module")
def _(get, spark):
    return get("d_packages").join(get("d_modules"), "module", "left").select("package", "module", "version")


@query("explain_order", "SELECT module, score, capability, package FROM d_packages JOIN d_sets USING (package) JOIN d_percap USING (package) WHERE capability = 'exec' AND module IS NOT NULL ORDER BY module, score DESC, capability, package")
def _(get, spark):
    s, p = capset.build(get("d_evidence")), get("d_packages")
    rows = s.withColumn("capability", F.explode("caps")).filter("capability = 'exec'").join(p, "package").filter("module IS NOT NULL")
    return rows.select("module", "score", "capability", "package").orderBy("module", F.desc("score"), "capability", "package")


# ---- taint -----------------------------------------------------------------------


@query("taint_pairs", "SELECT package, source, sink, rule_risk FROM d_taint")
def _(get, spark):
    return _taints(get).select("package", "source", "sink", "rule_risk")


@query("taint_downgrade", "SELECT package, source, sink, risk, round(confidence, 6) AS confidence FROM d_taint")
def _(get, spark):
    return _taints(get).select("package", "source", "sink", "risk", _r("confidence"))


@query("taint_confidence_filter", "SELECT package, source, sink FROM d_taint WHERE confidence >= 0.75")
def _(get, spark):
    return taint.keep_confident(_taints(get), 0.75).select("package", "source", "sink")


@query("taint_exceptions", "SELECT package, source, sink, risk FROM d_taint WHERE NOT (package % 7 = 0 AND source = 'network' AND sink = 'exec')")
def _(get, spark):
    ex = get("d_packages").filter("package % 7 = 0").select("package", F.lit("network").alias("source"), F.lit("exec").alias("sink"))
    return taint.suppressed(_taints(get), ex).select("package", "source", "sink", "risk")


@query("taint_counts", "SELECT package, n, CAST(high AS BIGINT) AS high, CAST(medium AS BIGINT) AS medium FROM d_tcounts")
def _(get, spark):
    return taint.counts(_taints(get))


@query("finding_order", "SELECT package, source, sink, risk FROM d_taint ORDER BY CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, package, source, sink")
def _(get, spark):
    return taint.ordered(_taints(get)).select("package", "source", "sink", "risk")


@query("finding_dedupe", """SELECT module, source, sink, risk FROM (SELECT module, source, sink, risk, row_number() OVER (PARTITION BY module, source, sink
  ORDER BY CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, t.package) AS r FROM d_taint t JOIN d_packages p ON p.package = t.package WHERE module IS NOT NULL) x WHERE r = 1""")
def _(get, spark):
    f = _taints(get).join(get("d_packages"), "package").filter("module IS NOT NULL")
    f = f.select(F.col("module").alias("package"), F.col("package").alias("p"), "source", "sink", "risk")
    return taint.first_of_each(f, "p").select(F.col("package").alias("module"), "source", "sink", "risk")


# ---- scores and policy -----------------------------------------------------------

_REACH = "CASE WHEN reachable THEN 1.3 WHEN NOT reachable THEN 0.5 ELSE 1.0 END"
_TAINT = "(1.0 + 0.25 * coalesce(high, 0) + 0.15 * coalesce(medium, 0))"
_SEM = f"least(100.0, CAST(score AS DOUBLE) * {_REACH} * {_TAINT})"
_JOINED = "d_sets LEFT JOIN d_tcounts USING (package) LEFT JOIN d_hints USING (package)"
_LEVEL = lambda c: f"CASE WHEN {c} >= 30 THEN 'HIGH' WHEN {c} >= 10 THEN 'MEDIUM' ELSE 'LOW' END"
_ENGINES = (3.0, 2.0, 5.0)


@query("composite_score", f"""SELECT package, score AS cap_score, round(v, 6) AS composite, {_LEVEL('v')} AS level FROM
  (SELECT package, score, CAST(least(100.0, CAST(score AS DOUBLE) * {_REACH} * least(2.0, 1.0 + 0.3 * coalesce(n_cve, 0)) * {_TAINT}) AS DOUBLE) AS v FROM {_JOINED} LEFT JOIN d_cves USING (package)) x""")
def _(get, spark):
    c = score.composite(capset.build(get("d_evidence")), taint.counts(_taints(get)), get("d_hints"), get("d_cves"))
    return c.select("package", "cap_score", _r("composite"), "level")


def _final(get, spark) -> DataFrame:
    eng = spark.createDataFrame([_ENGINES], "diff double, integrity double, topology double")
    return score.final(capset.build(get("d_evidence")), taint.counts(_taints(get)), get("d_hints"), eng)


_FINAL = f"(SELECT package, score, CAST({_SEM} AS DOUBLE) AS semantic, CAST(least(100.0, {_SEM} + {sum(_ENGINES)}) AS DOUBLE) AS final FROM {_JOINED}) x"


@query("final_score", f"SELECT package, score, round(semantic, 6) AS semantic, round(final, 6) AS final, {_LEVEL('final')} AS level FROM {_FINAL}")
def _(get, spark):
    return _final(get, spark).select("package", "score", _r("semantic"), _r("final"), "level")


@query("final_score_sdk", f"""SELECT package, round(CAST(least(100.0, CAST(score AS DOUBLE) * CASE WHEN reachable THEN 1.3 ELSE 0.5 END * {_TAINT}) AS DOUBLE), 6) AS semantic FROM {_JOINED}""")
def _(get, spark):
    eng = spark.createDataFrame([(0.0, 0.0, 0.0)], "diff double, integrity double, topology double")
    return score.final(capset.build(get("d_evidence")), taint.counts(_taints(get)), get("d_hints"), eng, unknown_as_false=True).select("package", _r("semantic"))


@query("top_n", f"SELECT package, score FROM {_FINAL} ORDER BY score DESC, package LIMIT 25")
def _(get, spark):
    return _final(get, spark).select("package", "score").orderBy(F.desc("score"), "package").limit(25)


@query("graph_order", f"""SELECT module, round(max(final), 6) AS final FROM {_FINAL} JOIN d_packages USING (package) WHERE module IS NOT NULL GROUP BY module ORDER BY max(final) DESC, module""")
def _(get, spark):
    f = _final(get, spark).join(get("d_packages"), "package").filter("module IS NOT NULL").groupBy("module").agg(F.max("final").alias("final"))
    return f.orderBy(F.desc("final"), "module").select("module", _r("final"))


@query("policy_verdict", f"""WITH f AS (SELECT package, {_LEVEL('final')} AS level FROM {_FINAL}),
bad AS (SELECT package, 0 AS o, 'risk HIGH in package ' || package AS reason FROM f WHERE level = 'HIGH'
  UNION ALL SELECT package, 1, 'denied capability ' || capability || ' in package ' || package FROM d_percap WHERE capability IN ('unsafe', 'plugin') AND package % 2 = 1)
SELECT count(*) = 0 AS passed, count(*) AS n_failing, coalesce((SELECT reason FROM bad ORDER BY package, o, reason LIMIT 1), '') AS reason FROM bad""")
def _(get, spark):
    deny = spark.createDataFrame([("unsafe",), ("plugin",)], "capability string")
    ex = get("d_packages").filter("package % 2 = 0").select("package", F.explode(F.array(F.lit("unsafe"), F.lit("plugin"))).alias("capability"))
    return score.verdict(_final(get, spark), policy.denied(_per_cap(get), deny, ex))


@query("deny_caps_semijoin", "SELECT package, capability FROM d_percap WHERE capability IN ('unsafe', 'plugin') AND package % 2 = 1")
def _(get, spark):
    deny = spark.createDataFrame([("unsafe",), ("plugin",)], "capability string")
    ex = get("d_packages").filter("package % 2 = 0").select("package", F.explode(F.array(F.lit("unsafe"), F.lit("plugin"))).alias("capability"))
    return policy.denied(_per_cap(get), deny, ex)


_PATTERNS = ["brand/11/*", "brand/23/economy/*", "brand/33/promo/anodized/tin/7"]
_PSQL = " OR ".join(f"name = '{p.removesuffix('/*')}'" + (f" OR starts_with(name, '{p[:-1]}')" if p.endswith("/*") else "") for p in _PATTERNS)


@query("policy_exclude_antijoin", f"SELECT package, name FROM d_names WHERE NOT ({_PSQL})")
def _(get, spark):
    return policy.excluded(get("d_names"), spark.createDataFrame([(p,) for p in _PATTERNS], "pattern string")).select("package", "name")


@query("focus_filter", "SELECT package, name FROM d_names WHERE name = 'brand/12' OR starts_with(name, 'brand/12/')")
def _(get, spark):
    return policy.in_focus(get("d_names"), "brand/12", "name").select("package", "name")


_EXC = """SELECT package, CASE package % 5 WHEN 0 THEN NULL WHEN 1 THEN '2020-01-31' WHEN 2 THEN '2099-12-31' WHEN 3 THEN 'soon' ELSE '' END AS expires, CASE WHEN package % 2 = 0 THEN 'env>exec' END AS taint FROM d_packages"""


def _exceptions(get) -> DataFrame:
    k = F.col("package") % 5
    return get("d_packages").select("package", F.when(k == 1, "2020-01-31").when(k == 2, "2099-12-31").when(k == 3, "soon").when(k == 4, "").alias("expires"), F.when(F.col("package") % 2 == 0, "env>exec").alias("taint"))


@query("exception_expiry", f"SELECT package FROM ({_EXC}) x WHERE expires IS NULL OR expires = '' OR try_cast(expires AS DATE) >= DATE '2026-01-01'")
def _(get, spark):
    return policy.active(_exceptions(get), F.lit("2026-01-01").cast("timestamp")).select("package")


@query("exception_stats", f"""SELECT count(*) FILTER (expires IS NULL OR expires IN ('', '2099-12-31')) AS applied, count(*) FILTER (expires = '2020-01-31') AS expired,
  count(*) FILTER (expires = 'soon') AS unreadable, count(taint) AS taint FROM ({_EXC}) x""")
def _(get, spark):
    return policy.stats(_exceptions(get), F.lit("2026-01-01").cast("timestamp"))


# ---- comparisons -----------------------------------------------------------------


@query("new_packages", "SELECT package, version FROM d_head WHERE package NOT IN (SELECT package FROM d_base)")
def _(get, spark):
    return compare.new_packages(get("d_head"), get("d_base"))


_CHANGES = """(SELECT package, old_version, new_version, CASE WHEN old_version IS NULL THEN 'added' WHEN new_version IS NULL THEN 'removed' ELSE 'updated' END AS change FROM
  (SELECT coalesce(b.package, h.package) AS package, b.version AS old_version, h.version AS new_version FROM d_base b FULL JOIN d_head h ON h.package = b.package) y WHERE old_version IS DISTINCT FROM new_version) c"""


@query("pr_diff", f"SELECT package, old_version, new_version, change FROM {_CHANGES}")
def _(get, spark):
    return compare.versions(get("d_base"), get("d_head"))


def _cap_sets(get, even: bool) -> DataFrame:
    return capset.build(get("d_evidence").filter(F.col("file") % 2 == (0 if even else 1)))


_DIFF = """(WITH o AS (SELECT DISTINCT package, capability FROM d_evidence WHERE file % 2 = 0), n AS (SELECT DISTINCT package, capability FROM d_evidence WHERE file % 2 = 1),
  a AS (SELECT package, string_agg(capability, ',' ORDER BY capability) AS added, bool_or(capability IN ('exec', 'network', 'unsafe', 'plugin')) AS escalated FROM (SELECT * FROM n EXCEPT SELECT * FROM o) y GROUP BY package),
  r AS (SELECT package, string_agg(capability, ',' ORDER BY capability) AS removed FROM (SELECT * FROM o EXCEPT SELECT * FROM n) y GROUP BY package)
  SELECT coalesce(a.package, r.package) AS package, coalesce(added, '') AS added, coalesce(removed, '') AS removed, coalesce(escalated, false) AS escalated FROM a FULL JOIN r ON a.package = r.package) d"""


@query("cap_diff", f"SELECT package, added, removed, escalated FROM {_DIFF}")
def _(get, spark):
    d = compare.capabilities(_cap_sets(get, True), _cap_sets(get, False))
    return d.select("package", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), "escalated")


@query("snapshot_diff", """WITH s AS (SELECT max(seq) AS m FROM d_levels), o AS (SELECT l.* FROM d_levels l, s WHERE seq = m - 1), n AS (SELECT l.* FROM d_levels l, s WHERE seq = m)
SELECT coalesce(o.module, n.module) AS module, o.score AS old_score, o.level AS old_level, n.score AS new_score, n.level AS new_level,
  CASE WHEN o.score IS NULL THEN 'added' WHEN n.score IS NULL THEN 'removed' WHEN n.score > o.score THEN 'escalated' WHEN n.score < o.score THEN 'improved' ELSE 'unchanged' END AS change
FROM o FULL JOIN n ON o.module = n.module""")
def _(get, spark):
    return compare.snapshots(*history.pair(_levels(get)))


_GUESS = "CASE WHEN lower(name) LIKE '%exec%' OR lower(name) LIKE '%process%' THEN 'HIGH' WHEN lower(name) LIKE '%net%' OR lower(name) LIKE '%http%' OR lower(name) LIKE '%grpc%' OR lower(name) LIKE '%crypto%' OR lower(name) LIKE '%tls%' THEN 'MEDIUM' ELSE 'LOW' END"


def _named(get) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("exec", "http", "tls", "plain", "process", "x")])
    return compare.versions(get("d_base"), get("d_head")).withColumn("package", F.concat(F.element_at(words, (F.col("package") % 6 + 1).cast("int")), F.lit("/"), F.col("package").cast("string")))


_NAMEDSQL = f"(SELECT CASE package % 6 WHEN 0 THEN 'exec' WHEN 1 THEN 'http' WHEN 2 THEN 'tls' WHEN 3 THEN 'plain' WHEN 4 THEN 'process' ELSE 'x' END || '/' || package AS name, change FROM {_CHANGES}) q"
_DELTA = f"CASE WHEN change <> 'added' THEN 0 WHEN ({_GUESS}) = 'HIGH' THEN 15 WHEN ({_GUESS}) = 'MEDIUM' THEN 8 ELSE 0 END"


@query("inferred_caps", f"SELECT name AS package, change, {_GUESS} AS level, {_DELTA} AS delta FROM {_NAMEDSQL}")
def _(get, spark):
    return compare.risk_deltas(_named(get)).select("package", "change", "level", "delta")


@query("diff_score", f"SELECT CAST(least(20, coalesce(sum({_DELTA}), 0)) AS BIGINT) AS score FROM {_NAMEDSQL}")
def _(get, spark):
    return compare.capped_sum(compare.risk_deltas(_named(get)), "delta")


@query("package_diff_score", f"""SELECT n.package, CAST(coalesce(sum(d), 0) AS BIGINT) AS diff_score FROM (SELECT name || '@v' || length(name) AS v, name, {_DELTA} AS d FROM {_NAMEDSQL}) x
  RIGHT JOIN (SELECT name AS package FROM {_NAMEDSQL}) n ON x.v = n.package OR starts_with(x.v, n.package || '@') GROUP BY n.package""")
def _(get, spark):
    d = compare.risk_deltas(_named(get)).select("package", "delta")
    return compare.package_diff_score(d.select("package"), d.withColumn("package", F.concat("package", F.lit("@v"), F.length("package"))))


@query("graph_merge", """SELECT src, dst FROM d_edges64 WHERE dst % 3 = 0 UNION ALL
  SELECT src, dst FROM d_edges16 WHERE dst % 2 = 0 AND src NOT IN (SELECT src FROM d_edges64 WHERE dst % 3 = 0)""")
def _(get, spark):
    return compare.merged(get("d_edges16").filter("dst % 2 = 0"), get("d_edges64").filter("dst % 3 = 0"), "src")


@query("new_transitive", """WITH RECURSIVE o AS (SELECT node FROM d_mains WHERE node % 2 = 0 UNION SELECT dst FROM o JOIN d_dag16 ON src = o.node),
n AS (SELECT node FROM d_mains UNION SELECT dst FROM n JOIN d_dag16 ON src = n.node) SELECT node FROM n EXCEPT SELECT node FROM o""")
def _(get, spark):
    e, m = get("d_dag16"), get("d_mains")
    return graph.closure(e, m).join(graph.closure(e, m.filter("node % 2 = 0")), "node", "left_anti")


@query("breaking_changes", """SELECT b.package, 'v' || b.version AS symbol, b.version % 7 AS old_type, h.version % 7 AS new_type, CASE WHEN h.package IS NULL THEN 'removed' ELSE 'type changed' END AS change
  FROM d_base b LEFT JOIN d_head h ON h.package = b.package AND h.version = b.version WHERE h.package IS NULL""")
def _(get, spark):
    def table(n):
        return get(n).select("package", F.concat(F.lit("v"), "version").alias("symbol"), (F.col("version") % 7).alias("type"))

    return compare.symbols(table("d_base"), table("d_head")).select("package", "symbol", F.col("type").alias("old_type"), "new_type", "change")


# ---- history ---------------------------------------------------------------------


def _levels(get) -> DataFrame:
    return get("d_snapshots").withColumn("level", S.risk_level(F.col("score")))


@query("snapshot_levels", "SELECT seq, count(*) FILTER (level = 'HIGH') AS high, count(*) FILTER (level = 'MEDIUM') AS medium, count(*) FILTER (level = 'LOW') AS low FROM d_levels GROUP BY seq")
def _(get, spark):
    return history.levels(_levels(get))


@query("high_delta", "SELECT seq, high, high - lag(high) OVER (ORDER BY seq) AS delta FROM (SELECT seq, count(*) FILTER (level = 'HIGH') AS high FROM d_levels GROUP BY seq) x")
def _(get, spark):
    return history.high_delta(_levels(get))


_TREND = """(WITH q AS (SELECT DISTINCT seq FROM d_levels ORDER BY seq DESC LIMIT 10), m AS (SELECT DISTINCT module FROM d_levels JOIN q USING (seq)),
  g AS (SELECT module, seq, coalesce(score, 0) AS score FROM m CROSS JOIN q LEFT JOIN d_levels USING (module, seq))
  SELECT module, list(score ORDER BY seq) AS s FROM g GROUP BY module) t"""


@query("trend_grid", f"SELECT module, array_to_string(s, ',') AS scores, s[1] AS first, s[-1] AS last, s[-1] - s[1] AS change FROM {_TREND}")
def _(get, spark):
    return history.trend(_levels(get)).select("module", F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"), "first", "last", "change")


@query("sparkline", f"SELECT module, list_aggregate(list_transform(s, lambda x: '▁▂▃▄▅▆▇█'[CAST(greatest(0, least(7, x * 7 // 100)) AS INT) + 1]), 'string_agg', '') AS spark FROM {_TREND}")
def _(get, spark):
    return history.trend(_levels(get)).select("module", "spark")


@query("retention", "SELECT seq, module, score, level FROM d_levels WHERE seq > (SELECT max(seq) - 20 FROM d_levels)")
def _(get, spark):
    return history.retained(_levels(get), 20).select("seq", "module", "score", "level")


@query("churn_90d", "SELECT count(DISTINCT event_id % 977) AS churn FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-03-01' - INTERVAL 90 DAY")
def _(get, spark):
    c = get("events").filter("event_type = 'click'").select("ts", (F.col("event_id") % 977).alias("commit"))
    return engines.churn(c, F.lit("2024-03-01").cast("date"))


# ---- engines ---------------------------------------------------------------------

_NPM = """(SELECT project, package, 'missing_integrity' AS type, CASE WHEN 2 * row_number() OVER (PARTITION BY project ORDER BY package) <= 10 THEN 2 ELSE 0 END AS points
   FROM d_lock WHERE integrity = '' AND NOT starts_with(resolved, 'file:') AND NOT starts_with(resolved, 'git+')
  UNION ALL SELECT project, package, 'path_dep', 5 FROM d_lock WHERE starts_with(resolved, 'file:') UNION ALL SELECT project, package, 'git_dep', 8 FROM d_lock WHERE starts_with(resolved, 'git+')) v"""


@query("integrity_budget", f"SELECT project, package, type, points FROM {_NPM}")
def _(get, spark):
    return engines.npm_integrity(get("d_lock"))


@query("integrity_score", f"SELECT project, CAST(least(20, sum(points)) AS BIGINT) AS score FROM {_NPM} GROUP BY project")
def _(get, spark):
    return engines.npm_integrity(get("d_lock")).groupBy("project").agg(F.least(F.lit(20), F.sum("points")).cast("long").alias("score"))


@query("integrity_coverage", "SELECT count(*) AS total, count(h.package) AS covered, round(count(h.package) * 100.0 / count(*), 6) AS pct FROM d_base b LEFT JOIN (SELECT DISTINCT package FROM d_head) h USING (package)")
def _(get, spark):
    return engines.coverage(get("d_base"), get("d_head")).select("total", "covered", _r("pct"))


@query("integrity_go", """SELECT CAST(package AS STRING) AS package, 'missing_checksum' AS type, 5 AS points FROM d_base WHERE package NOT IN (SELECT package FROM d_head)
  UNION ALL SELECT CAST(package AS STRING), 'git_replace', 8 FROM d_base WHERE package % 50 = 0 UNION ALL SELECT CAST(package AS STRING), 'local_replace', 6 FROM d_base WHERE package % 50 = 1""")
def _(get, spark):
    base = get("d_base").select(F.col("package").cast("string").alias("package"), F.col("package").alias("k"))
    target = F.when(F.col("k") % 50 == 0, "github.com/a/b").when(F.col("k") % 50 == 1, "../local").otherwise("example.org/c")
    return engines.go_integrity(base.select("package"), get("d_head").select(F.col("package").cast("string").alias("package")), base.select("package", target.alias("target")))


_DEPTH = "(WITH RECURSIVE w AS (SELECT node, 0 AS depth FROM d_mains UNION SELECT dst, depth + 1 FROM w JOIN {e} ON src = w.node WHERE depth < {n}) SELECT node, min(depth) AS depth FROM w GROUP BY node) bfs"
_METRICS = f"""(SELECT (SELECT count(DISTINCT dst) FROM d_edges16 JOIN d_mains ON src = node) AS direct, (SELECT count(*) FROM {_DEPTH.format(e='d_edges16', n=40)}) AS total,
  (SELECT CAST(max(depth) AS BIGINT) FROM {_DEPTH.format(e='d_edges16', n=40)}) AS max_depth, (SELECT avg(CASE WHEN depth >= 4 THEN 100.0 ELSE 0.0 END) FROM {_DEPTH.format(e='d_edges16', n=40)}) AS deep_pct,
  (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_orderkey % 64 = 0 GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1) x) AS duplicates,
  (SELECT max(n) FROM (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_orderkey % 64 = 0 GROUP BY l_partkey) x) AS skew) m"""


def _metrics(get) -> DataFrame:
    e, m = get("d_edges16"), get("d_mains")
    direct = e.join(m.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("package"))
    v = get("lineitem").filter("l_orderkey % 64 = 0").select(F.col("l_partkey").alias("base"), F.col("l_suppkey").alias("version"))
    return engines.topology_metrics(graph.bfs(e, m).withColumnRenamed("node", "package"), direct, v, 5)


@query("topology_metrics", f"SELECT direct, total, max_depth, round(deep_pct, 6) AS deep_pct, skew, duplicates, CAST(5 AS BIGINT) AS churn FROM {_METRICS}")
def _(get, spark):
    return _metrics(get).select("direct", "total", "max_depth", _r("deep_pct"), "skew", "duplicates", "churn")


@query("topology_signals", f"""SELECT signal, round(value, 6) AS value, points FROM (
  SELECT 'direct' AS signal, CAST(direct AS DOUBLE) AS value, CAST(CASE WHEN direct > 100 THEN 8 WHEN direct >= 50 THEN 5 WHEN direct >= 20 THEN 2 ELSE 0 END AS BIGINT) AS points FROM {_METRICS}
  UNION ALL SELECT 'deep_pct', deep_pct, CASE WHEN deep_pct > 60 THEN 5 WHEN deep_pct >= 30 THEN 2 ELSE 0 END FROM {_METRICS}
  UNION ALL SELECT 'skew', skew, CASE WHEN skew > 8 THEN 3 WHEN skew >= 3 THEN 2 ELSE 0 END FROM {_METRICS}
  UNION ALL SELECT 'duplicates', duplicates, CASE WHEN duplicates > 10 THEN 3 WHEN duplicates >= 3 THEN 2 ELSE 0 END FROM {_METRICS}
  UNION ALL SELECT 'churn', 5, 2) s""")
def _(get, spark):
    return engines.topology_signals(_metrics(get)).select("signal", _r("value"), "points")


@query("duplicate_versions", "SELECT package, n FROM (SELECT l_partkey AS package, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_orderkey % 64 = 0 GROUP BY l_partkey) x WHERE n > 1")
def _(get, spark):
    v = get("lineitem").filter("l_orderkey % 64 = 0")
    return v.groupBy(F.col("l_partkey").alias("package")).agg(F.count_distinct("l_suppkey").alias("n")).filter("n > 1")


_LIC = "CASE module % 6 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-3.0' WHEN 2 THEN 'CCDL-1.0' WHEN 3 THEN 'Apache-2.0' WHEN 4 THEN 'CDDL-1.0' END"


@query("license_risk", f"""SELECT module, coalesce({_LIC}, 'unknown') AS license, coalesce({_LIC} IN ('GPL-3.0', 'CCDL-1.0'), true) AS risky,
  CASE WHEN {_LIC} IS NULL THEN 'license unknown' WHEN {_LIC} = 'GPL-3.0' THEN 'copyleft license: GPL-3.0' WHEN {_LIC} = 'CCDL-1.0' THEN 'copyleft license: CDDL-1.0' ELSE '' END AS reason FROM d_modules""")
def _(get, spark):
    k = F.col("module") % 6
    lic = get("d_modules").select("module", F.when(k == 0, "MIT").when(k == 1, "GPL-3.0").when(k == 2, "CCDL-1.0").when(k == 3, "Apache-2.0").when(k == 4, "CDDL-1.0").alias("license")).dropna()
    return engines.license_risk(get("d_modules"), lic)


@query("health_score", """SELECT module, CAST(least(100, greatest(0, 100 + a + g + r + c)) AS INT) AS score, a AS archived_points, g AS age_points, r AS release_points, c AS cve_points FROM
  (SELECT module, CASE WHEN module % 11 = 0 THEN -50 ELSE 0 END AS a, CASE WHEN module % 4 = 0 THEN 0 WHEN module * 9 > 730 THEN -30 WHEN module * 9 > 365 THEN -15 WHEN module * 9 > 180 THEN -5 ELSE 0 END AS g,
   CASE WHEN module % 4 = 0 THEN 0 WHEN module % 7 >= 5 THEN 15 WHEN module % 7 >= 2 THEN 8 WHEN module % 7 = 1 THEN 3 ELSE 0 END AS r, CAST(-30 * (module % 3) AS INT) AS c
   FROM (SELECT module FROM d_modules) y) x""")
def _(get, spark):
    m = get("d_modules").select("module")
    today = F.lit("2026-01-01").cast("date")
    repos = m.select("module", (F.col("module") % 11 == 0).alias("archived"), F.when(F.col("module") % 4 != 0, F.date_sub(today, (F.col("module") * 9).cast("int"))).alias("pushed"))
    times = lambda k: m.filter(F.col("module") % k > 0).select("module", F.explode(F.sequence(F.lit(1), (F.col("module") % k).cast("int"))).alias("n"))
    return engines.health(m, repos, times(7), times(3), today)


# ---- graphs ----------------------------------------------------------------------


@query("reverse_edges", "SELECT dst AS src, src AS dst FROM d_edges16")
def _(get, spark):
    return graph.reverse(get("d_edges16"))


@query("node_degree", """SELECT coalesce(a.node, b.node) AS node, coalesce(uses, 0) AS uses, coalesce(used_by, 0) AS used_by FROM (SELECT src AS node, count(*) AS uses FROM d_edges1 GROUP BY src) a
  FULL JOIN (SELECT dst AS node, count(*) AS used_by FROM d_edges1 GROUP BY dst) b ON a.node = b.node""")
def _(get, spark):
    return graph.degrees(get("d_edges1"))


@query("module_edges", "SELECT DISTINCT a.module AS src, b.module AS dst FROM d_edges16 e JOIN d_packages a ON a.package = e.src JOIN d_packages b ON b.package = e.dst WHERE a.module <> b.module")
def _(get, spark):
    return graph.module_edges(get("d_edges16"), get("d_packages"))


@query("bfs_depth", f"SELECT node, depth FROM {_DEPTH.format(e='d_edges1', n=12)}")
def _(get, spark):
    return graph.bfs(get("d_edges1"), get("d_mains"))


@query("reach_closure", "WITH RECURSIVE w AS (SELECT node FROM d_mains UNION SELECT dst FROM w JOIN d_edges1 ON src = w.node) SELECT node FROM w")
def _(get, spark):
    return graph.closure(get("d_edges1"), get("d_mains"))


_IMPACT = "(WITH RECURSIVE w AS (SELECT package AS node, 0 AS depth FROM d_packages WHERE module % 10 = 3 UNION SELECT e.src, depth + 1 FROM w JOIN d_dag16 e ON e.dst = w.node WHERE e.src NOT IN (SELECT package FROM d_packages WHERE module % 10 = 3)) SELECT node, max(depth) AS depth FROM w WHERE depth > 0 GROUP BY node) i"


@query("impact_depth", f"SELECT node, depth FROM {_IMPACT}")
def _(get, spark):
    return graph.impact(get("d_dag16"), get("d_packages").filter("module % 10 = 3").select(F.col("package").alias("node")))


@query("impact_affected", f"SELECT count(*) AS packages, count(*) FILTER (is_main) AS mains, max(depth) AS depth FROM {_IMPACT} JOIN d_packages ON package = node")
def _(get, spark):
    i = graph.impact(get("d_dag16"), get("d_packages").filter("module % 10 = 3").select(F.col("package").alias("node")))
    return i.join(get("d_packages"), F.col("node") == F.col("package")).agg(F.count("*").alias("packages"), F.count_if("is_main").alias("mains"), F.max("depth").alias("depth"))


@query("roots_leaves", """SELECT node, 'root' AS kind FROM (SELECT src AS node FROM d_dag64 EXCEPT SELECT dst FROM d_dag64) a
  UNION ALL SELECT node, 'leaf' FROM (SELECT dst AS node FROM d_dag64 EXCEPT SELECT src FROM d_dag64) b""")
def _(get, spark):
    e = get("d_dag64")
    return graph.roots(e).withColumn("kind", F.lit("root")).unionByName(graph.leaves(e).withColumn("kind", F.lit("leaf")))


@query("topological_levels", "WITH RECURSIVE w AS (SELECT node, 0 AS depth FROM (SELECT src AS node FROM d_dag16 EXCEPT SELECT dst FROM d_dag16) r UNION SELECT dst, depth + 1 FROM w JOIN d_dag16 ON src = w.node) SELECT node, max(depth) AS depth FROM w GROUP BY node")
def _(get, spark):
    return graph.levels(get("d_dag16"))


@query("scc_members", """WITH RECURSIVE w AS (SELECT src AS a, dst AS b FROM d_edges64 UNION SELECT a, dst FROM w JOIN d_edges64 ON src = w.b)
SELECT x.a AS node, min(x.b) AS scc FROM w x JOIN w y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def _(get, spark):
    return graph.components(get("d_edges64"))


@query("transitive_score")
def _(get, spark):
    sets = capset.module_max(capset.build(get("d_evidence")), get("d_packages"))
    return graph.transitive_scores(sets, graph.module_edges(get("d_edges64"), get("d_packages")))


@query("module_risk")
def _(get, spark):
    p = get("d_packages")
    t = graph.transitive_scores(capset.module_max(capset.build(get("d_evidence")), p), graph.module_edges(get("d_edges64"), p))
    depth = graph.bfs(get("d_edges1"), get("d_mains")).join(p.filter("NOT is_main"), F.col("node") == F.col("package")).groupBy("module").agg(F.max("depth").alias("depth"))
    return t.join(depth, "module", "left").select("module", "direct", "transitive", "effective", F.coalesce("depth", F.lit(0)).alias("depth"), S.risk_level(F.col("effective")).alias("level"))


# ---- interprocedural -------------------------------------------------------------


def _calls(get) -> DataFrame:
    return get("d_edges64").select(F.col("src").alias("caller"), F.col("dst").alias("callee"))


def _direct(get) -> DataFrame:
    return get("d_evidence").filter("package % 4 = 0").select(F.col("package").alias("fn"), "capability", "confidence")


def _summaries(get):
    nodes, edges = interproc.contexts(get("d_functions"), _calls(get))
    caps, states = interproc.summaries(nodes, edges, _direct(get))
    return nodes, edges, caps, states


_ENTRIES = "(SELECT DISTINCT fn FROM d_functions WHERE name = 'main' OR (fn IN (SELECT src FROM d_edges64) AND fn NOT IN (SELECT dst FROM d_edges64))) e"
_REACHED = f"r AS (SELECT fn FROM {_ENTRIES} UNION SELECT dst FROM r JOIN d_edges64 ON src = r.fn)"


@query("entry_functions", f"SELECT fn FROM {_ENTRIES}")
def _(get, spark):
    return interproc.entries(get("d_functions"), _calls(get))


@query("cfa_nodes", f"WITH RECURSIVE {_REACHED} SELECT fn || '@<entry>' AS node, fn, CAST(NULL AS BIGINT) AS context FROM {_ENTRIES} UNION SELECT dst || '@' || src, dst, src FROM d_edges64 WHERE src IN (SELECT fn FROM r)")
def _(get, spark):
    return interproc.contexts(get("d_functions"), _calls(get))[0]


@query("cfa_edges", f"""WITH RECURSIVE {_REACHED}, n AS (SELECT fn || '@<entry>' AS node, fn FROM {_ENTRIES} UNION SELECT dst || '@' || src, dst FROM d_edges64 WHERE src IN (SELECT fn FROM r))
SELECT n.node AS src, g.dst || '@' || g.src AS dst FROM n JOIN d_edges64 g ON g.src = n.fn""")
def _(get, spark):
    return interproc.contexts(get("d_functions"), _calls(get))[1]


@query("hop_propagation", """WITH c AS (SELECT DISTINCT a.fn AS caller, b.fn AS callee FROM d_edges16 e JOIN d_functions a ON a.fn = e.src JOIN d_functions b ON b.fn = e.dst WHERE a.package % 4 = b.package % 4),
d0 AS (SELECT package AS fn, capability, max(confidence) AS c FROM d_evidence WHERE package % 4 = 0 GROUP BY ALL),
d1 AS (SELECT caller AS fn, capability, max(c) * 0.7 AS c FROM c JOIN d0 ON callee = fn WHERE NOT EXISTS (SELECT 1 FROM d0 x WHERE x.fn = caller AND x.capability = d0.capability) GROUP BY ALL),
d2 AS (SELECT caller AS fn, capability, max(c) * 0.55 / 0.7 AS c FROM c JOIN d1 ON callee = fn WHERE NOT EXISTS (SELECT 1 FROM (SELECT fn, capability FROM d0 UNION ALL SELECT fn, capability FROM d1) x WHERE x.fn = caller AND x.capability = d1.capability) GROUP BY ALL),
d3 AS (SELECT caller AS fn, capability, max(c) * 0.4 / 0.55 AS c FROM c JOIN d2 ON callee = fn WHERE NOT EXISTS (SELECT 1 FROM (SELECT fn, capability FROM d0 UNION ALL SELECT fn, capability FROM d1 UNION ALL SELECT fn, capability FROM d2) x WHERE x.fn = caller AND x.capability = d2.capability) GROUP BY ALL)
SELECT fn, capability, 1 AS hops, round(c, 6) AS confidence FROM d1 UNION ALL SELECT fn, capability, 2, round(c, 6) FROM d2 UNION ALL SELECT fn, capability, 3, round(c, 6) FROM d3""")
def _(get, spark):
    f = get("d_functions").withColumn("package", F.col("package") % 4)
    calls = get("d_edges16").select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    return interproc.within_package(f, calls, _direct(get)).select("fn", "capability", "hops", _r("confidence"))


@query("summary_fixpoint")
def _(get, spark):
    nodes, edges, caps, states = _summaries(get)
    return caps.join(states.select("node", "depth", F.round("confidence", 6).alias("node_confidence")), "node").select("node", "kind", "capability", _r("confidence"), "depth", "node_confidence")


@query("interproc_taint")
def _(get, spark):
    nodes, edges, caps, states = _summaries(get)
    return interproc.findings(nodes, caps, states, get("d_functions")).select("package", "node", "source", "sink", "risk", _r("confidence"))


@query("taint_paths")
def _(get, spark):
    nodes, edges, caps, states = _summaries(get)
    found = interproc.findings(nodes, caps, states, get("d_functions"))
    return interproc.traced(found, edges, caps).select("package", "node", "source", "sink", "risk", F.array_join("path", " > ").alias("path"), "uncertain", "sanitized")


@query("reach_hints")
def _(get, spark):
    nodes, edges, caps, states = _summaries(get)
    return interproc.hints(nodes, caps, get("d_functions"))


@query("package_rollup")
def _(get, spark):
    nodes, edges, caps, states = _summaries(get)
    return interproc.rolled_up(nodes, caps, get("d_functions")).select("package", "capability", _r("confidence"), "n")


@query("hint_module_rollup", "SELECT module, bool_or(reachable) AS reachable FROM d_hints JOIN d_packages USING (package) WHERE module IS NOT NULL GROUP BY module")
def _(get, spark):
    return get("d_hints").join(get("d_packages"), "package").filter("module IS NOT NULL").groupBy("module").agg(F.bool_or("reachable").alias("reachable"))


@query("hint_left_join", "SELECT package, reachable FROM d_packages LEFT JOIN d_hints USING (package)")
def _(get, spark):
    return get("d_packages").join(get("d_hints"), "package", "left").select("package", "reachable")


# ---- text, sources and sinks -----------------------------------------------------

from ..operators import detect  # noqa: E402
from ..sinks import reports  # noqa: E402
from ..sources import files as inputs  # noqa: E402


def _texts(get) -> DataFrame:
    return get("documents").select(F.lit("go").alias("lang"), F.col("source").alias("project"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id")


@query("line_scan", r"SELECT source AS project, CAST(doc_id AS STRING) AS path, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n, CAST(len(text) - len(string_split(text, chr(10))) + 1 AS BIGINT) AS chars FROM documents")
def _(get, spark):
    return detect.scan(_texts(get)).groupBy("project", "path").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query("loc_count", r"SELECT source AS project, CAST(doc_id AS STRING) AS path, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INT) AS loc FROM documents")
def _(get, spark):
    return detect.loc(_texts(get))


_WORDS = {"token": "env", "the": "fs:read", "der": "network", "que": "exec", "###": "unsafe", "| ": "plugin"}


@query("callsite_contains", "SELECT CAST(doc_id AS STRING) AS path, capability, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents) l JOIN (VALUES " + ", ".join(f"('{k}', '{c}')" for k, c in _WORDS.items()) + ") AS w(key, capability) ON contains(value, key) GROUP BY ALL")
def _(get, spark):
    cat = spark.createDataFrame([("x", "call", k, c) for k, c in _WORDS.items()], "lang string, kind string, key string, capability string")
    found = detect.match_calls(detect.scan(_texts(get).withColumn("lang", F.lit("x"))), cat)
    return found.groupBy("path", "capability").agg(F.count("*").alias("n"))


_PREFIX = ["brand.11", "brand.11.economy", "brand.2", "brand.23.promo", "brand.33.standard.anodized"]
_DOTS = "(SELECT package, replace(name, '/', '.') AS m FROM d_names) d"


@query("import_prefix_join", f"""SELECT package, key FROM (SELECT package, key, row_number() OVER (PARTITION BY package ORDER BY length(key) DESC) AS r FROM {_DOTS}
  JOIN (VALUES {', '.join(f"('{p}')" for p in _PREFIX)}) AS w(key) ON m = key OR starts_with(m, key || '.')) x WHERE r = 1""")
def _(get, spark):
    cat = spark.createDataFrame([("java", "import", p, "exec") for p in _PREFIX], "lang string, kind string, key string, capability string")
    found = get("d_names").select(F.lit("java").alias("lang"), F.lit("p").alias("project"), F.col("package").cast("string").alias("path"), F.lit(1).alias("line"), F.translate("name", "/", ".").alias("module"))
    return detect.match_imports(found, cat).select(F.col("path").cast("long").alias("package"), "key")


@query("import_all_prefixes", f"""SELECT package, key FROM {_DOTS} JOIN (VALUES {', '.join(f"('{p}')" for p in _PREFIX)}) AS w(key) ON m = key OR starts_with(m, key || '.')""")
def _(get, spark):
    cat = spark.createDataFrame([("python", "import", p, "exec") for p in _PREFIX], "lang string, kind string, key string, capability string")
    found = get("d_names").select(F.lit("python").alias("lang"), F.lit("p").alias("project"), F.col("package").cast("string").alias("path"), F.lit(1).alias("line"), F.translate("name", "/", ".").alias("module"))
    return detect.match_imports(found, cat).select(F.col("path").cast("long").alias("package"), "key")


@query("html_links", """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) x GROUP BY ALL""")
def _(get, spark):
    return get("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("first_seen_dedupe", "SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM d_edges16) x WHERE r = 1")
def _(get, spark):
    return get("d_edges16").groupBy("src").agg(F.min("dst").alias("dst"))


@query("levenshtein_hint", "SELECT p_partkey AS package, min(levenshtein(p_type, 'LARGO')) AS distance FROM part GROUP BY ALL HAVING min(levenshtein(p_type, 'LARGO')) < 5")
def _(get, spark):
    return get("part").select(F.col("p_partkey").alias("package"), F.levenshtein("p_type", F.lit("LARGO")).alias("distance")).filter("distance < 5")


@query("name_scalars", """SELECT p_partkey AS package, name LIKE '%/v1' AS has_major, regexp_replace(name, '/v[0-9]+$', '') AS base, string_split(name, '/')[1] AS bare, replace(replace(name, '-', '_'), '.', '_') AS folded,
  string_split(name, '/')[-2] || '/' || string_split(name, '/')[-1] AS label FROM (SELECT p_partkey, lower(replace(p_name, ' ', '-')) || '/x.y/v' || (p_partkey % 3) AS name FROM part) y""".replace("name LIKE '%/v1'", "regexp_matches(name, '/v[0-9]+$')"))
def _(get, spark):
    n = F.concat(F.lower(F.regexp_replace("p_name", " ", "-")), F.lit("/x.y/v"), (F.col("p_partkey") % 3).cast("string"))
    p = get("part").select(F.col("p_partkey").alias("package"), n.alias("name"))
    c = F.col("name")
    return p.select("package", S.has_major(c).alias("has_major"), S.module_base(c).alias("base"), S.bare_module(c).alias("bare"), S.python_name(c).alias("folded"), S.short_label(c).alias("label"))


@query("sbom_components", """SELECT m.module, m.version, 'pkg:golang/' || m.module || '@' || m.version AS purl, coalesce(caps, '') AS capabilities, CASE WHEN risk = 3 THEN 'HIGH' WHEN risk = 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM d_modules m
  JOIN (SELECT module, max(CASE WHEN score >= 30 THEN 3 WHEN score >= 10 THEN 2 ELSE 1 END) AS risk FROM d_packages LEFT JOIN d_sets USING (package) WHERE NOT is_main AND module IS NOT NULL GROUP BY module) r ON r.module = m.module
  LEFT JOIN (SELECT module, string_agg(DISTINCT capability, ',' ORDER BY capability) AS caps FROM d_packages JOIN d_percap USING (package) WHERE NOT is_main AND module IS NOT NULL GROUP BY module) c ON c.module = m.module""")
def _(get, spark):
    health = spark.createDataFrame([], "module long, score int")
    parts = reports.components(get("d_modules").select("module", "version"), get("d_packages"), capset.build(get("d_evidence")), health)
    return parts.select("module", "version", "purl", F.array_join("capabilities", ",").alias("capabilities"), "risk_level")


@query("sarif_results", f"SELECT 'high-risk-capability' AS rule, CAST(package AS STRING) AS name FROM d_sets WHERE score >= 30 UNION ALL SELECT 'low-health', CAST(module AS STRING) FROM d_modules WHERE s_acctbal < 40")
def _(get, spark):
    caps = capset.build(get("d_evidence")).withColumn("level", S.risk_level(F.col("score")))
    return reports.sarif(caps, get("d_modules").select("module", F.col("s_acctbal").alias("score"))).select("rule", "name")


@query("graph_checksum", """SELECT substr(sha256('[' || (SELECT string_agg('{"module":"' || module || '","version":"' || version || '"}', ',' ORDER BY CAST(module AS STRING)) FROM d_modules) || ']' ||
  '[' || (SELECT string_agg('{"src":"' || src || '","dst":"' || dst || '"}', ',' ORDER BY CAST(src AS STRING), CAST(dst AS STRING)) FROM d_edges64) || ']'), 1, 16) AS checksum""")
def _(get, spark):
    return reports.checksum(get("d_modules").withColumn("is_main", F.lit(False)), get("d_edges64"))


@query("viz_subgraph", f"SELECT src, dst FROM d_edges16 WHERE src IN (SELECT package FROM d_sets WHERE score >= 30) AND dst IN (SELECT package FROM d_sets WHERE score >= 30)")
def _(get, spark):
    level = capset.build(get("d_evidence")).select(F.col("package").alias("node"), S.risk_level(F.col("score")).alias("level"))
    return reports.subgraph(get("d_edges16"), level, "high")[1]


@query("explain_text", """SELECT package, capability, string_agg(file || ':' || line || ' via ' || via, '; ' ORDER BY rank) || CASE WHEN max(total) > count(*) THEN ' (and ' || (max(total) - count(*)) || ' more)' ELSE '' END AS text FROM
  (SELECT *, row_number() OVER (PARTITION BY package, capability ORDER BY confidence DESC, file, line, via) AS rank, count(*) OVER (PARTITION BY package, capability) AS total FROM d_evidence) x WHERE rank <= 3 GROUP BY package, capability""")
def _(get, spark):
    return reports.explained(capset.top_evidence(get("d_evidence")))


@query("trace_events", """SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN 'filesystem' WHEN 1 THEN 'network' ELSE 'subprocess' END AS kind,
  CASE event_id % 3 WHEN 0 THEN '/tmp/' || user_id WHEN 1 THEN '10.0.0.' || (user_id % 200) || ':443' ELSE '/bin/' || event_type END AS detail FROM events""")
def _(get, spark):
    k, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    line = F.when(k == 0, F.concat(F.lit('[pid 7] openat(AT_FDCWD, "/tmp/'), u, F.lit('", O_RDONLY) = 3'))).when(k == 1, F.concat(F.lit('connect(3, {sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr("10.0.0.'), (F.col("user_id") % 200).cast("string"), F.lit('")}, 16) = 0'))).otherwise(F.concat(F.lit('execve("/bin/'), "event_type", F.lit('", ["x"], 0x7) = 0')))
    return inputs.trace_events(get("events").select(line.alias("value")))
