"""The risk model's relations, read off the driver's tables. One SQL text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..model import CAPABILITIES, TAINT_RULES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(str(r) for r in rows)}) AS t({names})"


def _edges(m: int) -> str:
    return f"""SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
      FROM lineitem WHERE l_orderkey % {m} = 0) x WHERE dst IS NOT NULL AND src <> dst"""


def _year(y: int) -> str:
    return f"SELECT l_partkey AS package, CAST(max(l_suppkey) AS BIGINT) AS version FROM lineitem WHERE l_shipdate >= TIMESTAMP '{y}-01-01 00:00:00' AND l_shipdate < TIMESTAMP '{y + 1}-01-01 00:00:00' GROUP BY l_partkey"


SQL = {
    "capability": _values([(n, w, r, i) for i, (n, w, r) in enumerate(CAPABILITIES)], "name, weight, role, idx"),
    "rules": _values([(i, a, b, r) for i, (a, b, r, _) in enumerate(TAINT_RULES)], "rule, source, sink, risk"),
    "d_packages": "SELECT p_partkey AS package, min(l_suppkey) AS module, p_partkey % 97 = 0 AS is_main FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey",
    "d_modules": "SELECT s_suppkey AS module, concat('v1.', CAST(s_nationkey AS STRING)) AS version, s_acctbal FROM supplier",
    "d_evidence": """SELECT l_partkey AS package, name AS capability, l_orderkey AS file, l_linenumber AS line,
      CASE WHEN l_returnflag = 'A' THEN 'import' ELSE 'callSite' END AS via,
      CAST(CASE l_returnflag WHEN 'A' THEN 0.90 WHEN 'N' THEN 0.75 ELSE 0.60 END AS DOUBLE) AS confidence
      FROM lineitem JOIN capability ON l_suppkey % 9 = idx WHERE l_quantity <= 5""",
    "d_percap": "SELECT package, capability, avg(confidence) AS confidence, count(*) AS n FROM d_evidence GROUP BY package, capability",
    "d_sets": "SELECT package, CAST(sum(weight) AS BIGINT) AS score FROM d_percap JOIN capability ON name = capability GROUP BY package",
    "d_taint": """SELECT a.package, r.source, r.sink, r.risk AS rule_risk, least(a.confidence, b.confidence) AS confidence,
      CASE WHEN least(a.confidence, b.confidence) < 0.70 AND r.risk = 'HIGH' THEN 'MEDIUM' WHEN least(a.confidence, b.confidence) < 0.70 THEN 'LOW' ELSE r.risk END AS risk
      FROM d_percap a JOIN rules r ON a.capability = r.source JOIN d_percap b ON b.package = a.package AND b.capability = r.sink""",
    "d_tcounts": "SELECT package, count(*) AS n, sum(CASE WHEN risk = 'HIGH' THEN 1 ELSE 0 END) AS high, sum(CASE WHEN risk = 'MEDIUM' THEN 1 ELSE 0 END) AS medium FROM d_taint GROUP BY package",
    "d_edges1": _edges(1),
    "d_edges16": _edges(16),
    "d_edges64": _edges(64),
    "d_dag16": "SELECT src, dst FROM d_edges16 WHERE src < dst",
    "d_dag64": "SELECT src, dst FROM d_edges64 WHERE src < dst",
    "d_mains": "SELECT package AS node FROM d_packages WHERE is_main",
    "d_functions": "SELECT package AS fn, coalesce(module, 0) AS package, CASE WHEN is_main THEN 'main' ELSE concat('f', CAST(package AS STRING)) END AS name FROM d_packages",
    "d_hints": "SELECT package, package % 5 <> 0 AS reachable FROM d_packages WHERE package % 3 = 0",
    "d_cves": "SELECT l_partkey AS package, count(DISTINCT l_suppkey) AS n_cve FROM lineitem WHERE l_discount >= 0.10 AND l_tax >= 0.07 GROUP BY l_partkey",
    "d_base": _year(1995),
    "d_head": _year(1996),
    "d_days": "SELECT day, CAST(row_number() OVER (ORDER BY day) AS INT) AS seq FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) x",
    "d_snapshots": """SELECT seq, user_id AS module, CAST(least(100, floor(round(sum(value), 4) / 10)) AS BIGINT) AS score FROM events JOIN d_days ON CAST(ts AS DATE) = day GROUP BY seq, user_id""",
    "d_levels": "SELECT seq, module, score, CASE WHEN score >= 30 THEN 'HIGH' WHEN score >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM d_snapshots",
    "d_lock": """SELECT c_nationkey AS project, concat('pkg', CAST(c_custkey AS STRING)) AS package, c_custkey AS k,
      CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('sha512-', CAST(c_custkey AS STRING)) END AS integrity,
      CASE WHEN c_custkey % 13 = 0 THEN 'file:../x' WHEN c_custkey % 17 = 0 THEN 'git+ssh://h/x' ELSE concat('https://registry/', CAST(c_custkey AS STRING)) END AS resolved FROM customer""",
    "d_names": """SELECT p_partkey AS package, concat(lower(regexp_replace(p_brand, '#', '/')), '/', lower(regexp_replace(p_type, ' ', '/')), '/', CAST(p_partkey AS STRING)) AS name FROM part""",
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation, or one of the driver's tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, used = SQL[name], {}
    for n in [*SQL, *TABLES]:
        text, k = re.subn(rf"\b(FROM|JOIN)\s+{n}\b", r"\1 {" + n + "}", text)
        if k:
            used[n] = relation(spark, sf_dir, n)
    return spark.sql(text, **used)


def oracle(body: str) -> str:
    """DuckDB SQL: the body, with the derived relations it needs before it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in SQL:
            if n not in order and re.search(rf"(?:FROM|JOIN|,)\s+{n}\b", text):
                visit(SQL[n])
                order.append(n)

    visit(body)
    ctes = [f"{n} AS ({SQL[n]})" for n in order]
    recursive = "RECURSIVE " if "WITH RECURSIVE" in body else ""
    body = body.strip()
    own = re.match(r"WITH(?: RECURSIVE)?\s+", body)
    if not ctes:
        return body
    rest = ", " + body[own.end() :] if own else " " + body
    return f"WITH {recursive}" + ", ".join(ctes) + rest
