"""Capability catalogs: which imports and call sites give which capabilities.

A catalog is a DataFrame (lang, kind, key, capability), kind import or call. The
built-in one is small; ``read`` takes catalog files of the usual YAML shape (name,
imports and call_sites maps of key to list), so existing ones can be used unchanged.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..model import NAMES

SCHEMA = "lang string, kind string, key string, capability string"
_BUILTIN = Path(__file__).parent / "catalogs" / "builtin.txt"
_ENTRY = re.compile(r"""^\s+(?:"((?:[^"\\]|\\.)*)"|'([^']*)'|([^\s#"'][^\s]*?))\s*:\s*\[([^\]]*)\]""")


def builtin_rows() -> list[tuple[str, str, str, str]]:
    rows = []
    for line in _BUILTIN.read_text().splitlines():
        if line and not line.startswith("# "):
            head, _, keys = line.partition(" : ")
            lang, kind, caps = head.split(" ")
            rows += [(lang, kind, k.replace("#", " "), c) for k in keys.split() for c in caps.split(",")]
    return rows


def parse(text: str) -> list[tuple[str, str, str, str]]:
    """Rows of one catalog file. An unknown capability is a ValueError."""
    lang, kind, rows = "", "", []
    for line in text.splitlines():
        if m := re.match(r"name:\s*(\S+)", line):
            lang = m.group(1)
        elif re.match(r"(imports|call_sites)\s*:", line):
            kind = "import" if line.startswith("imports") else "call"
        elif kind and (m := _ENTRY.match(line)):
            key = m.group(1).replace('\\"', '"').replace("\\\\", "\\") if m.group(1) is not None else m.group(2) or m.group(3)
            for c in (x.strip() for x in m.group(4).split(",")):
                if c:
                    rows.append((lang, kind, key, c))
    return rows


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A checked catalog."""
    unknown = sorted({r[3] for r in rows} - set(NAMES))
    if unknown:
        raise ValueError(f"unknown capabilities: {', '.join(unknown)}")
    return spark.createDataFrame(sorted(set(rows)), SCHEMA)


def builtin(spark: SparkSession) -> DataFrame:
    return frame(spark, builtin_rows())


def read(spark: SparkSession, *paths: str) -> DataFrame:
    return frame(spark, [r for p in paths for r in parse(Path(p).read_text())])
