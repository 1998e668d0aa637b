"""Column functions of the risk model; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CAPABILITIES, HIGH, HOPS, LOW_CONFIDENCE, MEDIUM


def weight(capability: Column) -> Column:
    """Weight of a capability; 0 for an unknown one."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, w, _ in CAPABILITIES for x in (n, w)]), capability), F.lit(0))


def role(capability: Column) -> Column:
    """source, sink, sanitizer or neutral (also for an unknown one)."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, _, r in CAPABILITIES for x in (n, r)]), capability), F.lit("neutral"))


def risk_level(score: Column) -> Column:
    return F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")


def risk_value(level: Column) -> Column:
    """3, 2, or 1 for anything that isn't high or medium in any case."""
    return F.when(F.lower(level) == "high", 3).when(F.lower(level) == "medium", 2).otherwise(1)


def meets(level: Column, least: str) -> Column:
    return risk_value(level) >= risk_value(F.lit(least))


def downgrade(risk: Column, confidence: Column) -> Column:
    """One step less where confidence is known and below 0.70."""
    low = (confidence > 0) & (confidence < LOW_CONFIDENCE)
    return F.when(low & (risk == "HIGH"), "MEDIUM").when(low & (risk == "MEDIUM"), "LOW").otherwise(risk)


def hop(depth: Column) -> Column:
    return F.when(depth <= 0, HOPS[0]).when(depth == 1, HOPS[1]).when(depth == 2, HOPS[2]).otherwise(HOPS[3])


def under(name: Column, focus: Column) -> Column:
    """Equal, or below in the path."""
    return (name == focus) | F.startswith(name, F.concat(focus, F.lit("/")))


def matches(name: Column, pattern: Column) -> Column:
    """``x/*`` is x and all below it; anything else must be equal."""
    base = F.regexp_replace(pattern, r"/\*$", "")
    return F.when(F.endswith(pattern, F.lit("/*")), under(name, base)).otherwise(name == pattern)


def owner_repo(path: Column) -> Column:
    """owner/repo of a github.com path, else null."""
    p = F.split(path, "/")
    return F.when((F.get(p, F.lit(0)) == "github.com") & (F.size(p) >= 3), F.concat_ws("/", F.get(p, F.lit(1)), F.get(p, F.lit(2))))


def purl(path: Column, version: Column, kind: str = "golang") -> Column:
    return F.concat(F.lit(f"pkg:{kind}/"), path, F.when(version != "", F.concat(F.lit("@"), version)).otherwise(""))


def has_major(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).rlike("^v[0-9]+$")


def module_base(path: Column) -> Column:
    return F.regexp_replace(path, "/v[0-9]+$", "")


def python_name(name: Column) -> Column:
    return F.translate(F.lower(name), "-.", "__")


def bare_module(name: Column) -> Column:
    """Package of an import path: two segments of a scoped one, else the first."""
    p = F.split(name, "/")
    return F.when(F.startswith(name, F.lit("@")), F.concat_ws("/", F.slice(p, 1, 2))).otherwise(p[0])


def split_at(name: Column) -> tuple[Column, Column]:
    """Name and version around the last @ that isn't the first character."""
    cut = F.regexp_extract(name, "^(.+)@([^@]*)$", 1)
    return F.when(cut == "", name).otherwise(cut), F.regexp_extract(name, "^(.+)@([^@]*)$", 2)


def short_label(name: Column) -> Column:
    p = F.split(name, "/")
    return F.when(F.size(p) <= 2, name).otherwise(F.concat_ws("/", F.slice(p, -2, 2)))


def clojure_variants(ns: Column) -> Column:
    bare = F.regexp_replace(ns, r"""^["'\[\]()`]+|["'\[\]()`]+$""", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(bare, F.substring_index(bare, ".", 1), F.translate(bare, ".", "/"))))


def prefixes(name: Column, separator: str) -> Column:
    """All prefixes of a name by whole segments, longest first."""
    p = F.split(name, {".": r"\.", "\\": r"\\"}.get(separator, separator))
    return F.transform(F.sequence(F.size(p), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(p, F.lit(1), i), separator))


def sparkline(scores: Column) -> Column:
    """One block character per score of 0..100."""
    blocks = F.array(*[F.lit(c) for c in "▁▂▃▄▅▆▇█"])
    return F.array_join(F.transform(scores, lambda x: F.element_at(blocks, F.least(F.lit(7), F.greatest(F.lit(0), (x * 7 / 100).cast("int"))) + 1)), "")


def inferred_caps(name: Column, ecosystem: str) -> Column:
    """Capabilities guessed from a name, for version diffs without per-version evidence."""
    low = F.lower(name)
    hints = {
        "go": [(["exec", "process"], "exec"), (["net", "http", "grpc"], "network"), (["crypto", "tls"], "crypto")],
        "node": [(["exec", "spawn", "shell"], "exec"), (["net", "http", "request", "axios", "fetch"], "network"), (["crypto", "hash"], "crypto"), (["fs", "file", "path"], "fs:read")],
    }[ecosystem]
    found = []
    for words, cap in hints:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        found.append(F.when(hit, cap))
    return F.array_compact(F.array(*found))


def caps_level(caps: Column) -> Column:
    """HIGH with exec, unsafe or plugin, MEDIUM with anything else, LOW with nothing."""
    strong = F.array(F.lit("exec"), F.lit("unsafe"), F.lit("plugin"))
    return F.when(F.arrays_overlap(caps, strong), "HIGH").when(F.size(caps) > 0, "MEDIUM").otherwise("LOW")


def level_delta(level: Column) -> Column:
    return F.when(level == "HIGH", 15).when(level == "MEDIUM", 8).otherwise(0)


def banded(value: Column, *bands: tuple[str, float, int]) -> Column:
    """Points of the first band that holds: (operator, bound, points)."""
    out = F.lit(0)
    for op, bound, points in reversed(bands):
        out = F.when(value > bound if op == ">" else value >= bound, points).otherwise(out)
    return out


def duration_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.2fs", ms / 1000))
