"""URL filters as a temporal join with dated lists.

A list is a table of events: on ``at``, ``action`` (add or remove) of ``entry`` to
``list``. An entry is a host (which also stands for all hosts below it) or a host
with a path (which stands for all paths that begin with it, segment by segment).

Events become validity intervals: an entry counts from its add until the next event of
the same list and entry, an open end meaning for good. A capture of a URL at a time is
looked up under all its keys (hosts from the longest to the top, and paths of its own
host) and is blocked by the entries whose interval [from, to) holds its time.

Keys are joined by equality only. All intervals of a key are one row with an array, in
which the as-of condition is evaluated, so a capture meets at most one row per key,
however long the entry's history.

Result: one row per capture: (page_id, url, fetched, blocked, lists): ``lists`` are
the names of all lists that block it, sorted and joined by commas.

Defined results: events without time, entry, list or a known action are ignored; of
events at the same time a remove comes last, so an interval has no length then; repeated
events change nothing; host and scheme are compared in lower case, ports, users,
queries and fragments ignored; a capture without URL or host, or without time, is
never blocked; a null id stays null; repeated captures give repeated rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick

#: Keys with their intervals up to which they are broadcast; beyond that they are joined by a shuffle.
BROADCAST_KEYS = 500_000


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    """Path without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")


def keys(url: Column) -> Column:
    """All entries that would stand for a URL: a.b.c, b.c, c, and a.b.c/x, a.b.c/x/y."""
    labels, parts = F.split(host(url), r"\."), F.split(path(url), "/")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(host(url), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.when(host(url) != "", F.array_distinct(F.concat(hosts, F.coalesce(paths, F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))


def intervals(events: DataFrame) -> DataFrame:
    """entry, list, from, to: when entries count."""
    action = F.lower(F.col("action"))
    good = pick(events, "list", "entry", "action", "at").filter(F.col("list").isNotNull() & F.col("entry").isNotNull() & F.col("at").isNotNull() & action.isin("add", "remove"))
    tidy = good.select("list", F.regexp_replace(F.concat(F.lower(F.substring_index("entry", "/", 1)), F.expr("substring(entry, length(substring_index(entry, '/', 1)) + 1)")), r"/+$", "").alias("entry"), (action == "remove").alias("gone"), F.col("at").cast("timestamp").alias("from")).distinct()
    until = F.lead("from").over(Window.partitionBy("list", "entry").orderBy("from", "gone"))
    return tidy.withColumn("to", until).filter(~F.col("gone") & (F.col("to").isNull() | (F.col("to") > F.col("from")))).select("entry", "list", "from", "to")


def evaluate(captures: DataFrame, events: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Whether each capture (page_id, url, fetched) is blocked, and by which lists."""
    by_key = intervals(events).groupBy("entry").agg(F.collect_list(F.struct("list", "from", "to")).alias("spans"))
    by_key = Scratch(captures.sparkSession, "urls").write(by_key, "keys")
    if by_key.count() <= broadcast_keys:
        by_key = F.broadcast(by_key)
    need = pick(captures, "page_id", "url", "fetched").withColumn("fetched", F.col("fetched").cast("timestamp"))
    met = need.select("url", "fetched").distinct().withColumn("entry", F.explode(keys(F.col("url")))).join(by_key, "entry")
    hit = F.transform(F.filter("spans", lambda s: (s["from"] <= F.col("fetched")) & (s["to"].isNull() | (F.col("fetched") < s["to"]))), lambda s: s["list"])
    lists = met.withColumn("list", F.explode(hit)).groupBy("url", "fetched").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    return need.join(lists, ["url", "fetched"], "left").select("page_id", "url", "fetched", F.col("lists").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"))


def fetched(page_id: Column) -> Column:
    """The synthetic pages have no fetch time: a fixed one within a year, from the id."""
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(page_id * 7_919, F.lit(8_760)) * 3_600)


def synthetic_events(pages: DataFrame) -> DataFrame:
    """Dated lists for the synthetic pages: of every host some list events, and of every seventh page its first path segment."""
    hosts = pick(pages, "url").select(host(F.col("url")).alias("h")).filter("h <> ''").distinct()
    seed = F.conv(F.substring(F.md5("h"), 1, 6), 16, 10).cast("long")
    base = hosts.select("h", seed.alias("s"))
    on = lambda c: F.timestamp_seconds(F.lit(1_704_067_200) + c * 86_400)
    row = lambda df, list_, entry, action, day: df.select(F.lit(list_).alias("list"), entry.alias("entry"), F.lit(action).alias("action"), on(day).alias("at"))
    s = F.col("s")
    some, more = base.filter("s % 3 = 0"), base.filter("s % 5 = 0")
    deep = pick(pages, "page_id", "url").filter("page_id % 7 = 0").select(host(F.col("url")).alias("h"), F.get(F.split(path(F.col("url")), "/"), 1).alias("seg"), "page_id").filter("h <> '' AND seg IS NOT NULL")
    deep = deep.groupBy("h", "seg").agg(F.min("page_id").alias("s"))
    return (
        row(some, "malware", F.col("h"), "add", s % 200)
        .unionByName(row(some, "malware", F.col("h"), "remove", s % 200 + 30 + s % 90))
        .unionByName(row(some.filter("s % 2 = 0"), "malware", F.col("h"), "add", s % 200 + 150))
        .unionByName(row(more, "adult", F.array_join(F.slice(F.split("h", r"\."), F.greatest(F.size(F.split("h", r"\.")) - 2, F.lit(1)), F.lit(3)), "."), "add", s % 300))
        .unionByName(row(deep, "spam", F.concat_ws("/", "h", "seg"), "add", s % 365))
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 1 over all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = evaluate(pages.withColumn("fetched", fetched(F.col("page_id"))), synthetic_events(pages))
    return out.withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd HH:mm:ss"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
ORACLE = f"""
WITH p AS (SELECT page_id, url, {_HOST} AS h, {_PATH} AS pa,
  TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * ((page_id * 7919) % 8760) AS fetched FROM pages),
b AS (SELECT DISTINCT h, CAST('0x' || substr(md5(h), 1, 6) AS BIGINT) AS s FROM p WHERE h <> ''),
dp AS (SELECT h, string_split(pa, '/')[2] AS seg, min(page_id) AS s FROM p
  WHERE page_id % 7 = 0 AND h <> '' AND len(string_split(pa, '/')) > 1 GROUP BY ALL),
ev AS (
  SELECT 'malware' AS list, h AS entry, false AS gone, s % 200 AS d FROM b WHERE s % 3 = 0
  UNION SELECT 'malware', h, true, s % 200 + 30 + s % 90 FROM b WHERE s % 3 = 0
  UNION SELECT 'malware', h, false, s % 200 + 150 FROM b WHERE s % 3 = 0 AND s % 2 = 0
  UNION SELECT 'adult', array_to_string(string_split(h, '.')[-3:], '.'), false, s % 300 FROM b WHERE s % 5 = 0
  UNION SELECT 'spam', h || '/' || seg, false, s % 365 FROM dp),
iv AS (SELECT list, entry, gone, d, lead(d) OVER (PARTITION BY list, entry ORDER BY d, gone) AS e FROM ev),
v AS (SELECT list, entry, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * d AS f, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * e AS t
  FROM iv WHERE NOT gone AND (e IS NULL OR e > d)),
hit AS (SELECT DISTINCT page_id, list FROM p JOIN v ON f <= fetched AND (t IS NULL OR fetched < t)
  AND (h = entry OR ends_with(h, '.' || entry) OR h || pa = entry OR starts_with(h || pa, entry || '/') AND contains(entry, '/')))
SELECT page_id, url, strftime(fetched, '%Y-%m-%d %H:%M:%S') AS fetched, lists IS NOT NULL AS blocked, coalesce(lists, '') AS lists
FROM p LEFT JOIN (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists FROM hit GROUP BY page_id) USING (page_id)
"""
