"""A deterministic, sharded WARC writer.

Records are made and compressed where their pages are, then sorted by a range of their key
(host reversed, path, id), cut into shards of about ``shard_bytes`` of payload,
and written shard by shard. The cuts are quantiles,
by bytes, of a sample of keys that depends on the keys alone and holds some
``SHARD_SAMPLE`` a shard; they are found by an aggregate, and one key a shard comes to the
driver. A file is closed as soon as its compressed size reaches ``roll_bytes``. Every record
is a gzip member of its own, with regenerated headers: type, target URI, date, digest
(sha1, base32), length, and an id made from the URI, the date and the digest. No clock, random
number, task or host name gets into a file, so a run writes the same bytes each time,
however often tasks are repeated.

Commit: a manifest and files that an earlier run left in the folder go first. A file is written under a temporary name that is unique to the attempt, and
renamed when complete; the index rows of a shard come from the attempt that wrote it.
When all shards are there, the index is written, then the manifest (files with
records, bytes and sha256, in order) under a temporary name, and renamed. A folder
without ``MANIFEST.json`` is not a result. Left-over temporary files are removed.

Result: one row per record: (page_id, file, offset, length, digest), with the
record's compressed place.

Defined results: a null payload is written as an empty one; a null URL as
``urn:x-page:<id>``; repeated rows are written once each, side by side; equal keys are
ordered by id, date and payload; a null id is written as such; an empty table gives a manifest of
no files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, lowest, pick, shared_dir
from .textops import text_chunks

ROLL_BYTES, SHARD_BYTES, SHARD_SAMPLE = 64 << 20, 1 << 30, 200
#: What a record adds to its payload, about.
HEAD_BYTES = 400
RECORDS = "shard int, page_id long, url string, date string, key string, digest string, member binary"
INDEX = "page_id long, file string, offset long, length long, digest string, file_bytes long, file_sha256 string"


def file_system(uri: str):
    """pyarrow file system and path of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def record(uri: str, date: str, payload: bytes) -> tuple[bytes, str]:
    """A WARC/1.0 resource record and its payload digest."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{uri} {date} {digest}")
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: {digest}\r\nWARC-Block-Digest: {digest}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n", digest


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member, with no time or name in its header."""
    z = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def read(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of a file."""
    while data:
        z = zlib.decompressobj(zlib.MAX_WBITS | 16)
        text = z.decompress(data) + z.flush()
        data = z.unused_data
        head, _, rest = text.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


class _File:
    """A file being written: buffers members, knows its own digest, appears only when complete."""

    def __init__(self, fs, folder: str, name: str):
        self.fs, self.folder, self.name = fs, folder, name
        self.temporary = f"{folder}/.tmp-{name}-{uuid.uuid4().hex}"
        self.out, self.size, self.sha, self.rows = fs.open_output_stream(self.temporary), 0, hashlib.sha256(), []

    def add(self, page, data: bytes, digest: str) -> None:
        self.rows.append((page, self.name, self.size, len(data), digest))
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        page, name, at, n, digest = zip(*self.rows, strict=True)
        k = len(self.rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(page, pa.int64()), pa.array(name), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(digest), pa.array([self.size] * k, pa.int64()), pa.array([self.sha.hexdigest()] * k)],
            ["page_id", "file", "offset", "length", "digest", "file_bytes", "file_sha256"],
        )


def _key(url):
    """Host labels from the last to the first, then the rest: neighbours in a site are neighbours in the files."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def boundaries(rows: DataFrame, n_rows: int, shards: int, sample: int = SHARD_SAMPLE) -> list[str]:
    """Places that cut rows (place, bytes) into shards of about equal bytes.

    Of all places those are looked at whose hash is low, some ``sample`` a shard. They
    are put in order in ranges; each range's bytes and then each shard's first place come
    to the driver.
    """
    if shards < 2:
        return []
    scratch = Scratch(rows.sparkSession, "warc")
    low = lowest(F.xxhash64("place"), sample * shards // 2, F.lit(n_rows))
    some = rows.filter(low).groupBy("place").agg(F.sum("bytes").alias("bytes"))
    some = scratch.write(some.repartitionByRange("place").withColumn("part", F.spark_partition_id()), "sample")
    parts = some.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.min("place").alias("first")).select("part", (F.sum("bytes").over(Window.orderBy("first")) - F.col("bytes")).alias("before"))  # a row a range
    total = some.agg(F.sum("bytes")).first()[0]
    upto = F.sum("bytes").over(Window.partitionBy("part").orderBy("place"))
    placed = some.withColumn("upto", upto).join(F.broadcast(parts), "part")
    shard = F.floor((F.col("before") + F.col("upto") - F.col("bytes")) * F.lit(shards) / F.lit(total))
    got = sorted(r["first"] for r in placed.groupBy(shard.alias("shard")).agg(F.min("place").alias("first")).collect())
    return got[1:]


def _place(key: Column, page_id: Column) -> Column:
    """A string by which records are cut: the key, then the id in its order."""
    order = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(key, F.lit("\x00"), F.coalesce(order, F.lit("")))


def write(pages: DataFrame, to: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date=None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files into the folder ``to``, and return the index.

    ``date`` is a column of timestamps; by default a fixed day and the id's second of it.
    """
    spark = pages.sparkSession
    stamp = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(86_400))) if date is None else F.coalesce(date, F.timestamp_seconds(F.lit(0)))
    own = fresh(pages, "__date")
    rows = pick(pages.withColumn(own, stamp), "page_id", "url", "html", own)
    url = F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    clean = F.regexp_replace(url, r"[\r\n]", "")
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), clean.alias("url"), F.date_format(F.to_utc_timestamp(F.col(own), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", _key(F.col("url"))).withColumn("place", _place(F.col("key"), F.col("page_id")))
    sizes = rows.select("place", (F.octet_length("html") + HEAD_BYTES).cast("long").alias("bytes"))
    total, n_rows = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    cuts = boundaries(sizes, n_rows, max(1, -(-total // shard_bytes)))
    held = spark.sparkContext.broadcast(np.array(cuts, dtype=object))
    clear(to)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "html"):
            place, *of = (batch.column(c).to_pylist() for c in ("place", "url", "date", "html"))
            shard = np.searchsorted(held.value, np.array(place, dtype=object), side="right") if len(held.value) else np.zeros(len(place))
            made = [record(url, day, html.encode("utf-8", "surrogatepass")) for url, day, html in zip(*of, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), *(batch.column(c) for c in ("page_id", "url", "date", "key")), pa.array([d for _, d in made]), pa.array([member(data) for data, _ in made], pa.binary())],
                ["shard", "page_id", "url", "date", "key", "digest", "member"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(to)
        fs.create_dir(folder, recursive=True)
        open_, shard, seq = None, None, 0
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            for page, digest, of, data in zip(*(batch.column(c).to_pylist() for c in ("page_id", "digest", "shard", "member")), strict=True):
                if open_ is not None and (of != shard or open_.size >= roll_bytes):
                    yield open_.close()
                    open_ = None
                if of != shard:
                    shard, seq = of, 0
                if open_ is None:
                    open_ = _File(fs, folder, f"part-{shard:06d}-{seq:05d}.warc.gz")
                    seq += 1
                open_.add(page, data, digest)
        if open_ is not None:
            yield open_.close()

    sharded = rows.mapInArrow(compress, RECORDS).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "page_id", "url", "date", "digest")
    sharded.mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{to.rstrip('/')}/index")
    index = spark.read.parquet(f"{to.rstrip('/')}/index")
    commit(index, to)
    return index.select("page_id", "file", "offset", "length", "digest")


def clear(to: str) -> None:
    """Take out what an earlier run left: first the manifest, so that nothing that is being replaced counts as a result."""
    from pyarrow.fs import FileSelector

    fs, folder = file_system(to)
    old = [f.base_name for f in fs.get_file_info(FileSelector(folder, allow_not_found=True))]
    for name in sorted(old, key=lambda name: name != "MANIFEST.json"):
        if name == "MANIFEST.json" or name.startswith(".tmp-") or (name.startswith("part-") and name.endswith(".warc.gz")):
            fs.delete_file(f"{folder}/{name}")


def commit(index: DataFrame, to: str) -> None:
    """Write the manifest last, by renaming; remove what attempts left behind."""
    files = index.groupBy("file").agg(F.count("*").alias("records"), F.max("file_bytes").alias("bytes"), F.max("file_sha256").alias("sha256")).orderBy("file")
    fs, folder = file_system(to)
    from pyarrow.fs import FileSelector

    for f in fs.get_file_info(FileSelector(folder)):
        if f.base_name.startswith(".tmp-"):
            fs.delete_file(f.path)
    temporary = f"{folder}/.tmp-manifest-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(json.dumps({"files": [r.asDict() for r in files.toLocalIterator()]}, indent=1, sort_keys=True).encode())
    fs.move(temporary, f"{folder}/MANIFEST.json")


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 5 over all pages, into a new folder beside the checkpoints."""
    return write(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
