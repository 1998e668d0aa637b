"""What the operators of this subpackage share: shared-folder tables and grouped Arrow streams."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import give_back


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark runs in this process alone."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share")
        at = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_shipped: set[str] = set()
#: Bytes of rows that go to a worker at once. Operators cut texts into pieces of that size at most, so that more is only held, by the JVM outside its heap and by the worker; it changes no result.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once an application, so that their workers can import it, and bound batches where the session doesn't."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="plumbline-source-"), f"{package.name}.zip")
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(to))


class Scratch:
    """Intermediate tables of one run, written to the shared folder so that a lost executor costs nothing.

    Reading a written table also cuts the lineage. ``drop`` removes a table once
    nothing reads it any more; the others go when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others can't clash with ours. A missing one is an AnalysisException."""
    ship(df.sparkSession)
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if cut or (held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != k[-1]):
            done = [*held, batch.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(done).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held.clear()
    give_back()


def clustered(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key side by side, for whole_groups."""
    return df.repartition(key).sortWithinPartitions(key)


def words_count(text: Column) -> Column:
    """White-space-separated words; 0 for null and empty texts."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " ")))


def column_to_numpy(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    col = table.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.to_numpy(zero_copy_only=False)


def binary_rows(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary value per length, cut from the bytes of ``values``."""
    item = values.dtype.itemsize
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(np.asarray(lengths, np.int64) * item, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())


def rows_binary(column: pa.Array | pa.ChunkedArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column side by side, and each row's length."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return np.frombuffer(raw.tobytes(), dtype), np.diff(offsets) // np.dtype(dtype).itemsize


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_hash(df: DataFrame) -> Column:
    """64-bit hash of a row's text, by which rows of one id are told apart; null texts and empty ones differ."""
    return F.xxhash64(F.col("text").cast("string"))


#: Rows to look up (id and text hash, 16 bytes each) up to which they are broadcast; beyond that both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def match_rows(docs: DataFrame, rows: DataFrame, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` joined with ``rows`` (doc_id, th) by id, null for null, and hash of the text; ``how`` is a semi or an anti join."""
    rows = Scratch(docs.sparkSession, "rows").write(rows.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")), "rows")
    few = rows.count() <= limit
    same = docs["doc_id"].cast("long").eqNullSafe(rows["__id"]) & (text_hash(docs) == rows["__th"])
    return docs.join(F.broadcast(rows) if few else rows, same, how)


def lowest(h: Column, wanted: int, of: Column) -> Column:
    """Whether a 64-bit hash is among the lowest of its range: about twice what is wanted of so many values.

    A filter before ordering by the hash and taking ``wanted``, so that only few rows
    are ordered. ``of`` counts distinct values, not rows: then the result is that of
    ordering all, however often values repeat.
    """
    return h.cast("double") <= -(2.0**63) + F.least(F.lit(1.0), (2.0 * wanted + 64.0) / F.greatest(of, F.lit(1))) * 2.0**64
