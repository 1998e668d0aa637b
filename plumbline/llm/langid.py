"""Language identification by compression.

For each language a raw-content dictionary is put together from bounded samples
of labelled text. A text is compressed with every dictionary, in blocks of
``BLOCK`` bytes that each start from the dictionary alone, so that what it saves
grows with the text; the smallest sum names the language. It is rejected (``und``) when the runner-up is within
``margin`` of the best, relative to the best, or the text is too short to tell.

Bound: dictionaries hold at most ``dictionary_bytes`` per language, taken from the
``sample`` labelled documents per language with the smallest seeded hash of their
id, an even share of each: a passage from a seeded place anywhere in its text. An id counts
once a language, whatever its rows: of different texts, the one with the smallest hash.

Defined results: null and empty texts, and those of fewer than ``least_bytes``
bytes, get ``und``; equal sizes have margin 0 and get ``und``; a label that is
null isn't learnt from, nor is a row without an id; without any dictionary all get ``und``; with one language
only the margin is 1; every row gets a result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lowest, pick
from .textops import text_chunks

SAMPLE, DICTIONARY_BYTES, SEED = 150, 64 << 10, 5
MARGIN, LEAST_BYTES, LEVEL = 0.01, 12, 3
#: Bytes compressed at a time; shorter texts are one block.
BLOCK = 16 << 10
RESULT = "doc_id long, lang string, margin double, accepted boolean"
UNKNOWN = "und"


def dictionaries(labelled: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY_BYTES, seed: int = SEED) -> dict[str, bytes]:
    """Raw dictionary content by language."""
    rows = pick(labelled, "doc_id", "lang", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))  # one row a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    share = max(1, size // max(1, sample))
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(seed)).alias("h")).join(F.broadcast(counts), "lang").filter(lowest(F.col("h"), sample, F.col("n")))
    ids = hashed.select("doc_id", "lang", "h").distinct().withColumn("r", rank).filter(F.col("r") <= sample).select("doc_id", "lang", "r")
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.greatest(F.length("text") - share + 1, F.lit(1))).cast("int")
    part = F.struct(F.xxhash64("text").alias("h"), F.col("text").substr(place + 1, F.lit(share)).alias("part"))
    got = rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("lang", "r").agg(F.min(part).alias("least")).select("lang", "r", "least.part").collect()
    out: dict[str, list] = {}
    for row in sorted(got, key=lambda x: (x.lang, -x.r, x.part)):
        out.setdefault(row.lang, []).append(row.part.encode())
    return {lang: b" ".join(parts)[-size:] for lang, parts in out.items()}


class Classifier:
    """Compressors by language, made once per worker."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.langs = sorted(content)
        self.use = []
        for lang in self.langs:
            held = z.ZstdCompressionDict(content[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.use.append(z.ZstdCompressor(dict_data=held, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        blocks = [memoryview(text)[at : at + BLOCK] for at in range(0, len(text), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.use]

    def classify(self, text: str | None, margin: float = MARGIN, least: int = LEAST_BYTES) -> tuple[str, float]:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) < least or not self.langs:
            return UNKNOWN, 0.0
        sizes = self.sizes(data)
        best = int(np.argmin(sizes))
        rest = sizes[:best] + sizes[best + 1 :]
        gap = (min(rest) - sizes[best]) / sizes[best] if rest else 1.0
        return (self.langs[best] if gap >= margin and gap > 0 else UNKNOWN), gap


def identify(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Language, margin and acceptance of every row."""
    held = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Classifier(held.value)
        for batch in text_chunks(batches, "text"):
            got = [of.classify(t, margin, least_bytes) for t in batch.column("text").to_pylist()]
            lang = [g[0] for g in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([x != UNKNOWN for x in lang])], ["doc_id", "lang", "margin", "accepted"])

    need = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return need.mapInArrow(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 9 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, dictionaries(docs))
