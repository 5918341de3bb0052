"""Helpers of the training-data operators: hashed words, Arrow batches, the shared folder.

A *word* is a run of bytes other than space and \\t \\n \\v \\f \\r, i.e. ``[^\\x20\\x09-\\x0D]+`` of the
text; in UTF-8 no other character contains those bytes.  Words are compared by a 64-bit hash, so two
different words are taken as one with probability about n^2 / 2^65 among n distinct words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
PUNCTUATION = WHITE.copy()
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 4_000_000
HASH_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the splitmix64 finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        table = np.full(2 * n, _BASE)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; the runs lie side by side and none is empty.

    They are taken in blocks of about HASH_BYTES bytes (a run is never split): each byte takes 40 while it is hashed.
    """
    out = np.empty(len(start), np.uint64)
    powers = _power_table(int((end - start).max())) if len(start) else _powers
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + HASH_BYTES, side="right")))
        length, first = end[i:j] - start[i:j], start[i:j] - start[i]
        place = np.arange(int(end[j - 1] - start[i])) - np.repeat(first, length)
        value = (data[start[i] : end[j - 1]].astype(np.uint64) + np.uint64(1)) * powers[place]
        out[i:j] = mix(np.add.reduceat(value, first) + length.astype(np.uint64))
        i = j
    return out


class Words:
    """The words of several texts: ``hash``, byte ``start`` and ``end`` in ``raw`` (the texts, each
    followed by a newline), and ``bounds``: text i has the words bounds[i] to bounds[i+1]."""

    def __init__(self, texts: list[bytes], lower: bool = True, separators: np.ndarray = WHITE):
        self.raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        if lower:
            self.raw = LOWER[self.raw]
        white = separators[self.raw]
        edges = np.flatnonzero(np.diff(white, prepend=True))
        self.start, self.end = edges[0::2], edges[1::2]
        self.offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        self.bounds = np.searchsorted(self.start, self.offset)
        length = self.end - self.start
        first = np.cumsum(length) - length
        self.hash = run_hashes(self.raw[~white], first, first + length)

    def __len__(self) -> int:
        return len(self.hash)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
    return mix(total + np.uint64(n))


def byte_texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their texts, about ``limit`` bytes of text and at most ``rows`` at a time, so that memory follows neither
    the batch size nor the number of long texts (one text is never split)."""
    for batch in batches:
        size = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text).cast(pa.binary()))])
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(size, size[at] + limit, side="right")) - 1))
            part = batch.slice(at, to - at)
            yield part, byte_texts(part.column(text))
            at = to


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.  Where it is unset, a
    local session (tests) gets a scratch folder; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_qualab_scratch", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith(("local[", "local")) or "cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark._qualab_scratch = tempfile.mkdtemp(prefix="qualab-llm-")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again: it is computed once, its lineage
    ends there, and the loss of an executor costs no more than its unfinished tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/qualab-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


BITS = 1 << 23


def bitmap(ids: DataFrame) -> np.ndarray:
    """Packed bits of a fixed number (1 MB) at the hashes of ``ids`` (one long column)."""
    c = F.col(ids.columns[0])
    on = np.zeros(BITS, bool)
    on[ids.where(c.isNotNull()).select(F.pmod(F.xxhash64(c), F.lit(BITS)).cast("int").alias("p")).distinct().toArrow()["p"].to_numpy()] = True
    return np.packbits(on)


def split(docs: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that may have one of the ``ids``, and those that have none.

    Only the first need a join, so most texts stay where they are; a row of the first kind may have none.
    """
    held = docs.sparkSession.sparkContext.broadcast(bitmap(ids))
    names = docs.columns
    placed = docs.withColumn("_qualab_p", F.coalesce(F.pmod(F.xxhash64(key), F.lit(BITS)).cast("int"), F.lit(-1)))

    def some(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            on = np.unpackbits(held.value).astype(bool)
            for batch in batches:
                p = batch.column("_qualab_p").to_numpy()
                yield batch.filter(pa.array(((p >= 0) & on[p]) == wanted)).select(names)

        return placed.mapInArrow(run, docs.schema)

    return some(True), some(False)
