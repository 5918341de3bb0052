"""Sharding by proportional stratified interleaving: every shard has the mixture of the whole.

Rows are shuffled within their source (by a seeded hash of the id), ranked there, and all rows are put in
the order of their fractional rank ``(rank + phase) / rows of the source``.  The phase spreads sources of
equal size evenly over [0, 1): the j-th of m, in a seeded order, has (j + 1/2) / m, so that many small
sources interleave too.  Cutting this order into equal runs gives shards whose row counts differ by one at
most (law ``rows``) and in which each source has its share of the rows, give or take a few.

No task sees a whole source: ranks come from buckets of the hash, places from slices of the fractional rank,
and small tables of counts give each bucket and slice its offset.  A bucket that repeated ids make large is
cut again by row.

Null ids, sources and texts: a null source is a source of its own, a null id hashes like any other value, a
null text has no bytes.  Repeated rows are rows of their own; equal texts are not kept together (the mixture
rules, not the group).  Columns beyond the named ones play no part, whatever their names.  An empty table
gives no rows.  Which row comes first among repeated ids depends on the order of the input files alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARDS = 40
SEED = 17
HASH_BITS = 60
BUCKET_ROWS = 100_000  #: rows that a bucket or slice has on average, on tables of more than LEAST_BITS fill
LEAST_BITS = 8
MOST_HOT = 1 << 14  #: buckets that can be cut again: a bucket counts as large beyond this share of all rows


def hash_60(seed: int, value: Column) -> Column:
    """60 bits of an MD5 of seed and value: the same number in any engine that has MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(value.cast("string"), F.lit("-"))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _offsets(rows: DataFrame, group: str, cells: list[str]) -> DataFrame:
    """group, cells, size (rows of the group) and before (rows of the group's earlier cells)."""
    within = Window.partitionBy(group)
    return rows.groupBy(group, *cells).agg(F.count("*").alias("in_cell")).select(
        group, *cells, F.sum("in_cell").over(within).alias("size"),
        (F.sum("in_cell").over(within.orderBy(*cells)) - F.col("in_cell")).alias("before"))


def _ranked(rows: DataFrame, cell: list[str], order: list[str], offsets: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``offsets`` and ``rank`` (from 0) within the group, by cell, then ``order``."""
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1
    return rows.withColumn("nth", nth).join(offsets, cell).withColumn("rank", F.col("before") + F.col("nth")).drop("nth", "before")


def _phases(rows: DataFrame, seed: int, bits: int) -> DataFrame:
    """stratum, phase: the place of each stratum among those of its size."""
    strata = rows.groupBy("stratum").agg(F.count("*").alias("rows")).withColumn("hash", hash_60(seed, F.col("stratum")))
    strata = strata.withColumn("bucket", F.shiftright("hash", HASH_BITS - bits))
    ranked = _ranked(strata, ["rows", "bucket"], ["hash", "stratum"], _offsets(strata, "rows", ["bucket"]))
    return ranked.select("stratum", ((F.col("rank").cast("double") + 0.5) / F.col("size").cast("double")).alias("phase"))


def interleave(docs: DataFrame, columns: Sequence[str] | None = None, shards: int = SHARDS, stratum: str = "source",
               key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """row (a struct of ``columns``, all if None), stratum_rank, shard (0 to shards - 1) and slot (gapless from 0 in
    each shard) of every row of ``docs``."""
    rows = stored(docs.select(
        F.struct(*(F.col(f"`{c}`") for c in columns or docs.columns)).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("-")).alias("stratum"),
        hash_60(seed, F.col(key)).alias("hash"), F.monotonically_increasing_id().alias("id")), "sharding")
    n = rows.count()
    bits = max(LEAST_BITS, (n // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("bucket", F.shiftright("hash", HASH_BITS - bits))
    large = max(4 * BUCKET_ROWS, n // MOST_HOT)
    hot = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("held")).where(F.col("held") > large)
    rows = rows.join(F.broadcast(hot), ["stratum", "bucket"], "left").withColumn(  # at most MOST_HOT rows, by its threshold
        "part", F.when(F.col("held").isNull(), F.lit(0)).otherwise(
            F.expr(f"pmod(xxhash64({seed}, id), held div {BUCKET_ROWS} + 1)")).cast("long"))

    cell = ["stratum", "bucket", "part"]
    offsets = _offsets(rows, "stratum", cell[1:]).join(_phases(rows, seed, bits), "stratum")
    ranked = _ranked(rows.drop("held"), cell, ["hash", "id"], offsets)
    ranked = ranked.withColumn("fraction", (F.col("rank").cast("double") + F.col("phase")) / F.col("size").cast("double"))
    ranked = ranked.withColumn("slice", F.least(F.floor(F.col("fraction") * F.lit(1 << bits)), F.lit((1 << bits) - 1)))

    slices = ranked.groupBy("slice").agg(F.count("*").alias("held")).select(
        "slice", (F.sum("held").over(Window.orderBy("slice")) - F.col("held")).alias("slices_before"))
    placed = ranked.withColumn("nth", F.row_number().over(
        Window.partitionBy("slice").orderBy("fraction", "stratum", "rank")) - 1).join(slices, "slice")
    cut = placed.withColumn("place", F.col("slices_before") + F.col("nth")).withColumn(
        "shard", F.expr(f"(place * {shards}L) div {max(n, 1)}L").cast("int"))
    return cut.select("row", F.col("rank").alias("stratum_rank"), "shard",
                      F.expr(f"place - (shard * {n}L + {shards - 1}L) div {shards}L").alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, files: int | None = None, **how) -> None:
    """Whole rows of ``docs`` as Parquet below ``folder/shard=<k>``: ``doc`` (all columns) and ``slot``.

    Files hold runs of the interleaved order, sorted by slot, about ``files`` in all: a shard may have several.
    """
    rows = interleave(docs, None, shards, **how).select(F.col("row").alias("doc"), "slot", "shard")
    files = files or max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source, stratum_rank of every row of ``documents``."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return interleave(docs).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row.source", "stratum_rank")


# DuckDB: crc32 by its table of bytes, which a rule builds; the last row of `rest` is the remainder of byte 255.
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """DuckDB expression: unsigned crc32 of the UTF-8 bytes of ``text``; needs ``t`` of CRC_TABLE."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({text}))),
        lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


def _hash_sql(value: str) -> str:
    return f"('0x' || substr(md5('{SEED}|' || coalesce({value}::VARCHAR, '-')), 1, {HASH_BITS // 4}))::BIGINT"


OP11_SQL = f"""
WITH {CRC_TABLE},
docs AS (SELECT *, coalesce('=' || source, '-') AS stratum, {_hash_sql('doc_id')} AS h FROM documents),
strata AS (SELECT stratum, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM docs GROUP BY stratum),
phases AS (SELECT *, (row_number() OVER (PARTITION BY n ORDER BY {_hash_sql('stratum')}) - 1)::DOUBLE AS j, count(*) OVER (PARTITION BY n) AS m FROM strata),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) - 1 AS stratum_rank FROM docs JOIN phases USING (stratum)),
placed AS (SELECT *, row_number() OVER (ORDER BY (stratum_rank::DOUBLE + (j + 0.5::DOUBLE) / m::DOUBLE) / n::DOUBLE, stratum, stratum_rank) - 1 AS place
    FROM ranked),
cut AS (SELECT *, ((place * {SHARDS}) // total)::INT AS shard FROM placed)
SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32, 'rows' AS law, shard,
    place - (shard::BIGINT * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard, source, stratum_rank
FROM cut, crc_table"""
