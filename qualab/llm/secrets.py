"""Secret scans: credential spans, with the corpus-wide frequency of each candidate among its owners.

Three base kinds are always reported: ``assign`` (a named assignment), ``access`` (an access key id) and
``hex`` (a long run of hex digits).  Further candidates (provider tokens, key headers, random-looking
strings) come out of the same reading of the text, and the corpus decides about them: hashes of all
candidate values are counted by distinct owner and repository; what many owners have is a copied example,
what one owner (or few) has looks live.  Live ones are added to the spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored, table

# Fixed patterns of the base kinds (bytes: only ASCII letters have two cases).
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "provider", "header", "opaque")  #: in the order of equal starts; three base kinds
PROVIDER = re.compile(rb"(?:gh[opsu]_|glpat-|sk_live_|rk_live_|xox[abprs]-|AIza|eyJ)[A-Za-z0-9_.-]{16,}")
HEADER = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----")
OPAQUE = re.compile(rb"[A-Za-z0-9+/_-]{24,}")
OPAQUE_BITS = 4.0  #: entropy a byte from which a string with upper, lower and digits looks random
MAX_OWNERS = 2  #: a value of more owners is an example that was copied


def _random_looking(value: bytes) -> bool:
    """Lower, upper and digits in one string whose byte entropy is high."""
    if not (re.search(rb"[a-z]", value) and re.search(rb"[A-Z]", value) and re.search(rb"[0-9]", value)):
        return False
    share = np.bincount(np.frombuffer(value, np.uint8))
    share = share[share > 0] / len(value)
    return float(-(share * np.log2(share)).sum()) >= min(OPAQUE_BITS, 0.8 * np.log2(len(value)))


def find(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind number, start, end, value) in bytes; the value is what is hashed."""
    out = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in out)
    more = [(3, m.start(), m.end(), m[0]) for m in PROVIDER.finditer(text)]
    more += [(4, m.start(), m.end(), text[m.start() : m.end() + 80]) for m in HEADER.finditer(text)]
    more += [(5, m.start(), m.end(), m[0]) for m in OPAQUE.finditer(text) if _random_looking(m[0])]
    for kind, s, e, v in sorted(more):  # an added span stays clear of base spans and of earlier kinds
        if not any(s < y and x < e for x, y in base):
            out.append((kind, s, e, v))
            base.append((s, e))
    return sorted(out, key=lambda x: (x[1], x[0]))


CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())])


def candidates(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and ``found``: spans (kind, start, end in code points, hash of the value)."""
    text = "text" if "text" in columns else "_text"
    source = docs.select(*columns, *([] if text in columns else [F.col("text").alias("_text")]))
    schema = docs.select(*columns, F.expr(
        "cast(null as array<struct<kind:int,start:bigint,end:bigint,value:bigint>>)").alias("found")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, text):
            rows = []
            for content in texts:
                found = find(content)
                if found and not content.isascii():  # continuation bytes begin no code point
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(content, np.uint8) & 0xC0) != 0x80)])
                    found = [(k, int(points[s]), int(points[e]), v) for k, s, e, v in found]
                rows.append([{"kind": k, "start": s, "end": e, "value": xxhash.xxh64_intdigest(v) - (1 << 63)}
                             for k, s, e, v in found])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(rows, pa.list_(CANDIDATE))],
                                             names=[*columns, "found"])

    return source.mapInArrow(run, schema)


def ownership(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """value, owners, repositories: how many distinct owners and repositories have each candidate value.

    Two steps of grouping (distinct pairs first, combined before the shuffle), so that a value which a
    third of all rows has is no hot key.  A null owner or repository counts as one of its own.
    """
    seen = found.select(F.explode("found").alias("c"), F.col(owner).alias("_owner"), F.col(repository).alias("_repo"))
    pairs = seen.groupBy(F.col("c.value").alias("value"), "_owner", "_repo").agg(F.count("*").alias("n"))
    by_owner = pairs.groupBy("value", "_owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def judge(found: DataFrame, owner: str, repository: str, max_owners: int = MAX_OWNERS) -> DataFrame:
    """_row, n_live, n_example and the spans to add, for the rows of ``found`` that have candidates."""
    wide = ownership(found, owner, repository).where(F.col("owners") > max_owners).select(
        F.col("value").alias("_wide"))
    one = found.where(F.size("found") > 0).select("_row", F.explode("found").alias("c"))
    return one.join(wide, F.col("c.value") == F.col("_wide"), "left").groupBy("_row").agg(
        F.count(F.when(F.col("_wide").isNull(), 1)).alias("n_live"),
        F.count("_wide").alias("n_example"),
        F.collect_list(F.when(F.col("_wide").isNull() & (F.col("c.kind") >= 3),
                              F.struct("c.start", "c.kind", "c.end"))).alias("added"))


def live_spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id",
               max_owners: int = MAX_OWNERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with ``base`` and ``added``: arrays of (kind, start, end).

    ``base`` has all spans of the base kinds, ``added`` those of other kinds whose value at most
    ``max_owners`` owners have; ``n_live`` counts the spans of either whose value is so rare, ``n_example``
    the rest.  Null text counts as empty; repeated rows stay rows of their own.
    """
    columns = list(dict.fromkeys([*keep, owner, repository]))
    found = stored(candidates(docs.withColumn("_row", F.monotonically_increasing_id()), [*columns, "_row"]), "secrets")
    judged = judge(found, owner, repository, max_owners)
    base = F.expr("transform(filter(found, x -> x.kind < 3), x -> struct(x.start, x.kind, x.end))")
    return found.withColumn("base", base).join(judged, "_row", "left").select(
        *keep, "base", F.expr("coalesce(added, filter(base, x -> false))").alias("added"),
        F.expr("filter(found, x -> x.kind = 0)").alias("_a"), F.expr("filter(found, x -> x.kind = 1)").alias("_b"),
        F.expr("filter(found, x -> x.kind = 2)").alias("_c"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"),
        F.coalesce("n_example", F.lit(0).cast("long")).alias("n_example"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example of every row."""
    return live_spans(docs, keep=("doc_id",)).select(
        "doc_id", F.size("_a").cast("long").alias("n_assign"), F.size("_b").cast("long").alias("n_access"),
        F.size("_c").cast("long").alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), "n_live", "n_example")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secret spans (base and added) are replaced by ``[SECRET]``, n_chars follows."""
    names = docs.columns
    owner, repository = "source", "doc_id"
    rest = [F.col(c) for c in names if c != "text"]  # kept in one column, so that no name can clash
    row = docs.select(F.struct(*rest).alias("doc"), owner, repository, "text", F.monotonically_increasing_id().alias("_row"))
    found = stored(candidates(row, row.columns), "secret-docs")
    some = found.where(F.size("found") > 0)  # only these texts are shuffled
    judged = judge(found, owner, repository).select("_row", "added")
    base = F.expr("transform(filter(found, x -> x.kind < 3), x -> struct(x.start, x.kind, x.end))")
    spans = some.join(judged, "_row", "left").withColumn("spans", F.sort_array(F.concat(base, F.expr(
        "coalesce(added, cast(array() as array<struct<start:bigint,kind:int,end:bigint>>))"))))
    # overlapping spans leave the text once: each piece of text between spans starts at the largest end so far
    text = F.expr("""aggregate(spans, struct(cast(0 as bigint) as at, '' as out),
        (s, x) -> struct(greatest(s.at, x.end) as at,
                         case when x.start >= s.at then concat(s.out, substring(text, cast(s.at + 1 as int), cast(x.start - s.at as int)), '[SECRET]')
                              else s.out end as out),
        s -> concat(s.out, substring(text, cast(s.at + 1 as int))))""")
    done = spans.withColumn("changed", F.size("spans") > 0).withColumn("text", F.when(F.col("changed"), text).otherwise(F.col("text")))
    done = done.select("doc", "text", "changed").union(found.where(F.size("found") == 0).select("doc", "text", F.lit(False)))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        old = F.col("doc")[name]
        if name == "n_chars":
            old = F.when(F.col("changed"), F.length("text").cast(docs.schema[name].dataType)).otherwise(old)
        return old.alias(name)

    return done.select(*(column(c) for c in names))
