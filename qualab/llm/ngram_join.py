"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A text's set are the hashes of its distinct runs of five words (all its words as one, if fewer).  Equal
sets are one node.  Shingles have one global order, rare ones first: by the count of their hash bucket in
the whole corpus (a table of fixed size), then by hash.  Two sets that are similar enough share a shingle
among the first few of each in this order, so only these go to the join.

Links of different sets are found in two rounds, which together test each pair that could join two groups:

1. every set is paired with the least of the sets that begin the lists of its prefix shingles, which links
   large groups of near copies with as many pairs as members;
   three more rounds pair each set with a random one of another component in one of its lists;
2. all pairs within a list whose sets are still in different components, with the asymmetric prefixes of
   the longer and the shorter set.

Each pair passes the length filter, the positional filter (what can follow the shared shingle), in round 2
the sketch filter (512 bits of a set, whose difference is a least one of the sets), and the
suffix filter (the sets are cut at fixed hashes, the counts of the parts bound how much they can share), and is verified once, exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, mix, shingle_hashes, split, stored, table
from .components import components

SIZE = 5
BUCKETS = 1 << 22  #: hash buckets whose counts order the shingles
COUNT_BLOCK = 1 << 16
RANGE_SHINGLES = 8  #: the suffix filter has a hash range for about so many shingles of a set
ROUNDS = 3  #: rounds of one random pair a set, before all pairs
LIST_ROWS = 8192  #: lists of hot shingles are cut into parts of about so many rows
_ID = np.uint64((1 << 48) - 1)  #: shingles are known by 48 bits; texts of a chunk by 10, orders by 6
_ROWS = 1024
SKETCH = [f"k{i}" for i in range(8)]  #: 64 bits each: whether a set has an odd number of shingles at that place


def text_shingles(words: Words, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, order and 48-bit hash) of the shingles, distinct within each text and sorted.

    ``level`` has the order of each hash bucket (0 to 63; without it all are 0).  Text, order and hash are
    packed into one number, whose sorting is fast; there are at most _ROWS texts.
    """
    text, h = words.text_of, words.hash
    whole = np.flatnonzero(text[SIZE - 1 :] == text[: len(text) - SIZE + 1]) if len(text) >= SIZE else np.zeros(0, np.int64)
    keys, rows = [shingle_hashes(h, SIZE)[whole]], [text[whole]]
    for i in np.flatnonzero((words.counts > 0) & (words.counts < SIZE)):
        own = h[words.bounds[i] : words.bounds[i + 1]]
        keys.append(shingle_hashes(own, len(own)))
        rows.append(np.array([i]))
    keys = np.concatenate(keys) & _ID
    packed = np.concatenate(rows).astype(np.uint64) << np.uint64(54) | keys
    if level is not None:
        packed |= level[_bucket(keys)] << np.uint64(48)
    packed.sort()
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    packed = packed[new]
    return (packed >> np.uint64(54)).astype(np.int64), packed & np.uint64((1 << 54) - 1)


def _bucket(keys: np.ndarray) -> np.ndarray:
    return ((keys & _ID) >> np.uint64(26)).astype(np.int64)


def _set_ids(rows: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of shingles and hash of each text's set, and where its shingles begin."""
    n = np.bincount(rows, minlength=size)
    first = np.concatenate([[0], np.cumsum(n)])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix((keys & _ID) + np.uint64(1)), dtype=np.uint64)])
    return n, mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)), first


def _range_bits(n: np.ndarray) -> np.ndarray:
    """log2 of the number of hash ranges of a set of n shingles."""
    return np.maximum(2, np.ceil(np.log2(np.maximum(n, 1) / RANGE_SHINGLES))).astype(np.int64)


def _sketches(rows: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """The sketch of each text's set: what two of them differ by, their sets differ by at least."""
    width = 64 * len(SKETCH)
    odd = np.bincount(rows * width + (keys & np.uint64(width - 1)).astype(np.int64), minlength=size * width) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).reshape(size, len(SKETCH))


def _differ_little(a: str, b: str):
    """Whether the sketches (columns with suffix a and b) of sets of n{a} and n{b} shingles allow a link."""
    return _differ_little_of(lambda c: F.col(c + a), lambda c: F.col(c + b))


def _differ_little_of(a, b):
    """The same of columns that functions give by name: a Jaccard similarity of 0.75 leaves the sets a seventh of
    n + n as shingles that only one of them has."""
    differ = sum((F.bit_count(a(k).bitwiseXOR(b(k))) for k in SKETCH), F.lit(0))
    return 7 * differ <= a("n") + b("n")


def _digests(docs: DataFrame) -> DataFrame:
    """A row (doc_id, n, sid, ranges, sketch) of each text; and rows (block, counts) of shingle counts by bucket."""
    names = ["doc_id", "n", "sid", "ranges", *SKETCH, "block", "counts"]
    schema = (docs.select("doc_id").schema.simpleString()[7:-1] + ", n long, sid long, ranges binary, "
              + "".join(f"{k} long, " for k in SKETCH) + "block int, counts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, id_type = np.zeros(BUCKETS, np.uint32), pa.int64()
        for part, texts in chunks(batches, rows=_ROWS):
            rows, keys = text_shingles(Words(texts))
            np.add.at(count, _bucket(keys), 1)
            n, sid, first = _set_ids(rows, keys, len(texts))
            bits = _range_bits(n)
            start = np.concatenate([[0], np.cumsum(1 << bits)])
            cell = start[rows] + ((keys & _ID) >> (np.uint64(48) - bits[rows].astype(np.uint64))).astype(np.int64)
            cells = np.minimum(np.bincount(cell, minlength=start[-1]), 65535).astype("<u2")
            ids = part.column("doc_id")
            id_type, k = ids.type, len(texts)
            sketch = _sketches(rows, keys, k)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(sid.view(np.int64)),
                 pa.array([cells[a:b].tobytes() for a, b in zip(start, start[1:])], pa.binary()),
                 *(pa.array(x.copy()) for x in sketch.T), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        blocks = [i for i in range(BUCKETS // COUNT_BLOCK) if count[i * COUNT_BLOCK : (i + 1) * COUNT_BLOCK].any()]
        k = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()),
             *(pa.nulls(k, pa.int64()) for _ in SKETCH), pa.array(blocks, pa.int32()),
             pa.array([zlib.compress(count[i * COUNT_BLOCK : (i + 1) * COUNT_BLOCK].tobytes(), 1) for i in blocks], pa.binary())], names=names)

    return stored(docs.select("doc_id", "text").mapInArrow(run, schema), "ngram-digests")


def _bucket_counts(digests: DataFrame) -> np.ndarray:
    """Counts of all buckets: BUCKETS numbers, whatever the input."""

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(COUNT_BLOCK, np.int64)
        for x in part["counts"]:
            data = np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
            total += data if len(data) == COUNT_BLOCK else data.view(np.int64)
        return pa.table({"block": part["block"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    # sums first within 64 parts of the tasks, then over the parts
    rows = digests.where("block is not null").select("block", "counts")
    parts = rows.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
    for keys in (["block", "_part"], ["block"]):
        parts = parts.groupBy(*keys).applyInArrow(add, "block int, counts binary")
        parts = parts.withColumn("_part", F.lit(0)) if keys == ["block"] else parts
    out = np.zeros(BUCKETS, np.int64)
    for row in parts.select("block", "counts").toArrow().to_pylist():
        out[row["block"] * COUNT_BLOCK : (row["block"] + 1) * COUNT_BLOCK] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return out


def _postings(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """shingle (order and hash), part, sid, n, pos of the prefix of each text's set."""
    # a bucket holds many rare shingles; what it has beyond their usual number and its spread is a frequent one's
    usual = float(np.median(counts))
    excess = (counts - usual) / (3 * max(1.0, usual**0.5))
    level = np.where(excess > 1, np.minimum(1 + 4 * np.log2(np.maximum(excess, 1)), 63), 0).astype(np.uint64)
    parts = np.clip((counts - 2 * usual) / LIST_ROWS, 1, 1 << 14).astype(np.int64)
    held = docs.sparkSession.sparkContext.broadcast((level, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, parts = held.value
        for _, texts in chunks(batches, rows=_ROWS):
            rows, keys = text_shingles(Words(texts), level)
            n, sid, first = _set_ids(rows, keys, len(texts))
            pos = np.arange(len(rows)) - first[rows]
            use = np.flatnonzero(pos < (n - -(-3 * n // 4) + 1)[rows])
            r, s = rows[use], keys[use]
            cut = parts[_bucket(s)]  # 1: one list, as part -1
            part = np.where(cut > 1, (sid[r] % cut.astype(np.uint64)).astype(np.int32), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.view(np.int64)), pa.array(part), pa.array(sid[r].view(np.int64)),
                 pa.array(n[r].astype(np.int32)), pa.array(pos[use].astype(np.int32))], names=["s", "part", "sid", "n", "pos"])

    return docs.select("text").mapInArrow(run, "s long, part int, sid long, n int, pos int")


def _lists(postings: DataFrame) -> DataFrame:
    """The rows of lists with two different sets or more, each with the first set of its list (c, cn, cpos).

    Lists are sorted and read as a stream, so a long one needs no memory; a hot shingle's list comes in
    parts, whose rows all stay (alone in a part is not alone in the list).
    """
    names = ["s", "sid", "n", "pos", "c", "cn", "cpos", "cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the list (s, part) whose first row is out already
        held: list[np.ndarray] | None = None  # the first row of the list that the batch before ended in
        for batch in batches:
            s, part, sid, n, pos = (batch.column(c).to_numpy() for c in ("s", "part", "sid", "n", "pos"))
            if held is not None:
                s, part, sid, n, pos = (np.concatenate([h, x]) for h, x in zip(held, (s, part, sid, n, pos)))
            if not len(s):
                continue
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (part[1:] != part[:-1])
            fresh = new.copy()
            fresh[1:] |= sid[1:] != sid[:-1]  # a set that several equal texts have comes once
            head = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            size = np.bincount(head[fresh], minlength=len(s))[head]
            # the list at the end of the batch may go on: its center comes again in front of the next batch
            held = [x[[head[-1]]] for x in (s, part, sid, n, pos)]
            use = fresh & ((size > 1) | (part >= 0))
            if last is not None and last == (s[0], part[0]):
                use[0] = False  # a center that was out before
            last = (s[-1], part[-1]) if size[-1] > 1 else last if last == (s[-1], part[-1]) else None
            c = head[use]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s[use], sid[use], n[use], pos[use], sid[c], n[c], pos[c])]
                                             + [pa.array(part[use] >= 0)], names=names)

    rows = postings.repartition("s", "part").sortWithinPartitions("s", "part", "sid").mapInArrow(
        run, "s long, sid long, n int, pos int, c long, cn int, cpos int, cut boolean")
    return rows


def _possible(n1, pos1, n2, pos2):
    """Length filter, and positional filter at a shared shingle (at the first one it always holds for a link)."""
    need = 3 * (n1 + n2)
    return (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)) & (7 * F.least(n1 - pos1, n2 - pos2) >= need)


def _suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets may be similar enough by the counts of their hash ranges.

    |x| + |y| - 2 * overlap is at least what the ranges differ by, and the overlap must be 3 (|x| + |y|) / 7.
    """
    for batch in batches:
        nx, ny = batch.column("nx").to_numpy(), batch.column("ny").to_numpy()
        keep = np.zeros(batch.num_rows, bool)
        for i, (a, b) in enumerate(zip(batch.column("rx"), batch.column("ry"))):
            a, b = (np.frombuffer(v.as_buffer(), "<u2").astype(np.int64) for v in (a, b))
            size = min(len(a), len(b))
            differ = np.abs(a.reshape(size, -1).sum(1) - b.reshape(size, -1).sum(1)).sum()
            keep[i] = 7 * differ <= nx[i] + ny[i]
        yield batch.select(["x", "y", "nx", "ny"]).filter(pa.array(keep))


def _verified(pairs: DataFrame, sets: DataFrame, digests: DataFrame, name: str) -> DataFrame:
    """The pairs (x, y) whose sets are similar enough.  Only sets of pairs are shuffled, not those of all texts."""
    ends = lambda df: df.select(F.col("x").alias("sid")).union(df.select("y"))
    some, _ = split(digests.where("n > 0").select("sid", "n", "ranges"), "sid", ends(pairs))
    ranges = some.groupBy("sid").agg(F.min(F.struct("n", "ranges")).alias("r"))
    a = ranges.select(F.col("sid").alias("x"), F.col("r.n").alias("nx"), F.col("r.ranges").alias("rx"))
    b = ranges.select(F.col("sid").alias("y"), F.col("r.n").alias("ny"), F.col("r.ranges").alias("ry"))
    joined = pairs.join(a, "x").join(b, "y").where((4 * F.least("nx", "ny") >= 3 * F.greatest("nx", "ny")))
    left = stored(joined.mapInArrow(_suffix_filter, "x long, y long, nx long, ny long"), f"{name}-pairs")
    sets, _ = split(sets, "sid", ends(left))
    sx = sets.select(F.col("sid").alias("x"), F.col("set").alias("set_x"))
    sy = sets.select(F.col("sid").alias("y"), F.col("set").alias("set_y"))
    common = F.size(F.array_intersect("set_x", "set_y"))
    return left.join(sx, "x").join(sy, "y").where(7 * common >= 3 * (F.col("nx") + F.col("ny"))).select("x", "y")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, set of the ``wanted`` sets, each once.

    A bitmap of fixed size holds most other texts back in their tasks; what it lets through in error goes
    with the join.
    """
    bits = 1 << 23
    on = np.zeros(bits, bool)
    on[wanted.select(F.expr(f"int(sid & {bits - 1})").alias("p")).distinct().toArrow()["p"].to_numpy()] = True
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(on))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(held.value).astype(bool)
        done: set[int] = set()  # equal sets of a task leave it once
        for _, texts in chunks(batches, rows=_ROWS):
            rows, keys = text_shingles(Words(texts))
            n, sid, first = _set_ids(rows, keys, len(texts))
            use = []
            for i in np.flatnonzero((n > 0) & on[(sid & np.uint64(bits - 1)).astype(np.int64)]).tolist():
                if int(sid[i]) not in done:
                    done.add(int(sid[i]))
                    use.append(i)
            if len(done) > 1_000_000:
                done.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid[use].view(np.int64)), pa.array([keys[first[i] : first[i + 1]].view(np.int64) for i in use], pa.list_(pa.int64()))],
                names=["sid", "set"])

    return docs.select("text").mapInArrow(run, "sid long, set array<long>").join(wanted, "sid", "left_semi").dropDuplicates(["sid"])


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, sid) of all texts, and (node, component) of the sets that have links."""
    digests = _digests(docs)
    lists = stored(_lists(_postings(docs, _bucket_counts(digests))), "ngram-lists")
    possible = _possible(F.col("n"), F.col("pos"), F.col("cn"), F.col("cpos"))
    # each set with the least of the sets that begin its lists: as many pairs as sets
    star = lists.where((F.col("sid") != F.col("c")) & possible).groupBy("sid").agg(F.min("c").alias("c"))
    heads = lists.where("cut").select("s", F.col("c").alias("sid"), F.col("cn").alias("n"), F.col("cpos").alias("pos")).distinct()
    first = heads.groupBy("s").agg(F.min(F.struct("sid", "n", "pos")).alias("h"))
    of_parts = heads.join(first, "s").where((F.col("sid") != F.col("h.sid")) & _possible(
        F.col("n"), F.col("pos"), F.col("h.n"), F.col("h.pos"))).select("sid", F.col("h.sid"))
    ordered = lambda df, a, b: df.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    sets = stored(_sets(docs, lists.select("sid").distinct()), "ngram-sets")
    tried = stored(ordered(star.union(of_parts), "sid", "c"), "ngram-tried")
    links = stored(_verified(tried, sets, digests, "ngram-star"), "ngram-links")

    def mixed(lists: DataFrame, name: str) -> DataFrame:
        """The rows of lists that still have sets of different components, with the component (g); components only grow."""
        group = components(links, "ngram-groups").select(F.col("node").alias("sid"), "component")
        rows = lists.join(group, "sid", "left").withColumn("g", F.coalesce("component", "sid")).select("s", "sid", "n", "pos", "g")
        some = rows.groupBy("s").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a != b").select("s")
        return stored(rows.join(some, "s"), name)

    rows = lists
    for turn in range(ROUNDS):
        # each set with a set of another component, taken at random (by hash) from one of its lists
        rows = mixed(rows, "ngram-mixed")
        pick = F.xxhash64("sid", F.lit(turn))
        other = rows.groupBy("s").agg(F.min(F.struct(pick.alias("h"), "sid", "n", "pos", "g")).alias("o"))
        pairs = rows.join(other, "s").where((F.col("g") != F.col("o.g")) & _possible(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos")))
        pairs = pairs.groupBy("sid").agg(F.min(F.struct("o.h", "o.sid")).alias("o")).select("sid", F.col("o.sid").alias("c"))
        new = stored(ordered(pairs, "sid", "c").join(tried, ["x", "y"], "left_anti"), "ngram-new")
        tried = tried.union(new)
        links = links.union(stored(_verified(new, sets, digests, "ngram-turn"), "ngram-links"))
    rows = mixed(rows, "ngram-rest")
    rows = rows.join(digests.where("n > 0").select("sid", *SKETCH).dropDuplicates(["sid"]), "sid")
    rest = _pairs_of_groups(rows)
    new = stored(ordered(rest, "sid", "sid2").join(tried, ["x", "y"], "left_anti"), "ngram-new")
    more = stored(_verified(new, sets, digests, "ngram-rest"), "ngram-links")
    return digests.where("block is null").select("doc_id", "n", "sid"), components(links.union(more), "ngram-groups")


def _with_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (s, sid, n, pos, g, sketch) of shorter sets with each other group (g2) of the list s that they may link to.

    Groups meet only if their lengths and the places of the shingle
    allow any pair.  Where a group has one set in the list, that set's own numbers (b_) take the other's place
    in the pair's filters, so a large group does not list its sets for each single one that is too different.
    """
    own = ["n", "pos", *SKETCH]
    groups = rows.groupBy("s", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"),
                                        F.when(F.count("*") == 1, F.min(F.struct(*own))).alias("b"))
    others = groups.select("s", *(F.col(c).alias(f"{c}2") for c in ("g", "lo", "hi", "rest", "b")))
    alike = lambda a, b: _differ_little_of(lambda c: F.col(f"{a}.{c}"), lambda c: F.col(f"{b}.{c}"))
    meet = groups.join(others, "s").where(
        F.expr("g <> g2 and 4 * hi >= 3 * lo2 and 4 * hi2 >= 3 * lo and 7 * least(rest, rest2) >= 3 * (lo + lo2)")
        & F.coalesce((F.col("b.n") <= F.col("b2.n")) & alike("b", "b2"), F.lit(True))).select(
        "s", "g", "g2", *(F.col(f"b2.{c}").alias(f"b_{c}") for c in own))
    # the shorter set with its short prefix
    single = (F.col("n") <= F.col("b_n")) & _possible(F.col("n"), F.col("pos"), F.col("b_n"), F.col("b_pos")) & _differ_little_of(
        F.col, lambda c: F.col(f"b_{c}"))
    short = rows.where("pos < n - ceil(6 * n / 7) + 1")
    return meet.join(short, ["s", "g"]).where(F.coalesce(single, F.lit(True))).drop(*(f"b_{c}" for c in own))


def _pairs_of_groups(rows: DataFrame) -> DataFrame:
    """Pairs (sid, sid2) of sets of different groups (g) in one list (s) that the filters leave."""
    # the longer set with its long prefix; pairs whose sketches differ too much are not made
    long = rows.select("s", *(F.col(c).alias(f"{c}2") for c in ("g", "sid", "n", "pos", *SKETCH)))
    return _with_groups(rows).join(long, ["s", "g2"]).where(
        (F.col("n") <= F.col("n2")) & _possible(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2")) & _differ_little("", "2"))


def ngram_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Links are of sets, so equal rows (or equal texts under other ids) are in one component; a text without
    words links with nothing.  A null id takes its component's least id.
    """
    rows, groups = similar_sets(docs)
    rows = rows.join(groups, rows["sid"] == groups["node"], "left").withColumn("_g", F.coalesce("component", "sid"))
    least = rows.where("n > 0").groupBy(F.col("_g").alias("_k")).agg(F.min("doc_id").alias("_least"))
    return rows.join(least, (F.col("_g") == F.col("_k")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of the least id stays."""
    gone = ngram_groups(docs).where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
