"""Best-fit packing of tokenised documents by the linear grouping scheme.

Pieces are of 1 to ``capacity`` tokens, so their histogram is bounded and holds all that the plan needs:

1. lengths above ``capacity / SMALL`` are put in groups of about equal cardinality, each rounded up to its
   largest length;
2. for these few sizes, column generation finds the configurations (multisets that fit a sequence) and how
   often to use each; what rounding the counts down leaves over is placed in step 4;
3. actual lengths take the slots of their group, largest first, which leaves more room than planned;
4. left-over large lengths, then the small ones, go best-fit: each to the least room that holds it.

The plan is a list of runs (so many sequences alike).  It is turned into a table (length, first rank ->
sequence, offset), whose size follows the number of different lengths, not of documents; the pieces are
ranked within their length, in blocks of bounded size, and look their place up.
"""

from __future__ import annotations

import base64
import itertools
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, WHITE, chunks, run_hashes, stored, table

CAPACITY = 2048
GROUPS = 64
SMALL = 8  #: lengths up to capacity / SMALL are small
BLOCK_ROWS = 50_000  #: pieces of one length are ranked in blocks of about so many
CACHED_PARTS = 2_000_000
#: a character of Unicode's white space that has two bytes or more, before one of ASCII
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000][ \t\n\v\f\r]")
LATIN = re.compile("[\x00-\x7f\u00c0-\u017f]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts; a text is cut into parts (white space with the word after it) that are encoded once.

    The tokenizer's pattern never joins a character with white space after it, so parts are independent; a
    text in which white space beyond ASCII comes before such a cut is taken whole.  Parts are known by
    64-bit hashes in a sorted table of bounded size.  Latin parts that are new go to the same vocabulary in
    ``tiktoken``, which gives the same ids in a third of the time; all others to ``tokenizers``.
    """

    def __init__(self, file: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.marks = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            pairs = (line.split() for line in open(ranks, "rb"))
            self.fast = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                          mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs})
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = [np.zeros(0, np.uint32)]
        self.total = 0

    def _new(self, part: bytes) -> list[int]:
        text = part.decode()
        if self.fast and LATIN.fullmatch(text) and not any(m in text for m in self.marks):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            return [np.zeros(0, np.uint32) for _ in texts]
        stop = np.cumsum([len(t) for t in texts])
        white = WHITE[data]
        ends = np.zeros(len(data), bool)
        ends[:-1] = ~white[:-1] & white[1:]
        for t, e in zip(texts, stop):
            if not t.isascii() and WIDE_SPACE.search(t.decode()):
                ends[e - len(t) : e] = False
        ends[stop[stop > 0] - 1] = True
        end = np.flatnonzero(ends) + 1
        start = np.concatenate([[0], end[:-1]])
        part, index, at = np.unique(run_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHED_PARTS:
            self._forget()
        place = np.searchsorted(self.known, part)
        fresh = np.ones(len(part), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != part[inside]
        if fresh.any():
            found = [self._new(raw[start[i] : end[i]]) for i in index[fresh]]
            size = np.array([len(x) for x in found], np.int64)
            flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum()))
            self.first = np.insert(self.first, place[fresh], self.total + np.cumsum(size) - size)
            self.size = np.insert(self.size, place[fresh], size)
            self.known = np.insert(self.known, place[fresh], part[fresh])
            self.ids = [np.concatenate([*self.ids, flat])]
            self.total += len(flat)
            place = np.searchsorted(self.known, part)
        first, size = self.first[place][at], self.size[place][at]
        before = np.cumsum(size) - size
        out = self.ids[0][np.arange(int(size.sum())) + np.repeat(first - before, size)]
        bounds = np.concatenate([before, [len(out)]])[np.searchsorted(end, stop, side="right")]
        return np.split(out, bounds)[:-1]


@lru_cache(2)
def _encoder(file: str) -> Encoder:
    ranks = file.removesuffix(".json") + ".tiktoken"
    return Encoder(file, ranks if os.path.exists(ranks) else None)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every row of ``docs`` as ids and a closing id 0.

    Only a longer one is cut; the pieces after the first have ``capacity`` ids.  Null text counts as empty.
    """
    source = docs.select("doc_id", "text")
    schema = source.select("doc_id", F.lit(0).alias("piece"), *(F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for part, texts in chunks(batches, limit=CHUNK_BYTES // 4):  # parts and ids of a text take many times its size
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(texts)):
                ids = ids.astype("<u4").tobytes() + b"\0\0\0\0"
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=schema.names)

    return source.mapInArrow(run, schema)


# ---- the plan, over the histogram of lengths ---------------------------------------------------------------

def _best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is in the multiset of greatest worth that fits (few items: one layer for each)."""
    best = np.zeros(capacity + 1)
    taken: list[np.ndarray] = []
    for _ in range(capacity // min(sizes)):
        new, choice = best.copy(), np.full(capacity + 1, -1)
        for g, s in enumerate(sizes):
            value = best[: capacity + 1 - s] + worth[g]
            more = value > new[s:] + 1e-12
            new[s:][more], choice[s:][more] = value[more], g
        if (choice < 0).all():
            break
        taken.append(choice)
        best = new
    count, room = np.zeros(len(sizes)), capacity
    for choice in reversed(taken):
        if choice[room] >= 0:
            count[choice[room]] += 1
            room -= sizes[choice[room]]
    return count


def configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used: the least sum that covers ``demand`` (fractions allowed).

    Column generation: from one configuration per size, the configuration that gains most at the current
    prices enters until none gains.
    """
    columns = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag(1 / np.diag(columns))
    for _ in range(60 * len(sizes)):
        price = inverse.sum(axis=0)
        entering = _best_configuration(sizes, price, capacity)
        if price @ entering <= 1 + 1e-3:
            break
        step, use = inverse @ entering, inverse @ demand
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[:, out] = entering
        inverse[out] /= step[out]
        for i in np.flatnonzero(np.abs(step) > 1e-12):
            if i != out:
                inverse[i] -= step[i] * inverse[out]
    use = np.maximum(inverse @ demand, 0)
    return [(columns[:, j], float(use[j])) for j in range(len(sizes)) if use[j] > 1e-9]


class Runs:
    """Runs of like sequences, found by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]  # (count, ((length, copies), ...))

    def add(self, count: int, content: tuple) -> None:
        if count:
            self.by_room[self.capacity - sum(n * k for n, k in content)].append((count, content))

    def place(self, length: int, count: int) -> None:
        """Best fit for ``count`` pieces of one length."""
        room = length
        while count:
            while room <= self.capacity and not self.by_room[room]:
                room += 1
            if room > self.capacity:
                fit = self.capacity // length
                self.add(count // fit, ((length, fit),))
                if count % fit:
                    self.add(1, ((length, count % fit),))
                return
            runs, content = self.by_room[room].pop()
            fit = min(room // length, count)
            used = min(runs, count // fit)
            self.add(runs - used, content)
            self.add(used, (*content, (length, fit)))
            count -= used * fit


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple]]:
    """Runs (number of sequences, ((length, copies), ...)) that hold exactly the histogram's pieces."""
    left = dict(histogram)
    runs = Runs(capacity)
    runs.add(left.pop(capacity, 0), ((capacity, 1),))
    large = sorted((n for n in left if n > capacity // SMALL), reverse=True)
    if large:
        total = sum(left[n] for n in large)
        members: list[list[int]] = [[]]
        seen = 0
        for n in large:  # a group ends where its share of the pieces is reached
            if members[-1] and seen >= total * len(members) / groups:
                members.append([])
            members[-1].append(n)
            seen += left[n]
        sizes = [m[0] for m in members]
        demand = np.array([float(sum(left[n] for n in m)) for m in members])
        queue = [[n for n in reversed(m)] for m in members]  # largest last

        def take(g: int, count: int) -> list[tuple[int, int]]:
            """The next ``count`` pieces of group g as (length, number); 0 stands for a slot without a piece."""
            out = []
            while count and queue[g]:
                n = queue[g][-1]
                k = min(count, left[n])
                out.append((n, k))
                left[n] -= k
                count -= k
                if not left[n]:
                    queue[g].pop()
            return [*out, (0, count)] if count else out

        chosen = sorted(configurations(sizes, demand, capacity), key=lambda x: [-a for a in x[0]])
        for config, use in chosen:
            times = int(use + 1e-7)
            slots = [take(g, times) for g in range(len(sizes)) for _ in range(int(round(config[g])))] if times else []
            while slots and slots[0]:
                k = min(s[-1][1] for s in slots)
                content = tuple((s[-1][0], 1) for s in slots if s[-1][0])
                runs.add(k, content if content else ())
                for s in slots:
                    n, c = s.pop()
                    if c > k:
                        s.append((n, c - k))
    for n in sorted(left, reverse=True):
        runs.place(n, left[n])
    return [(count, content) for runs_ in runs.by_room for count, content in runs_ if content]


def places(runs: list[tuple[int, tuple]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset) by length and rank; ranks run on, a sequence each."""
    rows, next_rank, sequence = [], {}, 0
    for count, content in runs:
        offset = 0
        for length, copies in content:
            for _ in range(copies):
                rank = next_rank.get(length, 0)
                rows.append((length, rank, sequence, offset))
                next_rank[length] = rank + count
                offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    Repeated rows are packed once each; an empty table gives no rows.
    """
    rows = stored(pieces(docs, tokenizer or default_tokenizer(), capacity)
                  .withColumn("_row", F.monotonically_increasing_id()), "packing-pieces")
    blocks = max(1, rows.count() // BLOCK_ROWS)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    counts = rows.groupBy("length", "_block").agg(F.count("*").alias("n")).toArrow().sort_by([("length", "ascending"), ("_block", "ascending")])
    length, block, n = (counts[c].to_numpy() for c in ("length", "_block", "n"))
    before = np.cumsum(n) - n
    first = before - before[np.searchsorted(length, length)]  # rank of each block's first piece in its length
    histogram = {int(k): int(n[length == k].sum()) for k in np.unique(length)}
    where = places(plan(histogram, capacity))
    held = rows.sparkSession.sparkContext.broadcast(
        (length * blocks + block, first, where[:, 0], where[:, 1], where[:, 2], where[:, 3]))

    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_block").orderBy("_row")) - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = rows.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, at_length, at_rank, sequence, offset = held.value
        starts = np.searchsorted(at_length, np.arange(capacity + 2))
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy() + first[np.searchsorted(keys, n * blocks + batch.column("_block").to_numpy())]
            # one search over (length, rank): ranks of one length lie below `wide`
            wide = np.int64(1 << 45)
            place = np.searchsorted(at_length * wide + at_rank, n * wide + rank, side="right") - 1
            assert (place >= starts[n]).all()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence[place] + rank - at_rank[place]), pa.array(offset[place])],
                names=schema.names)

    return ranked.select(*names, "_block", F.col("_rank").cast("long").alias("_rank")).mapInArrow(run, schema)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of ``docs``."""
    return pack(docs)
