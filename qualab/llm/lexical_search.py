"""Ranked lexical search: for each query item the best documents, by presence masks.

A document is read once: its number of terms and its counts of the terms that queries have (a sparse row).
Then each task goes through its documents in chunks.  In a chunk, every item's documents are grouped by the
mask of the item's terms that they hold (bit j: the j-th term), built with bitwise operations from the
chunk's posting lists.  A mask's largest possible score is the sum over its terms of weight x the term's
largest impact in the chunk.  Masks are evaluated by descending largest score until the next one lies below
the item's k-th best score so far; what is left cannot enter the result.  The k best of each task are merged
in two steps (per group of tasks, then per item).  The result is exact.

Items are taken in blocks of bounded text, so that what is sent to the tasks (the block's terms) is bounded.

Null, empty and term-less texts have no terms and are not counted.  Items without terms have no rows.
Repeated documents are documents of their own, repeated items items of their own (told apart within the
operator; rows with one item_id then repeat ranks).  A null id comes after the others among equal scores.
Empty tables give no rows.  Only the named columns are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, Words, chunks, stored, table

TOP = 50
BLOCK_BYTES = 2_000_000  #: text of the items that are searched in one pass
CHUNK_DOCS = 16_384
NO_TERM = np.zeros(256, bool)  #: bytes between terms: ASCII other than digits and letters
NO_TERM[:128] = True
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    NO_TERM[_first : _last + 1] = False
assert NO_TERM[WHITE].all()
NULL_ID = np.iinfo(np.int64).max


@dataclass
class Queries:
    """The items of a block: ``vocabulary`` (sorted hashes) and each item's terms as places in it."""

    number: list[int]
    vocabulary: np.ndarray
    terms: list[np.ndarray]

    @classmethod
    def of(cls, numbers: list[int], texts: list[bytes]) -> Queries:
        words = Words(texts, True, NO_TERM)
        vocabulary = np.unique(words.hash)
        place = np.searchsorted(vocabulary, words.hash)
        terms = [np.unique(place[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:])]
        return cls(numbers, vocabulary, terms)


def sparse_rows(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """id, n (terms with repeats), terms (places in the vocabulary), counts: of each document with a term."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for part, texts in chunks(batches):
            words = Words(texts, True, NO_TERM)
            place = np.searchsorted(known, words.hash)
            place[place == len(known)] = 0
            hit = known[place] == words.hash if len(known) else np.zeros(len(words), bool)
            pair, count = np.unique(words.text_of[hit] * np.int64(max(len(known), 1)) + place[hit], return_counts=True)
            doc = pair // max(len(known), 1)
            bounds = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
            out = pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(words.counts.astype(np.int64)),
                 pa.ListArray.from_arrays(bounds, pa.array((pair % max(len(known), 1)).astype(np.int32))),
                 pa.ListArray.from_arrays(bounds, pa.array(count.astype(np.int32)))], names=["id", "n", "terms", "counts"])
            yield out.filter(pa.array(words.counts > 0))

    return docs.mapInArrow(run, "id long, n long, terms array<int>, counts array<int>")


def document_frequency(rows: DataFrame, size: int) -> np.ndarray:
    """How many rows hold each of the ``size`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], names=["term", "n"])

    found = rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


class Best:
    """The k best (score, id) of an item so far; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int:
        """No document with a lower score can enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        on = score >= self.floor
        score, ids = np.concatenate([self.score, score[on]]), np.concatenate([self.id, ids[on]])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


def mask_groups(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``masks`` (documents x 64-bit words) and the number of each document's row."""
    if masks.shape[1] == 1:
        distinct, group = np.unique(masks[:, 0], return_inverse=True)
        return distinct[:, None], group
    distinct, group = np.unique(masks, axis=0, return_inverse=True)
    return distinct, group.reshape(-1)


def mask_bounds(distinct: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Sum of ``most`` over each mask's bits, a byte of the mask at a time."""
    out = np.zeros(len(distinct), np.int64)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for at in range(0, len(most), 8):
        part = most[at : at + 8]
        sums = bits[:, : len(part)] @ part
        out += sums[(distinct[:, at // 64] >> np.uint64(at % 64)).astype(np.uint8)]
    return out


class Chunk:
    """Posting lists of some documents: of each term the documents (ascending) and their impacts."""

    def __init__(self, batch: pa.RecordBatch, docs: int, tokens: int, size: int):
        self.ids = batch.column("id").fill_null(NULL_ID).to_numpy()
        length = 50 + (50 * batch.column("n").to_numpy() * docs) // tokens
        lists = batch.column("terms")
        term = lists.flatten().to_numpy()
        tf = batch.column("counts").flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        order = np.argsort(term, kind="stable")
        self.doc, tf = doc[order], tf[order]
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * length[self.doc])
        self.bounds = np.searchsorted(term[order], np.arange(size + 1))

    def __len__(self) -> int:
        return len(self.ids)

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best) -> int:
        """Brings the item's best documents of this chunk into ``best``; how many documents were scored."""
        spans = [slice(self.bounds[t], self.bounds[t + 1]) for t in terms]
        most = np.array([int(self.impact[s].max()) if s.stop > s.start else 0 for s in spans], np.int64) * weight
        order = np.argsort(-most, kind="stable")
        order = order[most[order] > 0]
        if not len(order) or most.sum() < best.floor:
            return 0
        masks = np.zeros((len(self), -(-len(order) // 64)), np.uint64)
        for j, t in enumerate(order):
            masks[self.doc[spans[t]], j // 64] |= np.uint64(1) << np.uint64(j % 64)
        distinct, group = mask_groups(masks)
        bound = mask_bounds(distinct, most[order])
        ranked = np.argsort(-bound, kind="stable")
        size = np.bincount(group, minlength=len(distinct))
        members = np.argsort(group, kind="stable")
        first = np.cumsum(size) - size
        done, scored, step = 0, 0, 2 * best.k
        while done < len(ranked) and bound[ranked[done]] >= best.floor:
            # the next masks, of at most `step` documents unless one has more; those below the floor are left out
            ahead = np.cumsum(size[ranked[done:]])
            to = done + max(1, int(np.searchsorted(ahead, step, side="right")))
            take = ranked[done:to]
            take = take[bound[take] >= best.floor]
            chosen = np.sort(np.concatenate([members[first[g] : first[g] + size[g]] for g in take]))
            score = np.zeros(len(chosen), np.int64)
            for t in order:
                postings = self.doc[spans[t]]
                place = np.searchsorted(postings, chosen)
                place[place == len(postings)] = 0
                hit = postings[place] == chosen
                score[hit] += weight[t] * self.impact[spans[t]][place[hit]]
            best.add(score, self.ids[chosen])
            done, scored, step = to, scored + len(chosen), 2 * step
        return scored


def best_of_tasks(rows: DataFrame, queries: Queries, weight: np.ndarray, docs: int, tokens: int, k: int) -> DataFrame:
    """item (number), task, id, score: the k best documents of each task's rows."""
    held = rows.sparkSession.sparkContext.broadcast((queries.terms, queries.number, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, number, weight = held.value
        best = [Best(k) for _ in terms]
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_DOCS):
                chunk = Chunk(batch.slice(at, CHUNK_DOCS), docs, tokens, len(weight))
                for t, b in zip(terms, best):
                    if len(t):
                        chunk.search(t, weight[t], b)
        ids = np.concatenate([b.id for b in best]) if best else np.zeros(0, np.int64)
        score = np.concatenate([b.score for b in best]) if best else np.zeros(0, np.int64)
        item = np.repeat(np.array(number, np.int64), [len(b.id) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == NULL_ID), pa.array(score)], names=["item", "id", "score"])

    return rows.mapInArrow(run, "item long, id long, score long").withColumn("task", F.spark_partition_id())


def top_rows(found: DataFrame, k: int, tasks: int) -> DataFrame:
    """item, rank, id, score: the k best rows of each item, over groups of tasks first."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    group = F.pmod("task", F.lit(max(1, round(tasks ** 0.5)))).alias("group")
    part = found.select("item", "id", "score", group).withColumn(
        "rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).where(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(
        F.col("rank") <= k).select("item", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score of the ``k`` best documents with a score above 0 of every item."""
    spark = docs.sparkSession
    numbered = stored(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")), "search-items")
    size = numbered.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = int(size) // block_bytes + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    out = None
    for block in range(blocks):
        some = numbered.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "text").toArrow()
        queries = Queries.of(some["item"].to_pylist(), [(t or "").encode() for t in some["text"].to_pylist()])
        rows = stored(sparse_rows(texts, queries.vocabulary), "search-rows")
        n, total = rows.agg(F.count("*"), F.sum("n")).first()
        df = document_frequency(rows, len(queries.vocabulary))
        weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
        found = stored(best_of_tasks(rows, queries, weight, n, total or 1, k), "search-best")
        tasks = found.agg(F.count_distinct("task")).first()[0]
        part = top_rows(found, k, tasks)
        out = part if out is None else out.union(part)
    return out.join(numbered.select("item", "item_id"), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 50 best ``documents`` of each ``benchmark`` item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"""regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP13_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS doc, doc_id, unnest({_TERMS_SQL.format('text')}) AS term FROM documents),
sizes AS (SELECT doc, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY doc),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM sizes),
counts AS (SELECT doc, term, count(*) AS tf FROM words GROUP BY doc, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, total GROUP BY term),
items AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL.format('text')}) AS term FROM benchmark),
scores AS (SELECT item_id, doc, any_value(s.doc_id) AS doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // tokens))))::BIGINT AS score
    FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN sizes s USING (doc), total GROUP BY item_id, doc)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {TOP}"""
