"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the *presence* of its words, word pairs and skip-grams (one or two words left
out), hashed to 64 bits; words end at white space and ASCII punctuation, A-Z are lower-cased.  The
labelled rows are dealt into shards of bounded size; each shard runs FTRL-proximal (per-coordinate
rates, L1 and L2) over its rows in one task, and the shards' weights are averaged (parameter mixing).
L1 leaves few weights, so the model is a small sorted table that every task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, Words, chunks, mix, remainder, signed, table

PAIRS = (1, 2, 3)  #: distance of the two words: a bigram, and skip-grams over one and two words
MAX_TRAIN_ROWS = 48_000  #: bound of the labelled sample
SHARD_ROWS = 5_000
BLOCK = 200  #: texts a shard hashes at a time
MAX_WEIGHTS = 1 << 17  #: bound of the broadcast model; the largest weights stay
MIN_ROWS = 5  #: a feature enters a shard's model when so many of its rows have it
ALPHA, BETA, L1, L2, PASSES = 3.0, 1.0, 5.0, 0.0, 8
THRESHOLD = 0.7


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of every word, pair and skip-gram; with repeats."""
    text, h = words.text_of, words.hash
    texts, hashes = [text], [h]
    for gap in PAIRS:
        same = text[gap:] == text[:-gap]
        texts.append(text[gap:][same])
        hashes.append(mix(h[:-gap] * np.uint64(0xD6E8FEB86659FD93) + h[gap:] + np.uint64(gap))[same])
    return np.concatenate(texts), np.concatenate(hashes)


def fit_shard(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over one shard's rows: feature hashes, weights, bias."""
    def block(k: int) -> tuple[np.ndarray, np.ndarray]:
        t, h = features(Words(texts[k : k + BLOCK], separators=PUNCTUATION))
        return t + k, h

    # a first reading counts features in hashed buckets, so that the second keeps no rare one in memory
    seen = np.zeros(1 << 23, np.uint32)
    for k in range(0, len(texts), BLOCK):
        np.add.at(seen, block(k)[1] >> np.uint64(41), 1)
    rows, keys, known = [], [], np.zeros(0, np.uint64)
    for k in range(0, len(texts), BLOCK):
        t, h = block(k)
        often = seen[h >> np.uint64(41)] >= MIN_ROWS
        t, h = t[often], h[often]
        order = np.lexsort((h, t))  # one row per text and feature
        t, h = t[order], h[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
        rows.append(t[new].astype(np.int32))
        keys.append(h[new])
        known = np.union1d(known, keys[-1])
    # places instead of hashes, a block at a time: four bytes for each feature of each text
    places = [np.searchsorted(known, h).astype(np.int32) for h in keys]
    del keys
    index, rows = np.concatenate(places), np.concatenate(rows)
    often = np.bincount(index, minlength=len(known)) >= MIN_ROWS
    use = often[index]
    rows, index, known = rows[use], (np.cumsum(often) - 1).astype(np.int32)[index[use]], known[often]
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))

    z, n = np.zeros(len(known)), np.zeros(len(known))
    zb = nb = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.argsort(mix(np.arange(len(texts), dtype=np.uint64)))
    for _ in range(PASSES):
        for i in order:
            at = index[bounds[i] : bounds[i + 1]]
            w, wb = weight(z[at], n[at]), -zb / ((BETA + nb**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = p - labels[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * wb
            nb += g * g
    w = weight(z, n)
    return known[w != 0], w[w != 0], float(-zb / ((BETA + nb**0.5) / ALPHA))


@dataclass
class ToxicityModel:
    """Sorted feature hashes with their weights (at most MAX_WEIGHTS), and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.keys):
            maybe = np.zeros(1 << 20, bool)
            maybe[self.keys >> np.uint64(44)] = True
            text, h = features(Words(texts, separators=PUNCTUATION))
            some = maybe[h >> np.uint64(44)]
            text, h = text[some], h[some]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            pair = np.unique(text[hit].astype(np.int64) * len(self.keys) + at[hit])
            total += np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, held_out_modulus: int = 3, held_out_remainder: int = 1,
        max_rows: int = MAX_TRAIN_ROWS) -> ToxicityModel:
    """Learns from the labelled rows whose crc32(doc_id) leaves another remainder than the held-out one.

    At most ``max_rows`` of them are used (those whose ids have the least hashes).  Rows without a
    label, id or counterpart are not used; without any labelled row every score is 0.5.
    """
    label = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("double").alias("_y"))
             .where("_y in (0, 1)").where(remainder(F.col("_id"), held_out_modulus) != held_out_remainder)
             .groupBy("_id").agg(F.max("_y").alias("_y")))
    n = label.count()
    if n == 0:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    place = F.xxhash64(F.col("_id").cast("string"), F.lit("toxicity"))
    shards = max(1, round(min(n, max_rows) / SHARD_ROWS))
    sample = label.orderBy(place, "_id").limit(max_rows)  # at most max_rows pairs of numbers: a bounded broadcast
    rows = (docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
            .join(F.broadcast(sample), "_id").select(F.pmod(place, F.lit(shards)).alias("_shard"), "_id", "_text", "_y"))

    def learn(part: pa.Table) -> pa.Table:
        part = part.sort_by([("_id", "ascending")])
        keys, w, bias = fit_shard([x.encode() for x in part["_text"].to_pylist()], part["_y"].to_numpy())
        return pa.table({"key": pa.concat_arrays([signed(keys), pa.nulls(1, pa.int64())]),
                         "w": pa.array(np.append(w, bias))})

    weights = (rows.groupBy("_shard").applyInArrow(learn, "key long, w double")
               .groupBy("key").agg((F.sum("w") / F.lit(shards)).alias("w")))
    top = (weights.where("key is null or abs(w) > 0.01").orderBy(F.col("key").isNotNull(), F.abs("w").desc(), "key")
           .limit(MAX_WEIGHTS + 1).toArrow())
    w, null = top["w"].to_numpy(), np.array(top["key"].is_null())
    keys = top["key"].drop_null().to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return ToxicityModel(keys[order], w[~null][order], float(w[null].sum()))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` (any columns) with ``_tox`` double: the probability of label 1; null text counts as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn("_qualab_tox", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.scores(texts))],
                                             names=[*part.schema.names, "_qualab_tox"])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null id is in training order but never labelled (held_out false); null and empty texts get the
    bias' score; repeated rows are scored alike, one row each; other columns are ignored.
    """
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        F.col("_qualab_tox").alias("score"), F.when(F.col("_qualab_tox") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not predicted toxic; the model learns from ``docs`` itself."""
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).where(F.col("_qualab_tox") < THRESHOLD).drop("_qualab_tox")
