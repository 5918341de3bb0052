"""Brown class-based bigram language model: exchange clustering over the whole training corpus.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)).  Classes come from the exchange algorithm: a word moves
to the class where the likelihood of the class bigrams gains most.  It runs in two tiers, so that no
step holds more than a bounded table:

* the CORE most frequent words: their bigrams are counted over all training text (rows of one word, with
  its right and left neighbours), and several rounds of exchange run as jobs over these rows - each word's
  gain is computed against the class matrix of the round; half of the words may move (the other half in the
  next round), a class takes a bounded share of its size at a time, and what loses likelihood is not taken.
  Words that found no room are tried again, against the classes as they are then, until none is refused;
* the further frequent words (up to HEAD, with a count of 2 or more) are placed by one exchange against
  the core's classes, from their counts of neighbour classes;
* words beyond HEAD belong to classes by shape (has digits, punctuation, letters beyond ASCII).

Word counts are kept for every word.  Emission of frequent words is the count's share of the class; the
shape classes use absolute discounting, and what it takes is the mass of unseen words.  Transitions are
smoothed with the classes' own frequencies (Witten-Bell).

The frequent words (HEAD of them at most: 12 bytes each) are broadcast; a text's other words are joined
with the table of all counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PUNCTUATION, WHITE, Words, chunks, mix, remainder, stored, table

CORE, HEAD, CLASSES, ROUNDS = 4096, 1 << 16, 64, 10
SHAPES = 8
END = CLASSES  #: class of the end token, which is also the context of a text's first word
STATES = CLASSES + 1 + SHAPES
BLOCK = 64  #: core words that are counted together in one dense table
MOST_DISCOUNT = 0.8
LEAST_SHARE = 1 / 1024  #: share of a class below which words move one at a time

_TRAITS = np.zeros(256, np.uint8)
_TRAITS[list(b"0123456789")] = 1
_TRAITS[PUNCTUATION & ~WHITE] = 2
_TRAITS[128:] = 4


def word_keys(words: Words) -> np.ndarray:
    """The words' hashes with their shape (which traits their bytes have, 0 to 7) as the lowest bits."""
    if not len(words):
        return np.zeros(0, np.uint64)
    inside = ~WHITE[words.raw]
    length = words.end - words.start
    shape = np.bitwise_or.reduceat(_TRAITS[words.raw[inside]], np.cumsum(length) - length)
    return words.hash & ~np.uint64(7) | shape


def shape_state(keys: np.ndarray) -> np.ndarray:
    return END + 1 + (keys & np.uint64(7)).astype(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def count_keys(keys_of: Callable[[Words], np.ndarray], limit: int = 2_000_000) -> Callable:
    """A mapInArrow function that yields (key, n) of ``keys_of`` each chunk's words, summed up to ``limit`` keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for _, texts in chunks(batches):
            key, n = np.unique(keys_of(Words(texts)), return_counts=True)
            keys, counts, held = [*keys, key], [*counts, n], held + len(key)
            if held > limit:
                key, n = _summed(keys, counts)
                keys, counts, held = [key], [n], len(key)
                if held > limit / 2:
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])
                    keys, counts, held = [], [], 0
        if keys:
            key, n = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return run


def _sequence(words: Words, label: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours (before, after) of all texts, each with an end on both sides, and the text of each pair."""
    texts = len(words.bounds) - 1
    line = np.full(len(label) + texts + 1, end, np.int64)
    line[np.arange(len(label)) + words.text_of + 1] = label
    return line[:-1], line[1:], np.repeat(np.arange(texts), words.counts + 1)


@dataclass
class BrownModel:
    """Frequent words (sorted by hash) with class and count; states are classes, end, shapes."""

    words: np.ndarray
    word_class: np.ndarray
    word_count: np.ndarray
    transition: np.ndarray  # log10 P(state | state before)
    emission_total: np.ndarray  # tokens of each state
    discount: np.ndarray  # of each shape
    unseen: np.ndarray  # log10 P(any unseen word | shape)
    tokens: int
    vocabulary: int
    ends: int
    counts: DataFrame  # word, n of every training word


def lookup(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index in sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(wanted), -1)
    place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[place] == wanted, place, -1)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _gain(matrix: np.ndarray, right: np.ndarray, left: np.ndarray, self_n: float) -> np.ndarray:
    """Gain in log-likelihood of adding a word to each exchange class of ``matrix`` (which is without it).

    right, left: its counts with the word's class neighbours; self_n: how often it follows itself.
    """
    rows, cols = matrix[:CLASSES], matrix[:, :CLASSES].T
    gain = (_f(rows + right) - _f(rows)).sum(1) + (_f(cols + left) - _f(cols)).sum(1)
    own, k = np.diag(matrix)[:CLASSES], np.arange(CLASSES)
    gain -= (_f(own + right[k]) - _f(own)) + (_f(own + left[k]) - _f(own))
    gain += _f(own + right[k] + left[k] + self_n) - _f(own)
    by_row, by_col = matrix.sum(1)[:CLASSES], matrix.sum(0)[:CLASSES]
    return gain - (_f(by_row + right.sum() + self_n) - _f(by_row)) - (_f(by_col + left.sum() + self_n) - _f(by_col))


def _core_rows(train: DataFrame, core: np.ndarray) -> DataFrame:
    """word (rank; len(core): end, len(core)+1: any other), right, right_n, left, left_n as binary arrays."""
    spark, size = train.sparkSession, len(core) + 2
    held = spark.sparkContext.broadcast((np.sort(core), np.argsort(core)))

    def pairs(words: Words) -> np.ndarray:
        known, rank = held.value
        keys = word_keys(words)
        place = lookup(known, keys)
        a, b, _ = _sequence(words, np.where(place >= 0, rank[place] if len(rank) else 0, size - 1), size - 2)
        return a * size + b

    counter = count_keys(pairs)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in counter(batches):
            key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            a, b = key // size, key % size
            for side, (word, other) in enumerate(((a, b), (b, a))):
                order = np.argsort(word, kind="stable")
                cut = np.searchsorted(word[order], np.arange(0, size + BLOCK, BLOCK))
                out = [(i, word[order[x:y]] % BLOCK * size + other[order[x:y]], n[order[x:y]])
                       for i, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _, _ in out], pa.int32()), pa.array([side] * len(out), pa.int32()),
                     pa.array([k.astype(np.int32).tobytes() for _, k, _ in out], pa.binary()),
                     pa.array([c.tobytes() for _, _, c in out], pa.binary())], names=["block", "side", "keys", "counts"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, side, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "side", "keys", "counts"))):
                held = dense.setdefault(block, np.zeros((2, BLOCK * size), np.int64))
                held[side, np.frombuffer(keys, np.int32)] += np.frombuffer(counts, np.int64)
        for block, held in dense.items():
            by_word = held.reshape(2, BLOCK, size)
            some = [i for i in range(BLOCK) if by_word[:, i].any()]
            cells = [[np.flatnonzero(by_word[side, i]) for side in (0, 1)] for i in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block * BLOCK + i for i in some], pa.int32()), *(
                    pa.array([(c[side].astype(np.int32) if what == 0 else by_word[side, i][c[side]]).tobytes()
                              for i, c in zip(some, cells)], pa.binary()) for side in (0, 1) for what in (0, 1))],
                names=["word", "right", "right_n", "left", "left_n"])

    return stored(train.mapInArrow(blocks, "block int, side int, keys binary, counts binary").repartition("block")
                  .mapInArrow(rows, "word int, right binary, right_n binary, left binary, left_n binary"), "brown-core")


def _by_class(row: dict, word_class: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    right, rn = np.frombuffer(row["right"], np.int32), np.frombuffer(row["right_n"], np.int64)
    left, ln = np.frombuffer(row["left"], np.int32), np.frombuffer(row["left_n"], np.int64)
    width = CLASSES + 2
    return np.bincount(word_class[right], rn, width), np.bincount(word_class[left], ln, width), right, rn


def exchange(rows: DataFrame, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each core word (then of end and of all others), and the matrix of class bigrams."""
    spark, width = rows.sparkSession, CLASSES + 2
    word_class = np.concatenate([np.arange(size - 2) % CLASSES, [CLASSES, CLASSES + 1]])

    def class_matrix(word_class: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(word_class)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width))
            for batch in batches:
                for row in batch.to_pylist():
                    total[held.value[row["word"]]] += _by_class(row, held.value)[0]
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "n"])

        out = np.zeros(width * width)
        sums = rows.mapInArrow(part, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
        return out.reshape(width, width)

    def likelihood(matrix: np.ndarray) -> float:
        return float(_f(matrix).sum() - _f(matrix.sum(0)).sum() - _f(matrix.sum(1)).sum())

    def wanted(word_class: np.ndarray, matrix: np.ndarray, use: np.ndarray) -> list[tuple[float, int, int]]:
        """(gain, word, class) of the words of ``use`` that gain most elsewhere, each moved alone; greatest gains first."""
        held = spark.sparkContext.broadcast((word_class, matrix, use))

        def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            word_class, matrix, use = held.value
            words, best, gains = [], [], []
            for batch in batches:
                for row in batch.filter(pa.array(use[batch.column("word").to_numpy()])).to_pylist():
                    w = row["word"]
                    right, left, neighbour, n = _by_class(row, word_class)
                    a, twice = word_class[w], float(n[neighbour == w].sum())
                    right[a] -= twice
                    left[a] -= twice
                    rest = matrix.copy()
                    rest[a] -= right
                    rest[:, a] -= left
                    rest[a, a] -= twice
                    gain = _gain(np.maximum(rest, 0), right, left, twice)
                    if gain.max() > gain[a] + 1e-6:
                        words.append(w)
                        best.append(int(gain.argmax()))
                        gains.append(float(gain.max() - gain[a]))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(best, pa.int32()), pa.array(gains, pa.float64())],
                                             names=["word", "to", "gain"])

        moved = rows.mapInArrow(moves, "word int, to int, gain double").toArrow()  # at most CORE rows
        return sorted(zip(*(moved[c].to_pylist() for c in ("gain", "word", "to"))), key=lambda m: (-m[0], m[1]))

    matrix, idle = class_matrix(word_class), 0
    for turn in range(rounds):
        # two rounds that follow each other try one half of the words each, and so every word
        half = (mix(np.arange(size, dtype=np.uint64) + np.uint64(1000003 * (turn // 2))) & np.uint64(1)) == turn % 2
        use, share, idle = half & (np.arange(size) < size - 2), 0.5, idle + 1
        while use.any():
            found = wanted(word_class, matrix, use)
            if not found:
                break
            # gains are of single moves: a class takes only so many words at a time, those that gain most
            room = np.maximum(1, share * np.bincount(word_class[:-2], minlength=CLASSES)[:CLASSES]).astype(int)
            changed, refused, alone = word_class.copy(), np.zeros(size, bool), share < LEAST_SHARE
            for k, (_, w, to) in enumerate(found):
                if room[to] and not (alone and k):
                    room[to] -= 1
                    changed[w] = to
                else:
                    refused[w] = True
            after = class_matrix(changed)
            if likelihood(after) > likelihood(matrix):
                # who was refused is tried again against the new classes, until none is refused
                word_class, matrix, use, share, idle = changed, after, refused, min(0.5, 4 * share), 0
            elif alone:
                break  # one move gains nothing but rounding
            else:
                share /= 4
        if idle == 3:
            break  # two of these rounds tried every word, and none gains by moving
    return word_class, matrix


def _place_rest(train: DataFrame, head: np.ndarray, core_class: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Class of each head word beyond the core by one exchange against the core's classes."""
    core, width = len(core_class) - 2, CLASSES + 2
    if len(head) <= core:
        return np.zeros(0, np.int64)
    held = train.sparkSession.sparkContext.broadcast((np.sort(head), np.argsort(head), core_class, matrix))

    def contexts(words: Words) -> np.ndarray:
        known, rank, core_class, _ = held.value
        keys = word_keys(words)
        place = lookup(known, keys)
        rank = np.where(place >= 0, rank[place], len(known))
        a, b, _ = _sequence(words, rank, -1)
        kind = lambda r: np.where(r < 0, CLASSES, np.where(r < core, core_class[np.minimum(r, core - 1)], CLASSES + 1))
        right, left = (a >= core) & (a < len(known)), (b >= core) & (b < len(known))
        return np.concatenate([(a[right] - core) * 2 * width + kind(b[right]), ((b[left] - core) * 2 + 1) * width + kind(a[left])])

    def choose(part: pa.Table) -> pa.Table:
        matrix = held.value[3]
        key, n = part["key"].to_numpy(), part["n"].to_numpy()
        word = key // (2 * width)
        words, at = np.unique(word, return_inverse=True)
        both = np.bincount(at * 2 * width + key % (2 * width), n, len(words) * 2 * width).reshape(-1, 2, width)
        return pa.table({"word": pa.array(words), "to": pa.array([int(_gain(matrix, r, x, 0.0).argmax()) for r, x in both], pa.int64())})

    found = (train.mapInArrow(count_keys(contexts), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
             .groupBy(F.expr(f"key div {2 * width * 512}").alias("block")).applyInArrow(choose, "word long, to long").toArrow())
    out = np.zeros(len(head) - core, np.int64)
    out[found["word"].to_numpy()] = found["to"].to_numpy()
    return out


def fit(train: DataFrame) -> BrownModel:
    """Learns from column ``text`` of all rows of ``train``; null texts are empty.  No row at all is allowed."""
    spark = train.sparkSession
    train = train.select("text")

    counts = stored(train.mapInArrow(count_keys(word_keys, 1_000_000), "key long, n long")
                    .groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n")), "brown-counts")
    ends = train.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, vocabulary = total[0] + ends, total[1] + (1 if ends else 0)
    # the least count that HEAD words at most reach, from the number of words of each count
    sizes = counts.where("n >= 2").groupBy("n").agg(F.count("*").alias("k"))
    above = sizes.select("n", F.sum("k").over(Window.orderBy(F.desc("n"))).alias("k")).where(F.col("k") <= HEAD).agg(F.min("n")).first()[0]
    top = counts.where(F.col("n") >= (above or 1 << 62)).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    head, head_n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()

    core = head[:CORE]
    core_class, matrix = exchange(_core_rows(train, core), len(core) + 2)
    head_class = np.concatenate([core_class[:-2], _place_rest(train, head, core_class, matrix)]).astype(np.int64)
    order = np.argsort(head)
    model = BrownModel(head[order], head_class[order], head_n[order], None, None, None, None, tokens, vocabulary, ends, counts)

    # transitions between the states of all training words
    light = spark.sparkContext.broadcast((model.words, model.word_class))

    def transitions(words: Words) -> np.ndarray:
        known, word_class = light.value
        keys = word_keys(words)
        place = lookup(known, keys)
        a, b, _ = _sequence(words, np.where(place >= 0, word_class[place] if len(known) else 0, shape_state(keys)), END)
        return a * STATES + b

    sums = train.mapInArrow(count_keys(transitions), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    pair = np.zeros(STATES * STATES)
    pair[sums["key"].to_numpy()] = sums["n"].to_numpy()
    pair = pair.reshape(STATES, STATES)
    own = (pair.sum(0) + 1) / (pair.sum() + STATES)
    kinds = np.maximum((pair > 0).sum(1, keepdims=True), 1)
    model.transition = np.log10((pair + kinds * own) / (pair.sum(1, keepdims=True) + kinds))
    model.emission_total = np.maximum(pair.sum(0), 1)

    rare = counts.join(F.broadcast(spark.createDataFrame(pa.table({"word": pa.array(head.view(np.int64))}))), "word", "left_anti")
    by_shape = {r["shape"]: r for r in rare.groupBy(F.expr("int(word & 7)").alias("shape")).agg(
        F.count("*").alias("v"), F.sum("n").alias("n"), F.sum(F.expr("int(n = 1)")).alias("n1"), F.sum(F.expr("int(n = 2)")).alias("n2")).collect()}
    model.discount, model.unseen = np.full(SHAPES, MOST_DISCOUNT), np.zeros(SHAPES)
    for s, r in by_shape.items():
        model.discount[s] = min(MOST_DISCOUNT, r["n1"] / (r["n1"] + 2 * r["n2"] + 1)) or 0.1
        model.unseen[s] = np.log10(model.discount[s] * r["v"] / r["n"])
    return model


def score(docs: DataFrame, model: BrownModel, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``docs`` with n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    counts = model.counts
    model.counts = None
    held = spark.sparkContext.broadcast(model)
    norm = float(np.log10(model.tokens + model.vocabulary + 1))
    source = docs.select(F.monotonically_increasing_id().alias("_row"), "text", *(F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)))
    kept = [f"_c{i}" for i in range(len(columns))]
    names = ["_row", *kept, "_word", "_shape", "_n", "n_tokens", "n_known", "base_score", "score"]
    schema = source.select("_row", *kept, *(F.lit(0).cast(t).alias(n) for n, t in zip(names[-7:], ("long", "int", "long", "long", "long", "double", "double")))).schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])  # word rows leave the columns null

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        emission = np.log10(m.word_count / m.emission_total[m.word_class]) if len(m.words) else np.zeros(0)
        base = np.log10(m.word_count + 1.0)
        for part, texts in chunks(batches):
            words, size = Words(texts), len(texts)
            keys = word_keys(words)
            place = lookup(m.words, keys)
            state = np.where(place >= 0, m.word_class[place] if len(m.words) else 0, shape_state(keys))
            a, b, of = _sequence(words, state, END)
            text, known = words.text_of, place >= 0
            total = np.bincount(of, m.transition[a, b], size) + np.bincount(text[known], emission[place[known]], size)
            flat = np.bincount(text[known], base[place[known]], size) + np.log10(m.ends + 1.0)
            # a row of each text, under a key of its own, and one for each of its other words
            rest = np.flatnonzero(~known)
            order = rest[np.lexsort((keys[rest], text[rest]))]
            t, h = text[order], keys[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(t)))
            row = part.column("_row").to_numpy()
            nil, many = np.zeros(len(first)), len(first)
            own = mix(row.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([row, row[t[first]]])),
                *(pa.concat_arrays([part.column(c), pa.nulls(many, part.column(c).type)]) for c in kept),
                pa.array(np.concatenate([own, h[first]]).view(np.int64)),
                pa.array(np.concatenate([np.full(size, -1), (state[order] - END - 1)[first]]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(size, np.int64), n])),
                pa.array(np.concatenate([words.counts + 1, np.zeros(many, np.int64)])),
                pa.array(np.concatenate([np.bincount(text[known], minlength=size) + int(m.ends > 0), np.zeros(many, np.int64)]).astype(np.int64)),
                pa.array(np.concatenate([flat - (words.counts + 1) * norm, nil])), pa.array(np.concatenate([total, nil]))], names=names)

    rows = source.mapInArrow(run, schema)
    seen = counts.select(F.col("word").alias("_word"), F.col("n").alias("_seen"))
    is_word, c = F.col("_shape") >= 0, F.coalesce("_seen", F.lit(0))
    shape = F.col("_shape") + 1
    at = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.when(is_word, shape))
    emission = F.when(F.col("_seen").isNull(), at(model.unseen)).otherwise(
        F.log10((F.col("_seen") - at(model.discount)) / at(model.emission_total[END + 1 :])))
    held_rows = rows.join(seen, "_word", "left").select(
        "_row", *kept, "_shape", "n_tokens", (F.col("n_known") + F.when(is_word & F.col("_seen").isNotNull(), F.col("_n")).otherwise(0)).alias("n_known"),
        (F.col("base_score") + F.when(is_word, F.col("_n") * F.log10(c + 1.0)).otherwise(0.0)).alias("base_score"),
        (F.col("score") + F.when(is_word, F.col("_n") * emission).otherwise(0.0)).alias("score"))
    done = held_rows.groupBy("_row").agg(*(F.max(c).alias(c) for c in kept), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    model.counts = counts
    return done.select(*(F.col(k).alias(c) for k, c in zip(kept, columns)), "n_tokens", "n_known",
                       F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def brown_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Rows whose crc32(doc_id) leaves 2 modulo 7 are held out; a null id is not.  Null and empty texts have
    the end token only.  Repeated rows count and are scored as often as they occur.
    """
    flag = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    model = fit(docs.where(~flag))
    return score(docs.select("doc_id", "text", flag.alias("held_out")), model, ["doc_id", "held_out"])


def op1_brown_lm(spark, sf_dir: str) -> DataFrame:
    return brown_scores(table(spark, sf_dir, "documents"))
