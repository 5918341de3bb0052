"""Substring dedup: near-duplicate passages from compact windows.

The tokens of a text are its 5-word shingles.  Under one hash function, the token of least hash c of any
passage is the root of a Cartesian tree over the hashes; the *compact window* (l, c, r) stands for all
passages from l..c to c..r, which share c as min-hash.  Only windows at least as wide as the least passage
count, and there are about 2n / width of them.  Two near-duplicate passages share a min-hash under most hash
functions, so windows meet by (function, min-hash, least hash of a side of c) as the key.

All windows of a key are compared with the first of them, in the chunk that makes them and then over the
corpus: a hot passage sends the rows of one document per chunk, and as many pairs as it has copies.  The windows' intervals,
aligned at c, are intersected; what is too short goes, what lies on one alignment or on near ones of two texts
is one candidate.  A candidate is verified by the longest chain of equal shingles in the order of both texts,
so words may be changed, put in or left out: spans of at least ``min_words`` words, begun and ended by equal
shingles, whose Jaccard similarity (chain against both spans) is ``SIMILARITY`` or more.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, mix, shingle_hashes, split, stored, table
from .common import chunks as any_chunks

chunks = partial(any_chunks, limit=CHUNK_BYTES // 2)  # a text's windows take several times its size
SIZE = 5
MIN_WORDS = 50
FUNCTIONS = 8
SIMILARITY = 0.75
_PLACE = np.uint64((1 << 24) - 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_FOUND = 1 << 40  #: more than any shift
_BLOCK = 1 << 14  #: candidates of a block


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values (blocks of that width: suffix minimum of one, prefix of the next)."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, _NONE)]).reshape(-1, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def compact_windows(values: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of ``width`` or more; ``text`` tells the text of each value.

    Ties go to the left.  The nearest smaller value of a wide window's center is itself a center of one,
    so the Cartesian tree is built over the centers alone.
    """
    if len(values) < width:
        return (np.zeros(0, np.int64),) * 3
    keyed = values & ~_PLACE | np.arange(len(values), dtype=np.uint64)
    inside = text[width - 1 :] == text[: len(text) - width + 1]
    center = np.unique((_sliding_min(keyed, width)[inside] & _PLACE).astype(np.int64))
    first = np.searchsorted(text, text[center])
    last = np.searchsorted(text, text[center], side="right") - 1
    left, right = first.copy(), last.copy()
    stack: list[int] = []
    value, own, place = keyed[center].tolist(), text[center].tolist(), center.tolist()
    for i in range(len(place)):
        while stack and (own[stack[-1]] != own[i] or value[stack[-1]] > value[i]):
            k = stack.pop()
            if own[k] == own[i]:
                right[k] = place[i] - 1
        if stack:
            left[i] = place[stack[-1]] + 1
        stack.append(i)
    return left, center, right


def _window_rows(texts: list[bytes], ids: np.ndarray, min_words: int, functions: int):
    """key, doc, c, l, r of all windows (shingle positions within the text), sorted by key, doc, c."""
    width, side = min_words - SIZE + 1, (min_words - SIZE) // 2
    words = Words(texts)
    h, text = shingle_hashes(words.hash, SIZE), words.text_of
    own = np.flatnonzero(text[SIZE - 1 :] == text[: len(text) - SIZE + 1]) if len(text) >= SIZE else np.zeros(0, np.int64)
    h, text = h[own], text[own]
    start = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    if len(h) >= width:
        for j in range(functions):
            context = _sliding_min(mix(h + mix(np.array([j + 977], np.uint64))), side)
            left, c, right = compact_windows(mix(h ^ mix(np.array([j + 1], np.uint64))), text, width)
            base = mix(h[c] + np.uint64(j))
            for which, use, at in ((1, c - left >= side, c - side), (2, right - c >= side, c + 1)):
                x = np.flatnonzero(use)
                first = start[text[c[x]]]
                out.append((mix(base[x] * np.uint64(3) + np.uint64(which) + mix(context[at[x]])), ids[text[c[x]]],
                            c[x] - first, left[x] - first, right[x] - first))
    if not out:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)
    key, doc, c, left, right = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((c, doc, key))
    return key[order], doc[order], c[order], left[order], right[order]


def _meet(head, rows):
    """Candidate of a window with the first of its key: (a, b, shift, from, to) where the intersection is wide enough."""
    (a, ca, la, ra), (b, cb, lb, rb) = head, rows
    before, after = np.minimum(ca - la, cb - lb), np.minimum(ra - ca, rb - cb)
    return a, b, cb - ca, cb - before, cb + after, before + after + 1


def packed(columns: list[np.ndarray]) -> bytes:
    """Whole numbers of columns of one length, each as its least and the bytes that the rest takes."""
    out = [struct.pack("<q", len(columns[0]))]
    for x in columns:
        base = int(x.min())
        value = (x - base).astype("<u8")
        width = (int(value.max()).bit_length() + 7) // 8
        out += [struct.pack("<qB", base, width), value.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    """The columns that ``packed`` was given."""
    (n,), at, out = struct.unpack_from("<q", data), 8, []
    for _ in range(columns):
        base, width = struct.unpack_from("<qB", data, at)
        value = np.zeros((n, 8), np.uint8)
        value[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(value.view("<i8").ravel() + base)
        at += 9 + n * width
    return out


def candidates(docs: DataFrame, min_words: int = MIN_WORDS, functions: int = FUNCTIONS) -> DataFrame:
    """a, b, shift, from, to: shingles from..to of text b may repeat those of text a < b at ``shift`` less.

    A chunk's windows are shuffled in blocks, one for each range of keys, as packed columns.  A candidate that
    the chunk has found goes the same way: its key is document a, its c the shift less ``_FOUND``.
    """
    width = min_words - SIZE + 1
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = ["key", "doc", "c", "l", "r"]

    def block(part: int, key, doc, c, left, right) -> tuple[int, bytes]:
        gaps = np.diff(key, prepend=key[:1])  # keys ascend, so these are small; not so in a block of candidates
        return part, struct.pack("<q", key[0]) + packed([gaps, doc, c, c - left, right - c])

    def pairs(key, doc, c, left, right, first):
        """Rows that are not the first of their key, as candidates."""
        rest = np.flatnonzero((np.arange(len(key)) != first) & (doc != doc[first]))
        f = first[rest]
        a, b, shift, x, y, wide = _meet((doc[f], c[f], left[f], right[f]), (doc[rest], c[rest], left[rest], right[rest]))
        use = wide >= width
        return a[use], b[use], shift[use], x[use], y[use]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            key, doc, c, left, right = _window_rows(texts, part.column("doc_id").to_numpy(), min_words, functions)
            if not len(key):
                continue
            key = (key >> np.uint64(8)).astype(np.int64)  # 56 bits
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            one = np.flatnonzero(doc == doc[first])  # further windows of the first's document have met nothing here
            rows = [x[one] for x in (key, doc, c, left, right)]
            cut = np.searchsorted(rows[0], [(k << 56) // ranges for k in range(ranges)] + [1 << 56])
            out = [block(k, *(x[i:j] for x in rows)) for k, (i, j) in enumerate(zip(cut, cut[1:])) if i < j]
            a, b, shift, x, y = pairs(key, doc, c, left, right, first)
            for i in range(0, len(b), _BLOCK):
                near = slice(i, i + _BLOCK)
                out.append(block(int((b[i] + i // _BLOCK) % ranges), a[near], b[near], shift[near] - _FOUND, x[near], y[near]))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())],
                                             names=["part", "block"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("block").to_pylist():
                gaps, doc, c, before, after = unpacked(data[8:], 5)
                key = np.cumsum(gaps) + struct.unpack_from("<q", data)[0]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, doc, c, c - before, c + after)], names=numbers)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["a", "b", "shift", "from", "to"], None
        for batch in batches:
            rows = [batch.column(n).to_numpy() for n in numbers]
            done = rows[2] < 0
            if done.any():
                a, b, shift, x, y = (v[done] for v in rows)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a, b, shift + _FOUND, x, y)], names=names)
                rows = [x[~done] for x in rows]
            if held is not None:  # the first row of the list that the batch before ended in
                rows = [np.concatenate([h, x]) for h, x in zip(held, rows)]
            key = rows[0]
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            held = [x[[first[-1]]] for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in pairs(*rows, first)], names=names)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    found = (named.mapInArrow(windows, "part int, block binary").repartitionById(ranges, "part")
             .mapInArrow(rows, ", ".join(f"{n} long" for n in numbers)).sortWithinPartitions("key", "doc", "c")
             .mapInArrow(meet, "a long, b long, shift long, `from` long, `to` long"))
    return found.groupBy("a", "b", "shift").agg(F.min("from").alias("from"), F.max("to").alias("to"))


def _clusters(rows: list[tuple[int, int, int]], slack: int) -> list[list[int]]:
    """[lo, hi, from, to] (least and greatest shift, interval of b) of candidates (shift, from, to) of two texts.

    Candidates are joined where their intervals overlap or nearly so and their shifts differ by no more than
    words put in or left out could make at that length.
    """
    out: list[list[int]] = []
    for shift, x, y in sorted(rows):
        for own in reversed(out):
            gap = shift - own[1]
            if gap <= max(slack, (max(y, own[3]) - min(x, own[2]) + 1) // 4) and x <= own[3] + slack + gap and y >= own[2] - slack - gap:
                own[1], own[2], own[3] = shift, min(x, own[2]), max(y, own[3])
                break
        else:
            out.append([shift, shift, x, y])
    return out


def _chain(sa: np.ndarray, sb: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in b, in a) of the longest run of equal shingles in the order of both texts, whose shifts are lo..hi."""
    at_b, at_a = [], []
    for d in range(max(lo, 1 - len(sa)), min(hi, len(sb) - 1) + 1):  # b = a + d
        x, y = max(0, d), min(len(sb), len(sa) + d)
        hit = np.flatnonzero(sb[x:y] == sa[x - d : y - d]) + x
        if len(hit):
            at_b.append(hit)
            at_a.append(hit - d)
    if not at_b:
        return (np.zeros(0, np.int64),) * 2
    b, a = np.concatenate(at_b), np.concatenate(at_a)
    order = np.lexsort((-a, b))
    b, a = b[order], a[order]
    if (np.diff(b) > 0).all() and (np.diff(a) > 0).all():
        return b, a
    ends: list[int] = []  # least last place of a chain of each length, the match that has it, and the one before each
    match, before = [], []
    for i, place in enumerate(a.tolist()):
        k = bisect_left(ends, place)
        before.append(match[k - 1] if k else -1)
        if k == len(ends):
            ends.append(place)
            match.append(i)
        else:
            ends[k], match[k] = place, i
    i, use = match[-1], []
    while i >= 0:
        use.append(i)
        i = before[i]
    return b[use[::-1]], a[use[::-1]]


def _spans(b: np.ndarray, a: np.ndarray, least: int) -> list[tuple[int, int, int, float]]:
    """Spans (from, to, from in a, Jaccard) of ``least`` shingles or more in both texts; as long as they may be.

    b and a are the places of a chain of equal shingles; m of them in spans of x and y shingles make a Jaccard
    similarity of m / (x + y - m).
    """
    if not len(b):
        return []
    cut = np.flatnonzero((np.diff(b) != 1) | (np.diff(a) != 1)) + 1
    runs, out = list(zip([0, *cut.tolist()], [*cut.tolist(), len(b)])), []
    i = 0
    while i < len(runs):
        first, best, k = runs[i][0], None, i
        while k < len(runs):
            last = runs[k][1] - 1
            same, x, y = last - first + 1, int(b[last] - b[first]) + 1, int(a[last] - a[first]) + 1
            score = same / (x + y - same)
            if score >= SIMILARITY and min(x, y) >= least:
                best = (k, int(b[last]) + 1, score)
            elif score < SIMILARITY / 3:
                break
            k += 1
        if best:
            out.append((int(b[first]), best[1], int(a[first]), best[2]))
            i = best[0] + 1
        else:
            i += 1
    return out


def _cover(spans: list[tuple]) -> list[tuple]:
    """The fewest of one document's spans (doc, start, end, source, ...) that cover what all of them cover."""
    out, end, best = [], -1, None
    for span in sorted(spans, key=lambda s: (s[1], -s[2], s[3])):
        if best and span[1] > end:  # what was taken ends before this one begins
            out.append(best)
            end, best = best[2], None
        if span[2] > end and (best is None or span[2] > best[2]):
            if best is None and span[1] > end:
                out.append(span)
                end = span[2]
            else:
                best = span
    return [*out, best] if best else out


def _shingle_arrays(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc, shingles of the documents ``ids`` (a column named doc)."""
    near, _ = split(docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null"), "doc", ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = Words(texts)
            rows = [shingle_hashes(words.hash[a:b], SIZE).view(np.int64) for a, b in zip(words.bounds, words.bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(rows, pa.list_(pa.int64()))], names=["doc", "shingles"])

    return near.join(ids, "doc", "left_semi").mapInArrow(run, "doc long, shingles array<long>").dropDuplicates(["doc"])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end (words, end exclusive), source_doc_id, source_start, jaccard of passages that repeat.

    The passage was found in ``source_doc_id`` < ``doc_id`` before.  Words are lower-cased (A-Z).  A span
    that other spans of its document cover is not listed again.  Rows without an id take no part; rows that
    share an id count as one document (the first such text).  Passages that repeat only within one document
    are not reported.
    """
    least = min_words - SIZE + 1
    slack = least // 3  # words put in or left out so near to a window's center that no other window shows it
    cut_names = ["a", "b", "lo", "hi", "at_a", "at_b", "len_a", "len_b"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, rows in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "rows"))):
                for lo, hi, x, y in _clusters([(r["shift"], r["from"], r["to"]) for r in rows], slack):
                    at_a, at_b = max(0, x - hi - slack), max(0, x - slack)
                    out.append((a, b, lo - slack - at_b + at_a, hi + slack - at_b + at_a, at_a, at_b, y - lo + slack + 1 - at_a, y + slack + 1 - at_b))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(cut_names))], names=cut_names)

    pairs = candidates(docs, min_words).groupBy("a", "b").agg(F.collect_list(F.struct("shift", "from", "to")).alias("rows"))
    found = stored(pairs.mapInArrow(joined, ", ".join(f"{n} long" for n in cut_names)), "passage-candidates")
    ids = found.select(F.col("a").alias("doc")).union(found.select("b")).distinct()
    arrays = stored(_shingle_arrays(docs, ids), "passage-shingles")
    cut = lambda at, length: F.slice("shingles", (F.col(at) + 1).cast("int"), F.col(length).cast("int"))
    one = found.join(arrays, found["b"] == arrays["doc"]).withColumn("sb", cut("at_b", "len_b")).drop("shingles", "doc")
    two = one.join(arrays, one["a"] == arrays["doc"]).withColumn("sa", cut("at_a", "len_a")).drop("shingles", "doc")

    names = ["doc_id", "start", "end", "source_doc_id", "source_start", "jaccard"]
    schema = "doc_id long, start long, end long, source_doc_id long, source_start long, jaccard double"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 5 else pa.float64()) for k in range(6)], names=names)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, lo, hi, at_a, at_b = (batch.column(n).to_pylist() for n in cut_names[:6])
            out: list[tuple] = []
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                chain = _chain(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False), lo[i], hi[i])
                for begin, end, source, score in _spans(*chain, least):
                    out.append((b[i], at_b[i] + begin, at_b[i] + end + SIZE - 1, a[i], at_a[i] + source, score))
            yield batch_of(out)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, own = None, []  # the document that is being read and its spans
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                if doc != row[0]:
                    out += _cover(own)
                    doc, own = row[0], []
                own.append(row)
            yield batch_of(out)
        yield batch_of(_cover(own))

    return two.mapInArrow(verify, schema).repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(cover, schema)


def op7_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and the white space before them."""
    words = Words([text], lower=False)
    keep, at = [], 0
    for x, y in sorted(spans):
        begin = int(words.end[x - 1]) if x else 0
        stop = int(words.end[min(y, len(words)) - 1])
        if stop > at:
            keep.append(text[at : max(begin, at)])
            at = stop
    return b"".join([*keep, text[at:]])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; passages that an earlier one has go from its text, n_chars follows."""
    spans = stored(repeated_passages(docs).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "end")).alias("_qualab_spans")), "passage-spans")
    some, rest = split(docs, "doc_id", spans.select("doc_id"))
    joined = some.join(spans.withColumnRenamed("doc_id", "_qualab_id"), F.col("doc_id") == F.col("_qualab_id"), "left").drop("_qualab_id")
    names, has_size = docs.columns, "n_chars" in docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            columns = {n: part.column(n) for n in names}
            new, size = [], columns["n_chars"].to_pylist() if has_size else []
            for i, (text, own) in enumerate(zip(texts, part.column("_qualab_spans").to_pylist())):
                if own:
                    text = without_spans(text, [(s["start"], s["end"]) for s in own])
                    if has_size:
                        size[i] = len(text.decode())
                new.append(text.decode() if columns["text"][i].is_valid else None)
            columns["text"] = pa.array(new, columns["text"].type)
            if has_size:
                columns["n_chars"] = pa.array(size, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(cut, docs.schema).union(rest)
