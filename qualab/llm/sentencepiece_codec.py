"""SentencePiece encoding and decoding with shared prefixes.

A text is marked (space becomes U+2581, one is put in front) and cut into marked words: a run of marks with
what follows it.  No piece reaches across such a cut, so words are encoded on their own.  The distinct words
of a chunk are sorted - a trie in preorder - and walked depth-first: the forward table of a word's prefix
(one entry per character) is kept on a stack and reused by every word that shares the prefix.  The pieces that
end a prefix come from an automaton over the pieces, one step per character.

The forward entry depends on the model.  *unigram*: the best score of the prefix and its last piece
(Viterbi).  *bpe*: the one last piece that byte-pair merging leaves at the end of the prefix; a
segmentation is the one that merging gives exactly if every two neighbours stay apart when merged on their
own, so an entry needs only the entry before its last piece.  Viterbi over the scores of a BPE file would
give other pieces than SentencePiece itself.  Texts never leave their partition: nothing is shuffled.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of SentencePiece: an unknown character scores the least piece's less this
CACHED_WORDS = 400_000  #: words of a generation; two are held
LONGEST_CACHED = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Pieces, scores and kinds of a model file; kind is 'bpe' or 'unigram'."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], unknown: int, kind: str = "bpe"):
        self.pieces, self.byte_ids, self.unknown, self.kind = pieces, byte_ids, unknown, kind
        self.text = {i: p for p, (i, _) in pieces.items()}
        self.least = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {i: p.replace(MARK, " ").encode() for i, p in self.text.items()} | {
            i: bytes([b]) for b, i in enumerate(byte_ids)}
        split_lines = not any("\n" in p for p in pieces)
        assert not any(MARK in p.lstrip(MARK) for p in pieces), "a piece has a mark inside"
        self.word = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if split_lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known_pairs = 0
        self.encoded = {p: array("i", [i]).tobytes() for p, (i, _) in pieces.items()}
        # pieces of two or more characters as an automaton: the state after a prefix is the longest of its
        # endings with which a piece begins, and lists the pieces that end there, longest first, each with its
        # length and the pieces known to stay apart from it or not; pieces that merging never makes are left out
        self.step: list[dict[str, int]] = [{}]
        self.shorter, self.ends = [0], [()]
        for p in pieces:
            if len(p) > 1 and (kind != "bpe" or self.merged(p) == [p]):
                state = 0
                for c in p:
                    if c not in self.step[state]:
                        self.step[state][c] = len(self.step)
                        self.step.append({})
                        self.shorter.append(0)
                        self.ends.append(())
                    state = self.step[state][c]
                self.ends[state] = ((p, len(p), {}),)
        level = list(self.step[0].values())
        while level:
            for state in level:
                self.ends[state] += self.ends[self.shorter[state]]
                for c, longer in self.step[state].items():
                    self.shorter[longer] = self._after(self.shorter[state], c)
            level = [longer for state in level for longer in self.step[state].values()]

    def _after(self, state: int, c: str) -> int:
        """The state after one more character."""
        while (longer := self.step[state].get(c)) is None and state:
            state = self.shorter[state]
        return longer or 0

    @classmethod
    def load(cls, model_file: str, kind: str = "bpe") -> Codec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        named = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        return cls({sp.id_to_piece(i): (i, sp.get_score(i)) for i in named}, [i for i in ids if sp.is_byte(i)],
                   sp.unk_id(), kind)

    def merged(self, text: str, cut: int = 0) -> list[str] | None:
        """Byte-pair merging as it is defined: the best pair first, the leftmost of equal ones.

        None as soon as a merge reaches across the character place ``cut``.
        """
        pieces = self.pieces
        parts = list(text)
        scores = [pieces[x][1] if (x := a + b) in pieces else None for a, b in zip(parts, parts[1:])]
        left = cut - 1  # the part before the cut: its right neighbour lies behind it
        while (best := max((x for x in scores if x is not None), default=None)) is not None:
            k = scores.index(best)
            if k == left:
                return None
            left -= k < left
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            for i in (k - 1, k):
                if 0 <= i < len(scores):
                    x = parts[i] + parts[i + 1]
                    scores[i] = pieces[x][1] if x in pieces else None
        return parts

    def _stay_apart(self, a: str, b: str, known: dict[str, bool]) -> bool:
        """Whether merging ``a`` and ``b`` side by side leaves just these two; noted in ``known`` of b."""
        self.known_pairs += 1
        if self.known_pairs > 2_000_000:
            self.known_pairs = 1
            for ends in self.ends:
                for end in ends:
                    end[2].clear()
        out = known[a] = self.merged(a + b, len(a)) == [a, b]
        return out

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) of distinct words in sorted order, with one depth-first walk over their trie.

        The stacks hold for each prefix of the word its state, last piece and (unigram) best score.
        """
        step, shorter, ends, pieces, bpe = self.step, self.shorter, self.ends, self.pieces, self.kind == "bpe"
        states, last, score = [0], [""], [0.0]
        before = ""
        for word in sorted(words):
            common = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                common += 1
            del states[common + 1 :], last[common + 1 :], score[common + 1 :]
            state = states[common]
            for i in range(common, len(word)):
                c = word[i]
                while (longer := step[state].get(c)) is None and state:
                    state = shorter[state]
                state = longer or 0
                states.append(state)
                if bpe:
                    for piece, n, known in ends[state]:
                        if n > i:  # the whole prefix
                            break
                        apart = known.get(neighbour := last[i + 1 - n])
                        if self._stay_apart(neighbour, piece, known) if apart is None else apart:
                            break
                    else:
                        piece = c
                else:
                    piece, best = c, score[i] + pieces.get(c, (0, self.least))[1]
                    for longest, n, _ in reversed(ends[state]):
                        if (x := score[i + 1 - n] + pieces[longest][1]) > best:
                            piece, best = longest, x
                    score.append(best)
                last.append(piece)
            out, i = [], len(word)
            while i:
                out.append(piece := last[i])
                i -= len(piece)
            out.reverse()
            yield word, out
            before = word

    def _ids(self, pieces: list[str]) -> bytes:
        encoded = self.encoded
        return b"".join([encoded.get(p) or self._unknown_ids(p) for p in pieces])

    def _unknown_ids(self, piece: str) -> bytes:
        return array("i", [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.word.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > CACHED_WORDS:
            self.cache, self.older = {}, self.cache
        ids, older = self.cache, self.older
        new = set().union(*split) - ids.keys()
        known = new & older.keys()
        ids.update((w, older[w]) for w in known)
        for word, pieces in self.segment(new - known):
            ids[word] = self._ids(pieces)
        out = [np.frombuffer(b"".join([ids[w] for w in words]), np.int32) for words in split]
        for word in new:
            if len(word) > LONGEST_CACHED:
                del ids[word]
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(self.bytes.get(i, b"") for i in ids)
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


@lru_cache(2)
def _codec(model_file: str, kind: str) -> Codec:
    return Codec.load(model_file, kind)


def encode(docs: DataFrame, model_file: str, column: str = "text", output: str = "ids", kind: str = "bpe") -> DataFrame:
    """``docs`` with ``output``: piece ids of ``column`` (null as empty: no ids); any other columns stay.

    An existing column called ``output`` is replaced.
    """
    docs = docs.drop(output)
    schema = docs.withColumn(output, F.expr("cast(null as array<int>)")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_file, kind)
        for part, texts in chunks(batches, column):
            ids = codec.encode([t.decode() for t in texts])
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))],
                                             names=[*part.schema.names, output])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model_file: str, column: str = "ids", output: str = "decoded") -> DataFrame:
    """``rows`` with ``output``: the text of the piece ids in ``column`` (null as no ids: '')."""
    rows = rows.drop(output)
    schema = rows.withColumn(output, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_file, "bpe")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                text = [codec.decode(x or []) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=[*part.schema.names, output])

    return rows.mapInArrow(run, schema)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: number and hash of its ids, and whether the text came back."""
    model = default_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return decode(encode(docs, model), model).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.col("text")).alias("round_trip"))
