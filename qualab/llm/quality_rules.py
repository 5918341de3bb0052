"""Quality rules: per-language and per-source thresholds from mergeable quantile sketches.

Each text gives a few measures.  KLL sketches of them are built per (language, source) in one aggregate
and merged into sketches per language and of the whole corpus.  Fences from their quartiles (Tukey's, with
a least spread) take the place of fixed cutoffs; each text is joined with the fences of its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, mix, stored, table

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CONTINUATION = (np.arange(256) & 0xC0) == 0x80

FENCE = 3.0  #: so many spreads (q75 - q25) beyond a quartile
LEAST_ROWS = 100  #: a group of fewer rows takes the fences of its language, that of the corpus next
#: measure: (SQL over the counts, least spread, whether low values fail as well)
MEASURES = {
    "symbol_share": ("n_symbols / n_words", 0.04, False),
    "dup_line_share": ("n_dup_lines / n_lines", 0.20, False),
    "repeat_share": ("n_repeat_words / n_words", 0.15, False),
    "word_length": ("word_chars / n_words", 1.0, True),
}


def _repeats(words: Words) -> np.ndarray:
    """Per text, the words that lie in 3-word windows found twice or more in it."""
    h, text, n = words.hash, words.text_of, len(words)
    out = np.zeros(len(words.bounds) - 1, np.int64)
    if n < 4:
        return out
    same = text[2:] == text[:-2]
    key = mix(mix(mix(text[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h[:-2]) + h[1:-1]) + h[2:])[same]
    at = np.flatnonzero(same)
    _, index, count = np.unique(key, return_inverse=True, return_counts=True)
    start = at[count[index] > 1]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[start + k] = True
    np.add.at(out, text[covered], 1)
    return out


def measure(texts: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) per text."""
    words = Words(texts, lower=False)
    size = len(texts)
    of_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[words.offset])
    white = np.ones(len(words.raw), bool)
    white[_spread(words.start, words.end)] = False
    chars = of_text(~white & ~CONTINUATION[words.raw])
    symbols = of_text(SYMBOLS[words.raw])
    dup, lines = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for i, text in enumerate(texts):
        own = [x for x in text.split(b"\n") if x.split(None, 1)]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    return [words.counts, chars, symbols, dup, _repeats(words), lines]


def _spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All positions of the intervals start..end."""
    length = end - start
    first = np.cumsum(length) - length
    return np.arange(int(length.sum())) - np.repeat(first - start, length)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measures(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``docs`` with its counts; null text has no words."""
    source = docs.select(*columns, F.col("text").alias("_text"))
    schema = docs.select(*columns, *(F.lit(0).cast("long").alias(c) for c in COUNTS)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *(pa.array(x, pa.int64()) for x in measure(texts))],
                                             names=[*columns, *COUNTS])

    return source.mapInArrow(run, schema)


def fences(rows: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row per group: low and high fence of each measure.

    The sketches are aggregates that combine before the shuffle, so a source with a third of all rows is
    no hot key; the sketches of languages and of the corpus are merged from those of the groups.
    """
    lang, source = groups
    k = F.lit(400)
    own = rows.groupBy(lang, source).agg(F.count("*").alias("n"), *(
        F.kll_sketch_agg_double(F.expr(sql).cast("double"), k).alias(m) for m, (sql, _, _) in MEASURES.items()))
    own = stored(own, "quality-sketches")
    merge = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, k).alias(m) for m in MEASURES)]
    by_lang, whole = own.groupBy(lang).agg(*merge), own.agg(*merge)

    def bounds(df: DataFrame, suffix: str, *keys: str) -> DataFrame:
        out = []
        for m, (_, spread, _) in MEASURES.items():
            q = lambda p: F.kll_sketch_get_quantile_double(F.col(m), F.lit(p))  # noqa: B023, E731
            wide = F.greatest(q(0.75) - q(0.25), F.lit(spread)) * FENCE
            out += [(q(0.25) - wide).alias(f"low_{m}{suffix}"), (q(0.75) + wide).alias(f"high_{m}{suffix}")]
        return df.where("n > 0").select(*keys, F.col("n").alias(f"n{suffix}"), *out)

    a, b = bounds(own, "", lang, source), bounds(by_lang, "_l", F.col(lang).alias("_l"))
    row = bounds(whole, "_w").first()  # one row, or none
    c = {f"{side}_{m}_w": F.lit(row[f"{side}_{m}_w"] if row else None).cast("double") for m in MEASURES for side in ("low", "high")}
    both = a.join(b, F.col(lang).eqNullSafe(F.col("_l")), "left").withColumns(c)
    pick = lambda x: F.when(F.col("n") >= LEAST_ROWS, F.col(x)).when(
        F.col("n_l") >= LEAST_ROWS, F.col(f"{x}_l")).otherwise(F.col(f"{x}_w"))
    return both.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"),
                       *(pick(f"{side}_{m}").alias(f"{side}_{m}") for m in MEASURES for side in ("low", "high")))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the measures that failed, for every row of ``docs``.

    The fences come from all rows that pass the base rules.  Null languages or sources are groups of
    their own; a text without words fails the base rules; where no row passes there is nothing to fence.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(measures(docs, ["doc_id", "lang", "source"]).withColumn("base_failed", failed), "quality-rows")
    limits = fences(rows.where(~F.col("base_failed")))
    beyond = []
    for m, (sql, _, low) in MEASURES.items():
        value = F.expr(sql)
        out = value > F.col(f"high_{m}")
        beyond.append(F.when((out | (value < F.col(f"low_{m}"))) if low else out, F.lit(m)))
    rules = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*beyond)))
    return rows.join(limits, rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"]),
                     "left").withColumn("failed_rules", F.array_join(rules, ",")).select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"),
        "failed_rules")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
