"""Joins and near-duplicate operators against all-pairs comparison, and the pipeline."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from qualab.llm import embedding_dedup, ngram_join, passages
from qualab.llm.components import components

from .conftest import DOCS, ROWS, prose


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (250, 300), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5), "t").collect()}
    want = plain_components({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items()}


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_groups(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    group = plain_components(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    return sorted((-1 if i is None else i, len(sets[k]), -1 if (c := least.get(group[k]) if sets[k] else i) is None else c) for k, (i, _) in enumerate(rows))


def edited(text, seed, k):
    r, w = np.random.default_rng(seed), text.split(" ")
    for i in r.choice(len(w), k, replace=False):
        w[i] = f"e{seed}_{i}"
    return " ".join(w)


@pytest.mark.parametrize("list_rows", [8192, 4])
def test_op10_equals_all_pairs(spark, docs, none, monkeypatch, list_rows):
    monkeypatch.setattr(ngram_join, "LIST_ROWS", list_rows)  # 4: lists of hot shingles come in parts
    base = [prose(i, 120) for i in range(6)]
    rows = [(i, t) for i, t, *_ in ROWS]
    rows += [(1000 + 50 * b + k, edited(base[b], 10 * b + k, 1 + k % 5)) for b in range(6) for k in range(25)]  # around the limit
    rows += [(2000 + k, " ".join(base[0].split(" ")[k : k + 90])) for k in range(0, 30, 3)]  # a chain of shifted texts
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in ngram_join.ngram_groups(df).collect())
    assert got == plain_groups(rows)
    assert ngram_join.ngram_groups(none).count() == 0 and ngram_join.ngram_groups(docs).count() == len(ROWS)


def test_op7_finds_passages(spark, docs, none):
    shared = prose(900, 70)
    near = edited(shared, 5, 1)
    rows = [(i, prose(i, 150) + " " + shared + " " + prose(500 + i, 40 + i)) for i in range(0, 40, 2)]
    rows += [(i, prose(i, 100)) for i in range(1, 40, 2)] + [(41, prose(41, 30) + " " + near + " " + prose(42, 90))]
    rows += [(42, " ".join(shared.split(" ")[:40]) + " " + prose(43, 100)), (43, prose(44, 80) + " " + prose(44, 80)), (None, shared), (45, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = passages.repeated_passages(df).collect()
    texts = {i: (t or "").lower().split() for i, t in rows}
    assert {r.doc_id for r in out} == {*range(2, 40, 2), 41}
    for r in out:
        a, b = texts[r.source_doc_id][r.source_start : r.source_start + r.end - r.start], texts[r.doc_id][r.start : r.end]
        assert r.source_doc_id < r.doc_id and r.end - r.start >= 50
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert len(x & y) >= 0.74 * len(x | y)
        if r.doc_id < 40:
            assert (r.start, r.end) == (150, 220)
    assert passages.repeated_passages(none).count() == 0
    passages.repeated_passages(docs).collect()


def plain_passage(x, y, least):
    """Whether shingle lists x and y have intervals of ``least`` or more with a multiset Jaccard of 0.75."""
    for i in range(len(x) - least + 1):
        for j in range(len(y) - least + 1):
            for n in range(least, len(x) - i + 1):
                for m in {n - 1, n, n + 1, n + 2}:
                    if least <= m <= len(y) - j:
                        common = sum((collections.Counter(x[i : i + n]) & collections.Counter(y[j : j + m])).values())
                        if common >= 0.75 * (n + m - common):
                            return True
    return False


def test_op7_finds_passages_with_words_put_in_or_left_out(spark):
    shared = prose(910, 64).split()
    near = [shared[:32] + ["in"] + shared[32:], shared[:30] + shared[31:], shared[:20] + ["in"] + shared[20:42] + shared[43:],
            shared[:14] + ["in"] + shared[14:28] + ["in"] + shared[28:42] + ["in"] + shared[42:]]
    rows = [(0, " ".join(shared))] + [(k + 1, " ".join([*prose(920 + k, 30).split(), *x, *prose(930 + k, 30).split()])) for k, x in enumerate(near)]
    runs = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {k + 1 for k, x in enumerate(near) if plain_passage(runs(shared), runs(x), 46)}
    assert {1, 2} <= want
    for k in sorted(want):  # each with the first text alone, so that none is found by another
        (got,) = passages.repeated_passages(spark.createDataFrame([rows[0], rows[k]], "doc_id long, text string")).collect()
        assert (got.doc_id, got.source_doc_id, got.start, got.end, got.source_start) == (k, 0, 30, 30 + len(near[k - 1]), 0)
        assert got.jaccard >= 0.75


@pytest.mark.parametrize("limit", [4_000_000, 1])
def test_op7_finds_every_copy_under_any_partitioning(spark, monkeypatch, limit):
    chunks = passages.chunks
    monkeypatch.setattr(passages, "chunks", lambda batches: chunks(batches, limit=limit))  # 1: each text is a chunk
    shared = prose(940, 60).strip()
    twice = " ".join([prose(941, 30), shared, prose(942, 40), shared, prose(943, 30)])
    rows = [(1, prose(944, 50) + " " + shared), (2, twice), (3, shared + " " + prose(945, 20) + " " + shared)]
    for parts in ([rows], [rows[:1], rows[1:]], [[r] for r in rows], [rows[1:], rows[:1]]):
        df = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(lambda x: x), "doc_id long, text string")
        got = {(r.doc_id, r.start, r.end) for r in passages.repeated_passages(df).collect()}
        assert got == {(2, 30, 90), (2, 130, 190), (3, 0, 60), (3, 80, 140)}


@pytest.mark.parametrize("where", [[5], [12], [25], [37], [24, 25], [1, 48]])
def test_op7_keys_meet_at_the_least_length_and_similarity(where):
    n, r, texts = 400, np.random.default_rng(5), []
    words = lambda k: [f"w{x}" for x in r.integers(0, 100_000, k)]
    for _ in range(n):
        near = list(shared := words(50))
        for i in where:
            near[i] = f"edit{r.integers(0, 1 << 40)}"
        texts += [" ".join(words(30) + x + words(30)).encode() for x in (shared, near)]
    key, doc, c, left, right = passages._window_rows(texts, np.arange(2 * n), 50, passages.FUNCTIONS)
    met = set()
    for i in np.flatnonzero((key[1:] == key[:-1]) & (doc[1:] == doc[:-1] + 1) & (doc[1:] % 2 == 1)):
        if min(c[i] - left[i], c[i + 1] - left[i + 1]) + min(right[i] - c[i], right[i + 1] - c[i + 1]) + 1 >= 46:
            met.add(doc[i])
    assert len(met) >= 0.99 * n


def test_op7_windows_are_those_of_the_definition():
    r = np.random.default_rng(3)
    values = r.integers(0, 1 << 62, 300, dtype=np.uint64)
    text = np.repeat([0, 1, 2], [120, 20, 160])
    got = set(zip(*(x.tolist() for x in passages.compact_windows(values, text, 25))))
    want = set()
    for c in range(300):
        left = right = c
        while left > 0 and text[left - 1] == text[c] and values[left - 1] > values[c]:
            left -= 1
        while right < 299 and text[right + 1] == text[c] and values[right + 1] > values[c]:
            right += 1
        if right - left + 1 >= 25:
            want.add((left, c, right))
    assert got == want


def test_op7_stage_removes_later_copies(spark, docs):
    shared = prose(901, 60).strip()
    rows = [(1, "first " + shared + " end", None, "s", 1), (2, "start here\n" + shared + " é tail", "en", "s", 2), (3, None, "en", "s", 3)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "_spans")
    out = {r.doc_id: r for r in passages.stage(spark, df, "").collect()}
    assert out[1].text == rows[0][1] and out[2].text == "start here é tail" and out[2].n_chars == 17 and out[3].text is None
    assert passages.stage(spark, docs, "").columns == docs.columns and passages.stage(spark, docs, "").count() == len(ROWS)


def plain_embeddings(rows):
    ok = [k for k, (_, e, lab) in enumerate(rows) if lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in ok}
    links = [(i, j) for i in ok for j in ok if j < i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    count = collections.Counter(x for p in links for x in p)
    group = plain_components(range(len(rows)), links)
    least = {}
    for k in range(len(rows)):
        least[group[k]] = min(least.get(group[k], rows[k][0]), rows[k][0])
    return {rows[k][0]: (count[k], least[group[k]], least[group[k]] == rows[k][0]) for k in range(len(rows))}


@pytest.mark.parametrize("leaf,block", [(1024, 2048), (64, 40)])
def test_op6_equals_all_pairs(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)  # 64, 40: trees of several levels, groups of several blocks
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(1)
    rows = []
    for c in range(40):
        center = r.normal(size=16)
        rows += [(len(rows) + k, (center + r.normal(size=16) * 0.06).astype(np.float32).tolist(), c % 2) for k in range(1 + c % 12)]
    center = r.normal(size=16)
    rows += [(len(rows) + k, (center + r.normal(size=16) * 0.01).astype(np.float32).tolist(), 0) for k in range(150)]
    rows += [(len(rows) + k, center.astype(np.float32).tolist(), 0) for k in range(20)]
    rows += [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] + [1.0] * 15, 0), (5003, [None] + [1.0] * 15, 0),
             (5004, center.astype(np.float32).tolist(), None), (5005, [], 1), (5006, [1.0, 2.0], 0), (5007, [2.0, 4.0], 0), (5008, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_duplicates(df).collect()}
    assert got == plain_embeddings(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pipeline_stages_keep_clean_documents(spark, docs, tmp_path, labels):
    labels.withColumn("toxic", F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    names = docs.columns
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path)).cache()
        assert at.columns == names
    kept = {r.doc_id for r in at.collect()}
    assert {i for i in range(30)} <= kept and kept.isdisjoint({41, 42, 43, 50})
    packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "substring dedup", "secret scans", "best-fit packing"]


def test_op7_blocks_keep_their_numbers():
    r = np.random.default_rng(3)
    for n in (1, 2, 1000):
        columns = [np.sort(r.integers(0, 1 << 56, n)), r.integers(-(1 << 62), 1 << 62, n), np.full(n, -5), r.integers(0, 300, n) - passages._FOUND,
                   np.array([-(1 << 63), (1 << 63) - 1] * n, np.int64)[:n]]
        for x, y in zip(columns, passages.unpacked(passages.packed(columns), len(columns))):
            assert x.tolist() == y.tolist()


def test_op7_negative_and_large_ids(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    ids = [-(1 << 62), -7, 3, (1 << 62) + 1]
    df = spark.createDataFrame([(i, f"own{k} {passage} end{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    for parts in (1, 3):
        rows = passages.repeated_passages(df.repartition(parts)).collect()
        assert sorted((x.doc_id, x.start, x.end) for x in rows) == [(i, 1, 61) for i in ids[1:]]
        assert all(x.source_doc_id in ids and x.source_doc_id < x.doc_id and x.source_start == 1 for x in rows)


def test_op10_verification_reads_only_the_sets_of_its_pairs(spark, monkeypatch):
    seen, split = [], ngram_join.split
    rows = [(i, f"common words start each text {i} " + " ".join(f"t{i}x{j}" for j in range(40))) for i in range(40)]
    rows += [(100 + i, rows[0][1] + f" tail{i}") for i in range(3)]
    monkeypatch.setattr(ngram_join, "split", lambda df, key, ids: seen.append((df.columns, ids.distinct().count())) or split(df, key, ids))
    out = {r.doc_id: r.component_id for r in ngram_join.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: 0 if i >= 100 else i for i, _ in rows}
    assert {tuple(c) for c, _ in seen} == {("sid", "n", "ranges"), ("sid", "set")}
    assert all(n <= 4 for c, n in seen if c == ["sid", "set"])


def test_op10_sketches_keep_every_link_and_drop_what_differs(spark):
    base = prose(960, 130)
    texts = [edited(base, k, 1 + k % 16) for k in range(60)] + [prose(970 + k, 130) for k in range(10)] + ["one", ""]
    sets = [shingles(t) for t in texts]
    words = ngram_join.Words([t.encode() for t in texts])
    rows, keys = ngram_join.text_shingles(words)
    sketch = ngram_join._sketches(rows, keys, len(texts)).tolist()
    nodes = spark.createDataFrame([(i, len(s), *k) for i, (s, k) in enumerate(zip(sets, sketch))], ["i", "n", *ngram_join.SKETCH])
    pairs = nodes.crossJoin(nodes.select(*(F.col(c).alias(f"{c}2") for c in nodes.columns))).where("i < i2 and n > 0 and n2 > 0")
    got = {(r.i, r.i2) for r in pairs.where(ngram_join._differ_little("", "2")).collect()}
    links = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    far = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) < 60 * len(sets[i] | sets[j])}
    assert links <= got and len(links) > 20 and len(far & got) < 0.01 * len(far)


def test_op10_large_groups_are_not_listed_for_single_sets_that_differ(spark):
    base = [prose(980 + k, 130) for k in range(42)]
    texts = [edited(base[0], k, 1) for k in range(40)] + [edited(base[0], 900 + k, 2) for k in range(3)] + base[1:] + [edited(base[41], 1, 1)]
    groups = [0] * 40 + list(range(1, 46))  # the last two are alike, and single
    rows, keys = ngram_join.text_shingles(ngram_join.Words([t.encode() for t in texts]))
    sketch, sets = ngram_join._sketches(rows, keys, len(texts)).tolist(), [shingles(t) for t in texts]
    df = spark.createDataFrame([(7, i, len(x), 0, g, *k) for i, (x, g, k) in enumerate(zip(sets, groups, sketch))], ["s", "sid", "n", "pos", "g", *ngram_join.SKETCH])
    pairs = df.select("sid", "g", "n", *ngram_join.SKETCH)
    pairs = pairs.crossJoin(pairs.select(*(F.col(c).alias(f"{c}2") for c in pairs.columns))).where("g != g2 and n <= n2 and 4 * n >= 3 * n2")
    want = {(r.sid, r.sid2) for r in pairs.where(ngram_join._differ_little("", "2")).collect()}
    assert {(r.sid, r.sid2) for r in ngram_join._pairs_of_groups(df).collect()} == want
    assert len([p for p in want if {*p} & {40, 41, 42}]) > 60 and {*want} & {(83, 84), (84, 83)}
    assert ngram_join._with_groups(df).count() < len(want) + 100  # 40 sets with 45 groups are 1,800
