"""Sharding, Merkle manifest and lexical search against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qualab.llm import lexical_search, merkle, sharding

from .conftest import DOCS, ROWS, prose

KEPT = ["doc_id", "source", "text"]


def test_shards_have_equal_counts_and_the_mixture(spark):
    sources = ["big"] * 5000 + ["mid"] * 900 + [None] * 300 + [f"s{i}" for i in range(700)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "doc_id long, source string")
    rows = sharding.interleave(df, shards=7).select("row.*", "stratum_rank", "shard", "slot").collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(sources)))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for source, n in (("big", 5000), ("mid", 900), (None, 300)):
        held = collections.Counter(r.shard for r in rows if r.source == source)
        assert all(abs(held[k] - n / 7) <= 2.5 for k in range(7)), (source, held)
    small = collections.Counter(r.shard for r in rows if (r.source or "").startswith("s"))
    assert all(abs(small[k] - 100) <= 3 for k in range(7))  # sources of one row interleave as well
    by_rank = sorted((r.stratum_rank, r.doc_id) for r in rows if r.source == "big")
    assert [x for x, _ in by_rank] == list(range(5000)) and [x for _, x in by_rank] != sorted(x for _, x in by_rank)


def plain_shards(rows, shards):
    """(doc_id, source, shard, slot) by the definition, for unique ids."""
    h = lambda v: int(hashlib.md5(f"{sharding.SEED}|{'-' if v is None else v}".encode()).hexdigest()[:15], 16)
    strata = collections.defaultdict(list)
    for i, s in rows:
        strata["-" if s is None else "=" + s].append((h(i), i, s))
    order, alike = [], collections.defaultdict(list)
    for name, of in strata.items():
        alike[len(of)].append((h(name), name))
    for name, of in strata.items():
        phase = (sorted(alike[len(of)]).index((h(name), name)) + 0.5) / len(alike[len(of)])
        for rank, (_, i, s) in enumerate(sorted(of)):
            order.append(((rank + phase) / len(of), name, rank, i, s))
    out, first = [], {}
    for place, (_, _, _, i, s) in enumerate(sorted(order, key=lambda x: x[:3])):
        shard = place * shards // len(order)
        out.append((i, s, shard, place - first.setdefault(shard, place)))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 9])
def test_shards_equal_the_definition_under_any_partitioning(spark, partitions):
    rows = [(i * 7, ["a", "b", "b", None][i % 4]) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(partitions)
    got = sharding.interleave(df, shards=13).select("row.*", "shard", "slot").collect()
    assert sorted(tuple(r) for r in got) == plain_shards(rows, 13)


def test_shards_edges(docs, none, monkeypatch):
    out = sharding.interleave(docs, KEPT, shards=5)
    got = out.select("row.*", "shard", "slot").collect()
    assert sorted(map(str, ((r.doc_id, r.source, r.text) for r in got))) == sorted(map(str, ((i, s, t) for i, t, _, s, _ in ROWS)))
    assert collections.Counter(r.shard for r in got).most_common()[0][1] <= -(-len(ROWS) // 5)
    whole = sharding.interleave(docs, shards=5).select("row.*").columns
    assert whole == docs.columns  # clashing names go along
    assert sharding.interleave(none).count() == 0
    # more shards than rows: one row each, the rest empty
    assert sorted(r.slot for r in sharding.interleave(docs, KEPT, shards=1000).collect()) == [0] * len(ROWS)


def test_shards_of_a_repeated_id_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    monkeypatch.setattr(sharding, "MOST_HOT", 4)
    df = spark.createDataFrame([(None if i % 2 else i, "a") for i in range(4000)], "doc_id long, source string")
    rows = sharding.interleave(df, shards=6).collect()
    assert sorted(r.stratum_rank for r in rows) == list(range(4000))
    assert sorted(collections.Counter(r.shard for r in rows).values()) == [666, 666, 667, 667, 667, 667]


def test_written_shards_hold_whole_rows_by_slot(spark, docs, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/out", shards=4, files=9)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.select("doc.*").columns == docs.columns and back.count() == len(ROWS)
    want = sharding.interleave(docs, KEPT, shards=4).select("row.*", "shard", "slot").collect()
    got = back.select("doc.doc_id", "doc.source", "doc.text", "shard", "slot").collect()
    key = lambda r: (r.shard, r.slot)
    assert sorted(map(key, want)) == sorted(map(key, got))
    assert sum(a == b for a, b in zip(sorted(want, key=key), sorted(got, key=key))) >= len(ROWS) - 6  # repeated ids may change places


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(digests):
    """The root, and for each leaf its siblings by level as (left, right)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for i, p in enumerate(paths):
            run = runs[at[i] // 8]
            p.append(("".join(run[: at[i] % 8]), "".join(run[at[i] % 8 + 1 :])))
            at[i] //= 8
        level = [sha("".join(run)) for run in runs]
    return level[0], paths


def plain_manifest(rows):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    trees = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        trees[lang].append((-1 if i is None else i, plain_leaf(i, source, lang, n, text), i, text, source, n))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: plain_tree([x[1] for x in sorted(trees[lang], key=lambda x: x[:2])]) for lang in order}
    root, tops = plain_tree([built[lang][0] for lang in order])
    out = []
    for lang, top in zip(order, tops):
        subroot, paths = built[lang]
        for (_, leaf, i, text, source, n), path in zip(sorted(trees[lang], key=lambda x: x[:2]), paths):
            node = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None:
                node = plain_leaf(i, source, lang, n, text.translate(lower))
            for left, right in path + top:
                node = sha(left + node + right)
            out.append((i, leaf, subroot, root, sha("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=str)


def test_manifest_equals_a_plain_tree(spark, docs, none):
    got = sorted((tuple(r) for r in merkle.verify(docs).collect()), key=str)
    assert got == plain_manifest(ROWS)
    assert merkle.verify(none).count() == 0


def test_manifest_of_deep_uneven_trees(spark):
    langs = ["en"] * 700 + ["de"] * 64 + ["fr"] * 65 + ["x"] + [None] * 9 + [f"l{i}" for i in range(20)] + ["", "é", "Z"]
    rows = [(1000 - 3 * i, f"Text {i % 40}" if i % 11 else None, lang, None, i) for i, lang in enumerate(langs)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted((tuple(r) for r in merkle.verify(df).collect()), key=str)
    assert got == plain_manifest(rows) and 200 < sum(r[6] for r in got) < len(rows) - 200
    one = spark.createDataFrame(rows[:1], DOCS)
    assert [tuple(r) for r in merkle.verify(one).collect()] == plain_manifest(rows[:1])


def test_repeated_rows_share_records_and_all_get_proofs(spark):
    rows = [(None, "Same", "en", "s", 4)] * 300 + [(i, "t", "en", "s", 1) for i in range(50)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert sorted((tuple(r) for r in merkle.verify(df).collect()), key=str) == plain_manifest(rows)


def test_requests_get_the_paths_of_all_leaves(spark):
    rows = [(i, f"t{i}", "en" if i % 5 else "de", "s", 2) for i in range(300)]
    leaves = spark.createDataFrame(rows, DOCS).select(
        F.concat(F.lit("="), "lang").alias("tree"), F.col("doc_id").alias("key"),
        merkle.leaf_digest([F.col(c) for c in merkle.COLUMNS]).alias("digest"), F.struct("doc_id").alias("info"))
    made = merkle.manifest(leaves)
    whole = {(r.tree, r.rank): (r.info.doc_id, r.path) for r in made.paths().collect()}
    assert len(whole) == 300
    wanted = [("=en", 0), ("=en", 7), ("=en", 239), ("=de", 59), ("=en", 240), ("=xx", 0)]  # two do not exist
    some = made.paths(spark.createDataFrame(wanted, "tree string, rank long")).collect()
    assert {(r.tree, r.rank): (r.info.doc_id, r.path) for r in some} == {k: whole[k] for k in wanted[:4]}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    """Rows (item_id, rank, score, doc_id or None); ids of equal scores in order."""
    counts = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, tokens = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 50 + (50 * c.total() * n_docs) // tokens
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in set(terms_of(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r, -s, i) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def ask(docs, items, k, **how):
    return sorted(((r.item_id, r["rank"], r.score, r.doc_id) for r in lexical_search.search(docs, items, k, **how).collect()), key=str)


def test_search_equals_brute_force(spark, docs, none):
    items = [(0, prose(3, 40)), (1, "W1 w2 w3-w4"), (2, None), (3, ""), (4, "?? !"), (5, "x é日本"), (6, prose(100, 90)), (7, "unknown w7")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1)).withColumn("score", F.lit("x"))
    plain = [(i, t) for i, t, *_ in ROWS]
    for k in (1, 5, 50):
        assert ask(docs, asked, k) == plain_search(plain, items, k)
    assert ask(docs, asked, 5, block_bytes=200) == plain_search(plain, items, 5)  # several blocks
    assert ask(none, asked, 5) == [] and ask(docs, asked.limit(0), 5) == []


def test_search_prunes_masks_and_stays_exact(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = [f"t{int(300 * r.random() ** 3)}" for _ in range(3000)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randrange(1, 60)))) for i in range(1500)]
    docs += [(2000 + i, docs[7][1]) for i in range(80)]  # ties beyond k: the smallest ids stay
    items = [(0, " ".join(f"t{i}" for i in range(200))), (1, docs[7][1]), (2, "t0 t1 t2"), (3, "t250 t0")]  # 200 terms: several words
    monkeypatch.setattr(lexical_search, "CHUNK_DOCS", 100)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert ask(df, spark.createDataFrame(items, "item_id long, text string"), 20) == plain_search(docs, items, 20)


def test_search_scores_few_documents_once_the_best_are_known():
    terms = [[0, 1, 2] if i < 60 else [0] for i in range(5000)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(5000), pa.int64()), "n": pa.array([3] * 5000, pa.int64()),
                                        "terms": pa.array(terms, pa.list_(pa.int32())),
                                        "counts": pa.array([[1] * len(t) for t in terms], pa.list_(pa.int32()))})
    chunk = lexical_search.Chunk(batch, 5000, 15000, 3)
    best = lexical_search.Best(50)
    scored = chunk.search(np.arange(3), np.array([1, 3000, 3000]), best)
    assert scored == 60 and best.id.tolist() == list(range(50))
