"""Hard negatives, lexical search and line dedup against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callmeter.llm import hard_negatives, lexical_search, line_dedup, perfect_hash


def brute_negatives(rows, anchors, positives, negatives, low, high):
    def whole(rows):
        return [(i, label, [math.floor(256 * float(x)) for x in v]) for i, label, v in rows if None not in (i, label) and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    rows, out = whole(rows), []
    for i, label, v in whole(anchors):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows)
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits)]
    return sorted(out)


def vectors(seed, n=150, dims=3):
    r = random.Random(seed)
    rows = [(i, r.choice([0, 0, 1, 2, None]), [r.choice([-1.0, -0.25, 0.0, 0.3, 0.7, 1.0]) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, 1, [0.7, 0.7, 0.7]) for i in range(40)] + [(None, 1, [1.0] * 3), (500, 1, None), (501, 1, [float("nan"), 1.0, 1.0]), (502, 0, [None, 1.0, 1.0]), (503, 0, [float("inf")] * 3)]
    return rows + [(504, 0, []), (505, 1, [0.7]), (506, 0, [0.7] * 5), rows[0], rows[0], rows[3]]


@pytest.mark.parametrize("low,high,k", [(80, 100, 5), (33, 101, 3)])
def test_hard_negatives(spark, monkeypatch, low, high, k):
    rows = vectors(low)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5).withColumn("key", F.lit("x")).withColumn("rank", F.lit(0))
    want = brute_negatives(rows, [x for x in rows if x[0] is not None and x[0] % 10 == 0], k, k, low, high)
    for block, scores, held in ((1 << 19, 1 << 22, 1 << 20), (30, 40, 10)):
        for name, value in (("BLOCK", block), ("SCORES", scores), ("HELD", held), ("ANCHORS", 7)):
            monkeypatch.setattr(hard_negatives, name, value)
        got = hard_negatives.mine(df, df.filter("vec_id % 10 = 0"), k, k, low, high)
        assert sorted(map(tuple, got.collect())) == want and want
    assert hard_negatives.mine(df.limit(0), df.limit(0)).count() == hard_negatives.mine(df, df.limit(0)).count() == 0


def test_scores_are_exact_or_refused():
    a = np.array([[2.0**30 + 1, 3.0]])
    assert hard_negatives.inner(a, a).tolist() == [[(2**30 + 1) ** 2 + 9]]
    with pytest.raises(ArithmeticError):
        hard_negatives.inner(a * 2**31, a)


def brute_search(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, split(t)) for i, t in docs]
    n, total, out = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs), []
    for item, text in items:
        own, scored = set(split(text)), []
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in d for _, d in docs) + 1))) for t in own}
        for i, d in docs:
            m = 50 + (50 * len(d) * n) // total if total else 0
            scored.append((sum(w[t] * ((10**9 * d.count(t)) // (1000 * d.count(t) + 20 * m)) for t in own if t in d), i))
        found = sorted([x for x in scored if x[0] > 0], key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(found)]
    return sorted(out, key=str)


def test_search(spark, docs, monkeypatch):
    r = random.Random(5)
    words = ["A", "b", "Éa", "éa", "中文", "x1", "[", "_", "the", "THE", "w\x1cw", "u\u0085", "😀"] + [f"w{i}" for i in range(30)]
    text = lambda n: r.choice([" ", "\n", "-", "."]).join(r.choice(words[: r.choice([6, 13, 43])]) for _ in range(n))
    rows = [(i, text(r.choice([0, 1, 5, 40, 300]))) for i in range(300)] + [(r["doc_id"], r["text"]) for r in docs.collect()] + [(i, "the a the") for i in range(1000, 1060)]
    items = [(i, text(r.choice([1, 3, 20]))) for i in range(12)] + [(3, "the"), (None, "中文 one word7"), (90, None), (91, "absent"), (92, "...")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit(1)).repartition(6)
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(7))
    for k, postings, size in ((50, 1 << 20, 4 << 20), (5, 50, 700)):
        monkeypatch.setattr(lexical_search, "POSTINGS", postings)
        monkeypatch.setattr(lexical_search, "BLOCK_BYTES", size)
        assert sorted(map(tuple, lexical_search.search(df, queries, k).collect()), key=str) == brute_search(rows, items, k)
    assert lexical_search.search(df.limit(0), queries).count() == lexical_search.search(df, queries.limit(0)).count() == 0


def test_accumulators_are_limited():
    """A common term makes no accumulator where it cannot lift a document to the k-th score, and those that are there get it."""
    rare, common = (np.arange(5), np.full(5, 100)), (np.arange(1000), np.full(1000, 9))
    docs, score, passed = lexical_search.accumulate([rare, common], [100, 9], 1000, 5, 1)
    assert docs.tolist() == list(range(5)) and score.tolist() == [109] * 5 and passed == 995
    docs, score, passed = lexical_search.accumulate([rare, common], [100, 100], 1000, 5, 1)
    assert len(docs) == 1000 and passed == 0  # what is left can tie
    assert len(lexical_search.accumulate([rare, common], [100, 9], 1000, 5, 110)[0]) == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3) | st.integers(0, 2**64 - 1)), max_size=300))
def test_perfect_hash(keys):
    hi, lo = (np.array([k[i] for k in sorted(keys)], np.uint64) for i in (0, 1))
    at = perfect_hash.numbers(*perfect_hash.build(hi, lo), hi, lo)
    assert sorted(at.tolist()) == list(range(len(keys)))


def test_perfect_hash_is_small():
    r = np.random.default_rng(1)
    hi, lo = (r.integers(0, 2**64, 65536, np.uint64) for _ in range(2))
    sizes, words = perfect_hash.build(hi, lo)
    assert sorted(perfect_hash.numbers(sizes, words, hi, lo).tolist()) == list(range(65536)) and words.nbytes * 8 < 5 * 65536


def brute_lines(rows, min_docs, min_chars):
    white = "\x20\x09\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(white))
    lines = [(t or "").split("\n") for _, t in rows]
    often = {}
    for own in lines:
        for k in {key(x) for x in own}:
            often[k] = often.get(k, 0) + 1
    out = []
    for (i, _), own in zip(rows, lines):
        kept = [x for x in own if not (len(key(x)) >= min_chars and often[key(x)] >= min_docs)]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (3, 4)])
def test_line_dedup(spark, docs, monkeypatch, tmp_path, min_docs, min_chars):
    r = random.Random(min_docs)
    pool = ["Hot line", " hot LINE\t", "", "  ", "éé", "ÉÉ", "x\r", "a", "\u0085b", "中文中文"] + [f"line {i}" for i in range(60)]
    rows = [(i, "\n".join(r.choice(pool[: r.choice([3, 10, 70])]) for _ in range(r.choice([0, 1, 4, 30])))) for i in range(150)]
    rows += [(r["doc_id"], r["text"]) for r in docs.collect()] + [(7, None), (None, "Hot line"), rows[0], rows[0], (9, "\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(F.lit(1).alias("hi"), "text", "doc_id", F.lit("c").alias("chunk"), F.lit("s").alias("a.b"), F.lit(9).alias("N_lines")).repartition(3)
    df.write.parquet(str(tmp_path / "docs"))
    want = brute_lines(rows, min_docs, min_chars)
    for shard, held, source in ((1 << 16, 1 << 18, df), (8, 5, spark.read.parquet(str(tmp_path / "docs")))):
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard)
        monkeypatch.setattr(line_dedup, "HELD", held)
        got = line_dedup.line_dedup(source, min_docs, min_chars)
        assert got.columns == ["hi", "text", "doc_id", "chunk", "a.b", "n_lines", "n_dropped"]
        assert sorted([(x["doc_id"], x["text"], x["n_lines"], x["n_dropped"]) for x in got.collect()], key=str) == want
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_queries(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = hard_negatives.op11_hard_negatives(spark, data)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    vecs = [(i, (c + 1) % 10 if i % 7 == 0 else c, v) for i, c, v in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert sorted(map(tuple, got.collect())) == brute_negatives(vecs, [v for v in vecs if v[0] % 100 == 0], 5, 5, 80, 100)
    got = lexical_search.op12_lexical_search(spark, data)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, [tuple(x) for x in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()], 50)
    got = line_dedup.op13_line_dedup(spark, data)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, g in brute_lines(rows, 10, 1)], key=str)
