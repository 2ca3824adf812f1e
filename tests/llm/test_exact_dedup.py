import hashlib
import re

import pytest
from pyspark.sql import functions as F

from callmeter.llm import exact_dedup


def brute(rows):
    groups = {}
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        groups.setdefault(norm, []).append(r)
    out = []
    for norm, g in groups.items():
        g.sort(key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        for i, r in enumerate(g):
            out.append((r["doc_id"], g[0]["doc_id"], len(g), i == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 100, 4096])
@pytest.mark.parametrize("poor_hash", [False, True])
def test_against_brute_force(docs, block, poor_hash):
    some = docs.filter("length(text) < 1000 OR text IS NULL") if block == 3 else docs
    key = F.length("block").cast("long") if poor_hash else None
    got = exact_dedup.exact_dedup(some, block, key).collect()
    assert sorted(map(tuple, got), key=str) == brute(some.collect())


@pytest.mark.parametrize("block", [3, 4096])
def test_blocks_after_the_first_count(spark, block):
    """Texts of as many blocks that differ in a later one alone are not equal."""
    x, y = "x" * block, "y" * block
    texts = [x + "x", x + x, x + y, x, "x", x + x + "x", x + x + x, x + x + y, x + y + x, x + " " + x]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = exact_dedup.exact_dedup(rows, block).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows.collect())


def test_keep_one_and_no_rows(docs):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 7, 8]
    assert exact_dedup.exact_dedup(docs.filter("doc_id < 0")).count() == 0


def test_blocks_are_cut_in_one_pass(spark):
    """The blocks of a long text of two-byte characters, and time that grows no faster than the text does."""
    text = F.repeat(F.lit("é1😀 中x"), 50_000)
    whole = spark.range(1).select(F.regexp_replace(text, exact_dedup.WHITE, "").alias("norm"))
    blocks = whole.select("norm", exact_dedup._blocks(4096).alias("b")).first()
    assert "".join(blocks["b"]) == blocks["norm"] and [len(x) for x in blocks["b"][:-1]] == [4096] * (len(blocks["b"]) - 1)
    assert "substr" not in exact_dedup._blocks(4096)._jc.toString()
