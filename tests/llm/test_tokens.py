import base64
import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from callmeter.llm import bpe, bpe_codec, rans, token_files

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rank_encoding():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = list("ae \n\t.'s1=-") + ["  ", "\n\n", "the", "Ünique,", "\u0250", "ª", "ing", "é", "ß", "中", "😀", "===", "\u00a0", "\x1c", "²", "<|endoftext|>"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_are_those_of_the_libraries(rank_encoding, text):
    multi, own = bpe.from_ranks(MULTI), bpe.from_tokenizer(JSON)
    assert multi.ids(multi.encode([text])[0]).tolist() == rank_encoding.encode_ordinary(text)
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    assert own.ids(own.encode([text])[0]).tolist() == t.encode(text, add_special_tokens=False).ids


def test_offsets_and_split_characters():
    enc = bpe.from_ranks(MULTI)
    text = "aé 中😀b"
    ids = enc.ids(enc.encode([text])[0])
    start, end = enc.offsets(ids)
    assert start[0] == 0 and end[-1] == len(text)
    assert all(a < b and x <= y for a, b, x, y in zip(start, end, start, start[1:] + [len(text)], strict=True))
    assert enc.decode(ids) == text
    assert "�" in "".join(enc.decode(ids[i : i + 1]) for i in range(len(ids)))


def test_codec_round_trip(spark, docs, rank_encoding):
    got = {(r["doc_id"], r["ids_sha256"]): r for r in bpe_codec.digests(docs, MULTI).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        ids = rank_encoding.encode_ordinary(text)
        found = got[r["doc_id"], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert found["n_tokens"] == len(ids)
        assert found["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = bpe_codec.decode(bpe_codec.encode(docs, MULTI, offsets=True), MULTI)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back.collect()) == sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())


@pytest.mark.parametrize("n", [0, 1, 7, 1000, 300_000])
def test_rans_round_trip_from_every_checkpoint(n):
    symbols = np.minimum(np.random.default_rng(n).zipf(1.4, n), 5000)
    t = rans.table(np.bincount(symbols, minlength=5001))
    block = rans.encode(symbols, t)
    reader = rans.Reader(t)
    assert (reader.decode(block) == symbols).all()
    parts = [reader.decode(block, s) for s in range(reader.sections(block))]
    assert (np.concatenate([*parts, np.zeros(0)]) == symbols).all()
    places = {0, rans.HEAD.size - 1, rans.HEAD.size, rans.HEAD.size + 8, len(block) // 2, len(block) - 1}
    for at in sorted(x for x in places if x < len(block)):
        damaged = bytearray(block)
        damaged[at] ^= 0x55
        with pytest.raises(ValueError):
            reader.decode(bytes(damaged))
    with pytest.raises(ValueError):
        reader.decode(block[:-1])


@pytest.mark.parametrize("block_tokens", [50, 1 << 20])
@pytest.mark.parametrize("kind", ["long", "int"])
def test_token_files(spark, docs, tmp_path, block_tokens, kind):
    t = Tokenizer.from_file(JSON)
    want, start = [], 0
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    for r in rows:
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    token_files.write(docs.withColumn("doc_id", F.col("doc_id").cast(kind)), str(tmp_path / "t"), JSON, block_tokens=block_tokens)
    got = token_files.read(spark.newSession(), str(tmp_path / "t"), ids=True).collect()
    assert sorted((tuple(x)[:4] for x in got), key=lambda x: x[1]) == want
    assert all(zlib.crc32(np.array(x["ids"], "<u4").tobytes()) == x["ids_crc32"] for x in got)


def test_no_rows(spark, docs, tmp_path):
    none = docs.filter("doc_id < 0")
    assert bpe_codec.digests(none, MULTI).count() == 0
    token_files.write(none, str(tmp_path / "t"), JSON)
    assert token_files.read(spark, str(tmp_path / "t")).count() == 0


def test_rows_without_an_id_are_dealt_to_many_files(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i, f"text {i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(df, str(tmp_path / "files"), public_tokenizers.path(token_files.TOKENIZER))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = spark.read.parquet(str(tmp_path / "files/blocks")).selectExpr("file_no", "exists(doc_ids, x -> x IS NULL) AS none").filter("none").distinct()
    assert blocks.count() > 1
    got = token_files.read(spark, str(tmp_path / "files"), ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert sorted(str((r["doc_id"], r["ids"])) for r in got) == sorted(str((r["doc_id"], r["ids"])) for r in token_files.read(spark, str(tmp_path / "files"), ids=True).collect())
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]
