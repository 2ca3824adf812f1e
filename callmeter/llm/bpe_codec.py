"""Byte-level BPE encoding and decoding of a column of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from callmeter.llm import bpe
from callmeter.llm.common import give_back

RANKS = "byte_bpe_multi_50k.tiktoken"


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def encode(docs: DataFrame, path: str, offsets: bool = False) -> DataFrame:
    """doc_id, ids; with offsets also starts, ends: the characters of the text that each token covers.

    path: a file of ranks, at the same place on all executors. A null or empty text has no ids. Rows are taken one by
    one: repeated and null ids stay, other columns are ignored. Memory is bounded by an Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.from_ranks(path)
        for batch in batches:
            ids = [enc.ids(x) for x in enc.encode(_texts(batch))]
            out = {"doc_id": batch.column("doc_id"), "ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))}
            if offsets:
                both = [enc.offsets(x) for x in ids]
                out |= {k: pa.array([x[i] for x in both], pa.list_(pa.int32())) for i, k in enumerate(("starts", "ends"))}
            yield pa.RecordBatch.from_pydict(out)
        enc.forget()
        give_back()

    more = ", starts array<int>, ends array<int>" if offsets else ""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>{more}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text, data (the bytes) of doc_id, ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.from_ranks(path)
        for batch in batches:
            data = [enc.decode_bytes(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            text = [x.decode("utf-8", "replace") for x in data]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": text, "data": pa.array(data, pa.binary())})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string, data binary")


def digests(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode() and then decode() give; with keep_ids also ids.

    A null or empty text has no ids, and the sums of an empty string. Repeated and null ids stay, other columns are ignored,
    no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.from_ranks(path)
        decimal = [b"%d" % i for i in range(len(enc.token_bytes))]
        for batch in batches:
            begin = 0
            for flat, n in enc.batches(batch.column("text")):
                of_ids, of_text = [], []
                ends = np.cumsum(n).tolist()
                for a, b in zip([0, *ends], ends):
                    own = flat[a:b].tolist()
                    of_ids.append(hashlib.sha256(b",".join(map(decimal.__getitem__, own))).hexdigest())
                    of_text.append(hashlib.sha256(b"".join(map(enc.token_bytes.__getitem__, own))).hexdigest())
                out = {"doc_id": batch.column("doc_id").slice(begin, len(n)), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}
                if keep_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)
                begin += len(n)
        enc.forget()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>" if keep_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op8_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(RANKS))
