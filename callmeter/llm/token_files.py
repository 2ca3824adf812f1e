"""Token ids of a corpus in files of entropy-coded blocks.

A folder of files has three Parquet tables. `blocks`: a row holds whole documents in ascending order of their ids: the
ids, the number of tokens of each, where the block begins in its file, and the tokens as one block of rans.py, which any
task can decode without the others. `frequencies`: how often the whole corpus has each id, the table of all blocks.
`files`: how many tokens come before each file; it is written last, so a folder that has it is whole. Nothing else is
needed to read: read() takes the path, in any session.

Tokens are made once and kept in the shared folder: both the counts and the sort by id read them. What reaches the
driver is bounded by the vocabulary (counts) and by the number of files (their lengths).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmeter.llm import bpe, rans
from callmeter.llm.common import shared_dir, written

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: A block ends with the document that brings it to so many tokens.
BLOCK_TOKENS = 1 << 20


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id (long), n_tokens, ids (little-endian, of 16 bits if the vocabulary allows); a null text has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.from_tokenizer(path)
        for batch in batches:
            begin = 0
            for ids, n in enc.batches(batch.column("text")):
                ends = np.cumsum(n)
                with_end = np.insert(ids, ends, end_id)
                offsets = np.concatenate([[0], (ends + np.arange(1, len(n) + 1)) * enc.dtype.itemsize]).astype(np.int64)
                data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(with_end.astype(enc.dtype))])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(begin, len(n)), "n_tokens": pa.array(n + 1, pa.int64()), "ids": data.cast(pa.binary())})
                begin += len(n)
        enc.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def token_counts(tokens: DataFrame, path: str) -> np.ndarray:
    """How often each id occurs; a task sends a row for each id that it has, the driver gets one for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.from_tokenizer(path)
        total = np.zeros(len(enc.token_bytes), np.int64)
        for batch in batches:
            total += np.bincount(enc.ids(b"".join(batch.column("ids").to_pylist())), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    sums = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(bpe.from_tokenizer(path).token_bytes), np.int64)
    out[sums["id"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the files of docs (doc_id, text) to a new folder. Rows with one id follow each other, also over files; a null id comes first.

    doc_id must cast to long. No rows give files without blocks; other columns are ignored.
    """
    spark = docs.sparkSession
    tokens = written(tokenize(docs, tokenizer, end_id), "tokens")
    counts = token_counts(tokens, tokenizer)
    table = rans.table(counts)
    dtype = bpe.from_tokenizer(tokenizer).dtype.str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, block_no, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        lens: list[int] = []
        data: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "file_no": pa.array([file_no], pa.int32()), "block_no": pa.array([block_no], pa.int32()),
                "start": pa.array([start], pa.int64()), "n_tokens": pa.array([size], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())), "lens": pa.array([lens], pa.list_(pa.int64())),
                "payload": pa.array([rans.encode(np.frombuffer(b"".join(data), dtype), table)], pa.binary()),
            })

        for batch in batches:
            for doc_id, n, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids")), strict=True):
                ids.append(doc_id)
                lens.append(n)
                data.append(x)
                size += n
                if size >= block_tokens:
                    yield block()
                    block_no, start = block_no + 1, start + size
                    ids, lens, data, size = [], [], [], 0
        if ids:
            yield block()

    kinds = "file_no int, block_no int, start long, n_tokens long, doc_ids array<long>, lens array<long>, payload binary"
    placed = tokens.withColumn("place", F.monotonically_increasing_id())  # parts the rows that share an id, or have none
    ordered = placed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    ordered.mapInArrow(run, kinds).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(int(i), int(counts[i])) for i in np.flatnonzero(counts)], "id int, n long").coalesce(1).write.parquet(f"{path}/frequencies")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("file_no").agg(F.sum("n_tokens").alias("n")).orderBy("file_no").collect()
    files, total = [], 0
    for r in sizes:
        files.append((r["file_no"], total))
        total += r["n"]
    spark.createDataFrame(files, "file_no int, first long").coalesce(1).write.parquet(f"{path}/files")


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document of the files at path, and its ids (array<int>) if asked for.

    A damaged block fails with ValueError.
    """
    files = {r["file_no"]: r["first"] for r in spark.read.parquet(f"{path}/files").collect()}
    found = spark.read.parquet(f"{path}/frequencies").toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    table = rans.table(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = rans.Reader(table)
        for batch in batches:
            for file_no, start, doc_ids, lens, payload in zip(*(batch.column(c) for c in ("file_no", "start", "doc_ids", "lens", "payload")), strict=True):
                got = reader.decode(payload.as_py()).astype("<u4")
                n = lens.values.to_numpy()
                ends = np.cumsum(n)
                parts = [got[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                out = {
                    "doc_id": doc_ids.values, "start": pa.array(files[file_no.as_py()] + start.as_py() + ends - n, pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()),
                }
                if ids:
                    out["ids"] = pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return spark.read.parquet(f"{path}/blocks").select("file_no", "start", "doc_ids", "lens", "payload").mapInArrow(run, kinds)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/callmeter/token-files-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path(TOKENIZER))
    return read(spark, path)
