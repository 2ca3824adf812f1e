"""Lines that many documents share, found in sharded perfect hashes.

A line's key is hashed to 128 bits. Runs of rows of a file (chunks) give each different key once, with the number of its
documents there, so that a line of a third of all documents is one small row a chunk. The sums by key are dealt to shards
by their hash, a bounded number of distinct keys in each; a shard is one row: a minimal perfect hash of its keys that
indexes an array of fingerprints and one of counts. Chunks probe the shards: the keys of a shard stream past its arrays,
and those that are frequent go back to their chunks, where they stream past the texts. Neither lines nor counts are
joined, no array is broadcast, and a task holds one shard's arrays or one chunk's frequent keys at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callmeter.llm import perfect_hash
from callmeter.llm.common import free, is_scan, written

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of a file in a chunk, and different keys of one that a task holds before it passes them on.
CHUNK_ROWS, HELD = 4096, 1 << 18
#: Keys of a shard, at most some.
SHARD_KEYS = 1 << 16


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()  # of bytes: A-Z alone


def _characters(key: bytes) -> int:
    return len(key) - sum(b & 0xC0 == 0x80 for b in key)


def _chunked(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the name of a column of its chunks. Equal numbers of two chunks only make them one."""
    (chunk,) = free(docs, "_chunk")
    if not is_scan(docs) or "_metadata" in {c.lower() for c in docs.columns}:
        rows = written(docs.withColumn(chunk, F.shiftright(F.monotonically_increasing_id(), 12)), "rows")
        return rows, chunk
    return docs.select("*", F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / CHUNK_ROWS)).alias(chunk)), chunk


def _keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """chunk, hi, lo, n of the different keys of each chunk (or part of one): n documents of it hold the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        now = None

        def passed_on() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(held), ">i8").astype(np.int64).reshape(-1, 2)
            n = np.fromiter(held.values(), np.int64, len(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(n), now), np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), n)], ["chunk", "hi", "lo", "n"])

        for batch in batches:
            for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if held and (chunk != now or len(held) > HELD):
                    yield passed_on()
                now = chunk
                keys = set(map(line_key, (text.as_py() or b"").split(b"\n")))
                held.update([xxhash.xxh3_128_digest(k) for k in keys if len(k) >= min_chars and (min_chars <= 1 or _characters(k) >= min_chars)])
        if held:
            yield passed_on()

    return rows.mapInArrow(run, "chunk long, hi long, lo long, n long")


_SHARD = "shard long, sizes binary, words binary, prints binary, counts binary, width int"


def _shard(table: pa.Table) -> pa.Table:
    """One row of the keys of a shard. Counts take as many bytes as the largest needs."""
    hi, lo, n = (np.asarray(table.column(c), np.int64) for c in ("hi", "lo", "n"))
    sizes, words = perfect_hash.build(hi.view(np.uint64), lo.view(np.uint64))
    at = perfect_hash.numbers(sizes, words, hi.view(np.uint64), lo.view(np.uint64))
    width = next(w for w in (1, 2, 4, 8) if w == 8 or n.max() < 1 << (8 * w))
    prints, counts = np.zeros(len(n), np.uint32), np.zeros(len(n), f"u{width}")
    prints[at], counts[at] = lo.astype(np.uint32), n
    row = {"shard": [table.column("shard")[0].as_py()], **{k: [v.tobytes()] for k, v in (("sizes", sizes), ("words", words), ("prints", prints), ("counts", counts))}}
    return pa.table({**row, "width": pa.array([width], pa.int32())})


def shards(keys: DataFrame, number: int) -> DataFrame:
    """The shards of the summed keys (hi, lo, n): shard, and sizes, words, prints, counts, width of its arrays."""
    sums = keys.groupBy("hi", "lo").agg(F.sum("n").alias("n")).withColumn("shard", F.pmod("hi", F.lit(number)))
    return sums.groupBy("shard").applyInArrow(_shard, _SHARD)


def probe(found: DataFrame, keys: DataFrame, number: int, min_docs: int) -> DataFrame:
    """chunk, hi, lo of the keys (chunk, hi, lo) that at least min_docs documents hold by the shards."""
    names = [c.split()[0] for c in _SHARD.split(", ")]
    blank = lambda *cs: [F.lit(None).cast(k).alias(c) for c, k in cs]
    kinds = [tuple(c.split()) for c in _SHARD.split(", ")][1:]
    index = found.select(*names, F.lit(0).alias("kind"), *blank(("chunk", "long"), ("hi", "long"), ("lo", "long")))
    asked = keys.select(F.pmod("hi", F.lit(number)).alias("shard"), *blank(*kinds), F.lit(1).alias("kind"), "chunk", "hi", "lo")
    both = index.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = None
        for batch in batches:
            kind = np.asarray(batch.column("kind"))
            heads = np.flatnonzero(kind == 0).tolist()
            for a, b in zip([0, *heads], [*heads, batch.num_rows]):
                part = batch.slice(a, b - a)
                if b > a and kind[a] == 0:
                    sizes, words, prints, counts = (part.column(c)[0].as_py() for c in ("sizes", "words", "prints", "counts"))
                    arrays = np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64), np.frombuffer(prints, np.uint32), np.frombuffer(counts, f"u{part.column('width')[0].as_py()}")
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                sizes, words, prints, counts = arrays
                hi, lo = (np.asarray(part.column(c), np.int64) for c in ("hi", "lo"))
                at = perfect_hash.numbers(sizes, words, hi.view(np.uint64), lo.view(np.uint64))
                often = pa.array((at >= 0) & (prints[at] == lo.astype(np.uint32)) & (counts[at] >= min_docs))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(often) for c in ("chunk", "hi", "lo")], ["chunk", "hi", "lo"])

    return both.mapInArrow(run, "chunk long, hi long, lo long")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with text less its frequent lines, n_lines (before) and n_dropped.

    Lines end at \\n. A line's key is the line without white space ([\\x20\\x09-\\x0D]) at its ends, A-Z lower-cased; keys
    of min_chars code points that min_docs documents hold lose all their lines in every document. A null text is read as
    an empty one and becomes one; such a text has one empty line. Each row is a document, also a repeated one. Other
    columns stay, but for those named as a result. No rows give no rows. Keys are told apart by 128 bits of a hash.
    """
    rows, chunk = _chunked(docs)
    keys = written(_keys(rows.select(chunk, F.col("text")), min_chars), "line-keys")
    number = -(-keys.count() // SHARD_KEYS) or 1
    frequent = probe(shards(keys, number), keys, number, min_docs)

    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    plain = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
    own = {c: f"c{rows.columns.index(c)}" for c in (*kept, chunk)}
    text = list(kept).index("text")
    kinds = StructType([docs.schema[c] for c in kept]).add("n_lines", "long").add("n_dropped", "long")
    dropped = frequent.select(F.col("chunk").alias("_k"), F.lit(0).alias("_kind"), "hi", "lo", *[F.lit(None).cast(docs.schema[c].dataType).alias(own[c]) for c in kept])
    texts = plain.select(F.col(own[chunk]).alias("_k"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("lo"), *[own[c] for c in kept])
    both = dropped.unionByName(texts).repartition("_k").sortWithinPartitions("_k", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: set[bytes] = set()
        now = None
        for batch in batches:
            chunks, kind = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    halves = np.stack([np.asarray(part.column(c), np.int64) for c in ("hi", "lo")], axis=1).astype(">i8").tobytes()
                    for i, k in enumerate(chunks[a:b]):
                        if k != now:
                            often, now = set(), k
                        often.add(halves[16 * i : 16 * i + 16])
                    continue
                out, total, gone = [], [], []
                for k, value in zip(chunks[a:b], part.column(4 + text).cast(pa.binary())):
                    if k != now:
                        often, now = set(), k
                    lines = (value.as_py() or b"").split(b"\n")
                    stay = [x for x in lines if xxhash.xxh3_128_digest(line_key(x)) not in often] if often else lines
                    out.append(b"\n".join(stay))
                    total.append(len(lines))
                    gone.append(len(lines) - len(stay))
                columns = [part.column(4 + i) for i in range(len(kept))]
                columns[text] = pa.array(out, pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], kinds.names)

    return both.mapInArrow(run, kinds)


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH l AS (
  SELECT doc_id, line, place, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
often AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (FROM often)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (k NOT IN (FROM often)), '')) AS kept_sha256
FROM l GROUP BY doc_id
"""
