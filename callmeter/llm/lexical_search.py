"""Ranked lexical search, term at a time with a limited number of accumulators.

One pass over the documents keeps the frequencies of the items' terms; their document counts, and the number and length
of the documents, are sums over all of it. Tasks then rank a block of documents at a time for each item: terms come
rarest first, and a document gets an accumulator at its first one. As soon as the largest scores that the terms left can
add stay below the k-th partial score, a document without an accumulator cannot be among the best, and no more are made;
those that are there are updated to their exact scores. The k-th score of a task's earlier blocks bounds the later ones.
The best k of the tasks are ranked in two steps, so that no task gets those of all tasks.

The items are a stated query set: their terms are read in blocks of a bounded number of bytes, each against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callmeter.llm.common import written

#: Bytes of different terms of the items that are searched at once.
BLOCK_BYTES = 4 << 20
#: Postings that a task ranks at once.
POSTINGS = 1 << 20
#: Percent of a document's length that counts, and the saturation of a frequency.
LENGTH, SATURATION = 50, 20
#: ASCII other than letters and digits parts terms; A-Z is lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LAST = np.iinfo(np.int64).max


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _texts(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    return (terms(x.as_py()) for x in batch.column("text").cast(pa.binary()))


def _item_terms(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([sorted(set(x)) for x in _texts(batch)], pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<binary>")


def _postings(docs: DataFrame, number) -> DataFrame:
    """doc_id, n (terms), and terms (their numbers) and counts of those that number, a broadcast map, has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = number.value
        wanted = of.keys()
        for batch in batches:
            n, ids, counts = [], [], []
            for found in _texts(batch):
                times = Counter(found)
                own = times.keys() & wanted
                n.append(len(found))
                ids.append([of[t] for t in own])
                counts.append([times[t] for t in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def best(score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by document."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        places = np.flatnonzero(score >= kth)
    else:
        places = np.arange(len(score))
    return places[np.lexsort((doc[places], -score[places]))][:k]


def accumulate(slices: list[tuple[np.ndarray, np.ndarray]], tops: list[int], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents with an accumulator, their exact scores, and how many postings found none.

    slices: documents and what they get of each term, rarest term first; tops: the largest of each. floor: a score that
    k documents elsewhere reach. A document that is left out scores below the k-th of those returned, or below floor.
    """
    left = np.concatenate([np.cumsum(tops[::-1])[::-1], [0]])
    score, made = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool)
    making, passed = left[0] >= floor, 0
    for i, (docs, gets) in enumerate(slices):
        if not making:
            has = made[docs]
            passed += len(docs) - int(has.sum())
            docs, gets = docs[has], gets[has]
        score[docs] += gets
        if making:
            made[docs] = True
            if left[i + 1] < floor:
                making = False
            elif i + 1 < len(slices):
                now = score[made]
                making = len(now) < k or left[i + 1] >= np.partition(now, len(now) - k)[len(now) - k]
    docs = np.flatnonzero(made)
    return docs, score[docs], passed


def _ranked(postings: DataFrame, items: list[tuple[int, list[int]]], weights: np.ndarray, rarity: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """key, doc_id, score: the best k documents of each item and task. items: key and term numbers."""
    shared = postings.sparkSession.sparkContext.broadcast(([(key, sorted(t, key=lambda x: (rarity[x], x))) for key, t in items], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        held: dict[int, np.ndarray] = {}  # of an item: scores, documents

        def rank(block: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(block)
            ids, n = np.asarray(table.column("doc_id").fill_null(_LAST), np.int64), np.asarray(table.column("n"), np.int64)
            lists = table.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
            term, tf = np.asarray(lists.flatten()), np.asarray(table.column("counts").combine_chunks().flatten())
            m = 100 - LENGTH + (LENGTH * n * n_docs) // length
            gets = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + SATURATION * m[doc]))
            order = np.argsort(term, kind="stable")
            term, doc, gets = term[order], doc[order], gets[order]
            at = np.searchsorted(term, np.arange(len(weights) + 1))
            full = np.flatnonzero(at[1:] > at[:-1])
            top = np.zeros(len(weights), np.int64)
            if len(full):
                top[full] = np.maximum.reduceat(gets, at[full])
            for key, own in queries:
                own = [t for t in own if at[t] < at[t + 1]]
                before = held.get(key, np.zeros((2, 0), np.int64))
                floor = int(before[0].min()) if before.shape[1] >= k else 1
                if own:
                    docs, score, _ = accumulate([(doc[at[t] : at[t + 1]], gets[at[t] : at[t + 1]]) for t in own], [int(top[t]) for t in own], len(ids), k, floor)
                    both = np.concatenate([before, np.stack([score, ids[docs]])[:, score >= floor]], axis=1)
                    held[key] = both[:, best(both[0], both[1], k)]

        block, size = [], 0
        for batch in batches:
            step = max(1, batch.num_rows * POSTINGS // max(1, len(batch.column("terms").flatten())))
            for a in range(0, batch.num_rows, step):
                block.append(batch.slice(a, step))
                size += len(block[-1].column("terms").flatten())
                if size >= POSTINGS:
                    rank(block)
                    block, size = [], 0
        if block:
            rank(block)
        for key, (score, doc) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), key)), pa.array(doc, mask=doc == _LAST), pa.array(score)], ["key", "doc_id", "score"])

    return postings.filter(F.size("terms") > 0).mapInArrow(run, "key long, doc_id long, score long")


def _first(rows: DataFrame, k: int, *keys) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) for each item (item_id, text), scores above 0.

    Terms are what ASCII other than letters and digits parts, A-Z lower-cased. Equal scores go by doc_id, null last; a
    null id is returned as null. Null and empty texts have no terms. Each row is a document or an item, also a repeated
    one. No documents or no items give no rows; other columns are ignored. doc_id must cast to long. The terms of a block
    of items, and their document counts, reach the driver: BLOCK_BYTES, or one item's.
    """
    queries = written(_item_terms(items).withColumn("key", F.monotonically_increasing_id()), "items")
    size = queries.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 8))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    parts = []
    for b in range(blocks):
        own = [(r["key"], [bytes(t) for t in r["terms"]]) for r in queries.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()]
        number = {t: i for i, t in enumerate(sorted({t for _, x in own for t in x}))}
        postings = written(_postings(docs, docs.sparkSession.sparkContext.broadcast(number)), "postings")
        n_docs, length = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        rarity = np.zeros(len(number), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            rarity[r["t"]] = r["count"]
        weights = np.array([weight(n_docs, df) for df in rarity.tolist()], np.int64)
        parts.append(_ranked(postings, [(key, [number[t] for t in x]) for key, x in own], weights, rarity, n_docs, length, k))
    found = _first(reduce(DataFrame.unionByName, parts), k, "key", F.pmod(F.xxhash64("doc_id"), F.lit(64))).drop("rank")
    return _first(found, k, "key").join(queries.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 50
"""
