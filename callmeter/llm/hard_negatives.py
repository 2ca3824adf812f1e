"""Hard negatives of anchors by slot-decomposed selection.

A positive of an anchor admits the negatives of a window of scores that ends at the positive's upper limit. The upper
limits of all positives of an anchor cut the scores into disjoint slots, so that a window is what lies above its lower
limit in a run of slots: from the slot of its upper limit downwards. Tasks keep the best k of each slot, the same are
kept of all tasks together, and one walk down the slots of an anchor answers all of its windows, also those that overlap.

Rows and anchors are packed in blocks of a bounded number of components. Each block of anchors (the stated query set)
meets each block of rows once for the positives and once for the slots; what leaves a task is k rows a slot and anchor.
No row is grouped by its label, so that a label or a vector that a third of the rows share costs nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callmeter.llm.common import written

#: Components in a block (4 MB) and scores that are looked at together (32 MB).
BLOCK, SCORES = 1 << 19, 1 << 22
#: Anchors that are dealt to one task to be packed, and results that a task holds before it passes them on.
ANCHORS, HELD = 256, 1 << 20
_NONE = np.iinfo(np.int64).min
_PACKED = "ids binary, labels binary, vectors binary, n int"


def _whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that take part, and their vectors of integers; short vectors end in zeros."""
    column = batch.column("embedding")
    at = np.asarray(column.offsets, np.int64)
    flat = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (odd[at[1:]] == odd[at[:-1]]) & ~np.asarray(column.is_null())
    for name in ("vec_id", "label"):
        good &= ~np.asarray(batch.column(name).is_null())
    places, size = np.flatnonzero(good), at[1:] - at[:-1]
    vectors = np.zeros((len(places), int(size[places].max(initial=0))))
    for row, place in zip(vectors, places, strict=True):
        row[: size[place]] = flat[at[place] : at[place + 1]]
    return places, np.floor(256 * vectors)


def _pack(rows: DataFrame, lists: str = "") -> DataFrame:
    """Blocks of the rows that take part. lists: the name of a column of 64-bit integers that goes with anchors, as many in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, vectors = _whole(batch)
            step = max(1, BLOCK // max(1, vectors.shape[1]))
            for k in range(0, len(places), step):
                own = pa.array(places[k : k + step])
                out = {
                    "ids": np.asarray(batch.column("vec_id").take(own), np.int64), "labels": np.asarray(batch.column("label").take(own), np.int64), "vectors": vectors[k : k + step],
                }
                if lists:
                    out["more"] = np.asarray(batch.column(lists).take(own).flatten(), np.int64)
                yield pa.RecordBatch.from_pydict({c: pa.array([v.tobytes()], pa.binary()) for c, v in out.items()} | {"n": pa.array([len(own)], pa.int32())})

    more = [lists] if lists else []
    kinds = _PACKED.replace(", n int", ", more binary, n int") if lists else _PACKED
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", *more).mapInArrow(run, kinds)


def _unpack(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = row[prefix + "n"]
    return np.frombuffer(row[prefix + "ids"], np.int64), np.frombuffer(row[prefix + "labels"], np.int64), np.frombuffer(row[prefix + "vectors"], np.float64).reshape(n, len(row[prefix + "vectors"]) // (8 * n))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of vectors of integers, which are given and, where all fit, returned as doubles."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2.0**53:
        return a @ b.T
    if most >= 2.0**63:
        raise ArithmeticError("a score can exceed 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(found: np.ndarray, k: int) -> np.ndarray:
    """Of columns anchor, slot, score, id: the first k of each anchor and slot by falling score, then by id."""
    found = found[:, np.lexsort((found[3], -found[2], found[1], found[0]))]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[:2, 1:] != found[:2, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    place = np.arange(found.shape[1]) - np.repeat(starts, np.diff([*starts, found.shape[1]]))
    return found[:, place < k]


def _met(rows: tuple, anchors: tuple, more: np.ndarray, floor: np.ndarray, slots: bool) -> Iterator[np.ndarray]:
    """Columns anchor (its place in the block), slot, score, id of what can be among the best, a part of the scores at a time."""
    (ids, labels, vectors), (own_ids, own_labels, own_vectors) = rows, anchors
    step = max(1, SCORES // max(1, len(ids)))
    for k in range(0, len(own_ids), step):
        part = slice(k, k + step)
        scores = inner(vectors, own_vectors[part])
        same = labels[:, None] == own_labels[part]
        if slots:
            fit = ~same & (scores >= more[part, 1]) & (scores <= more[part, 2])
        else:
            fit = same & (ids[:, None] != own_ids[part]) & (scores >= floor[part])
        r, a = np.nonzero(fit)
        score = scores[r, a].astype(np.int64)
        a = a + k
        slot = (more[a, 2:] >= score[:, None]).sum(axis=1) - 1 if slots else np.zeros_like(a)
        yield np.stack([a, slot, score, ids[r]])


def _select(rows: DataFrame, anchors: DataFrame, k: int, slots: bool) -> DataFrame:
    """key, slot, score, id: the best k of each anchor and slot, of all rows. anchors: blocks whose `more` holds key, or key, lower limit and upper limits.

    Crosses blocks, never rows: a block of anchors against all rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        sizes: dict[bytes, int] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for more, found in held.items():
                keys = np.frombuffer(more, np.int64).reshape(sizes[more], -1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[found[0]], found[1], found[2], found[3])], ["key", "slot", "score", "id"])
            held.clear(), sizes.clear()

        for batch in batches:
            for one in range(batch.num_rows):
                row = batch.slice(one, 1).to_pylist()[0]
                block, own = _unpack(row), _unpack(row, "a_")
                at = row["a_more"]
                sizes[at] = row["a_n"]
                more = np.frombuffer(at, np.int64).reshape(row["a_n"], -1)
                now = held.get(at, np.zeros((4, 0), np.int64))
                floor = np.full(row["a_n"], _NONE)
                full = np.bincount(now[0], minlength=row["a_n"]) >= k
                np.minimum.at(least := np.full(row["a_n"], np.iinfo(np.int64).max), now[0], now[2])
                floor[full] = least[full]
                for found in _met(block, own, more, floor, slots):
                    now = best(np.concatenate([now, found], axis=1), k)
                held[at] = now
                if sum(x.shape[1] for x in held.values()) > HELD:
                    yield from passed_on()
        yield from passed_on()

    pairs = rows.crossJoin(anchors.toDF(*(f"a_{c}" for c in anchors.columns)))
    found = pairs.mapInArrow(run, "key long, slot long, score long, id long")
    w = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows and anchors (vec_id, label, embedding).

    A component x counts as floor(256*x); scores are integer inner products, a missing component is 0. An anchor's
    positives are its best rows of the same label and another id; a positive's negatives are its best rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score, low < high. Equal scores go by id.

    Rows (and anchors) with a null id, label, vector or component, or one that is not finite, take no part. Rows that are
    repeated count as often as they are there, and so do anchors. No rows or no anchors give no rows. Other columns are
    ignored. Ids and labels must cast to long; a score that could exceed 64 bits is an error.
    """
    queries = written(anchors.select("vec_id", "label", "embedding").withColumn("key", F.monotonically_increasing_id()), "anchors")
    tasks = -(-queries.count() // ANCHORS) or 1
    blocks = written(_pack(rows), "vectors")
    first = _pack(queries.withColumn("more", F.array("key")).repartition(tasks), "more")
    chosen = written(_select(blocks, first, positives, slots=False).select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")

    least, most = f"positive_score * {low}", f"positive_score * {high}"
    lower, upper = F.expr(f"({least} + pmod(-{least}, 100)) div 100"), F.expr(f"({most} - pmod({most}, 100)) div 100")
    limits = chosen.withColumns({"lower": lower, "upper": upper}).filter("lower <= upper")
    limits = limits.groupBy("key").agg(F.min("lower").alias("lower"), F.reverse(F.array_sort(F.collect_list("upper"))).alias("uppers"))
    filled = F.concat("uppers", F.array_repeat(F.lit(int(_NONE)).cast("long"), positives - F.size("uppers")))
    second = queries.join(limits, "key").withColumn("more", F.concat(F.array("key", "lower"), filled)).repartition(tasks)
    slots = _select(blocks, _pack(second, "more"), negatives, slots=True)

    down = slots.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("fall"), "id"))).alias("down"))
    fits = F.filter("down", lambda x: (F.lit(low) * F.col("positive_score") <= -100 * x["fall"]) & (-100 * x["fall"] <= F.lit(high) * F.col("positive_score")))
    out = queries.select("key", F.col("vec_id").cast("long").alias("anchor_id")).join(chosen.drop("rank"), "key").join(down, "key")
    out = out.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(fits, 1, negatives)).alias("place", "n"))
    return out.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.fall")).alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.filter(F.col("vec_id") % 100 == 0))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
"""
