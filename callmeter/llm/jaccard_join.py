"""Near duplicates by a chosen-path join on sets of word shingles.

Documents with one set of shingles are a class; one of them stands for it. A run splits the representatives on sampled
tokens of their sets (the coordinates of a MinHash embedding, so that two sets share a coordinate with a probability
equal to their Jaccard similarity). Buckets of more than `SMALL` sets are split again on further sampled tokens, down to
`DEPTH`; small ones, and what is still large then, are compared by brute force. Runs with fresh samples are repeated
until a pair at the threshold is missed with a probability below 1 - `RECALL`.

A set's number is that of one of the rows that have it, so that shared and missing doc_ids and repeated rows do no harm.

Pairs are never rows. A bucket is compared inside its task, which returns, for each member, how many links it found,
and the edges of a spanning forest of them. A pair is counted in the first of the buckets that hold both of its sets,
which a task can tell from the list of buckets that travels with each set. Buckets with the same members as an earlier
one are left out first. A bucket too large for a task is laid out as pairs of blocks of it. Similarities are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.llm.common import columns, cut, row_ids

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Sets in a bucket that is not split further, and how often a bucket is split.
SMALL, DEPTH = 64, 3
#: Sets of a block of a bucket too large for one task, and shingles of them on the average.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22
#: Texts that a worker has in its hands at a time.
TOGETHER = 128
#: Coordinates of the embedding.
COORDINATES = 128
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


class Shingler:
    """Texts to sorted arrays of 64-bit hashes of their shingles; words in lower case, between white space.

    A text of fewer words than a shingle has, but one at least, has one shingle of all its words; one without words none.
    """

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > 100_000:
            self.known = {}
        known = self.known
        for w in words:
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        h = np.array([known[w] for w in words], np.uint64)
        n = max(1, len(h) - SHINGLE_WORDS + 1)
        out = np.full(n, len(h) if len(h) < SHINGLE_WORDS else SHINGLE_WORDS, np.uint64)
        for k in range(min(SHINGLE_WORDS, len(h))):
            out = _mixed(out * _M2 + h[k : k + n])
        return np.unique(out)


_SEEDS = _mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _M1)


def embedding(shingles: np.ndarray, of: list[int] | None = None) -> np.ndarray:
    """For each coordinate the shingle that its hash function puts first."""
    seeds = _SEEDS if of is None else _SEEDS[of]
    return np.array([shingles[_mixed(shingles ^ s).argmin()] if len(shingles) else 0 for s in seeds], np.uint64)


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold, if it is split `depth` times in each, is found with that probability.

    A split samples each of two coordinates and more as plan() deals them: the pair stays together with 1 - (1 - t) ** 2.
    """
    together = (1 - (1 - threshold) ** 2) ** depth
    return math.ceil(math.log(1 - recall) / math.log(1 - together))


def plan(run: int, level: int) -> list[int]:
    """The two coordinates that a run samples at a level (0 to DEPTH - 1); no two runs share one at the first level."""
    if level == 0:
        return [2 * run, 2 * run + 1]
    pick = np.random.default_rng([run, level]).permutation(COORDINATES)
    return [int(x) for x in pick if x not in (2 * run, 2 * run + 1)][2 * level : 2 * level + 2]


def _classes(rows: DataFrame) -> DataFrame:
    """row, doc_id, sig (128 bits that name the set of shingles; null without words), paths, n_shingles of row, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in (x.slice(k, TOGETHER) for x in batches for k in range(0, x.num_rows, TOGETHER)):
            sigs, firsts, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingler(text)
                sizes.append(len(s))
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                firsts.append(embedding(s, WANTED).astype(np.int64).tolist() if len(s) else None)
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "sig": pa.array(sigs, pa.binary()), "paths": pa.array(firsts, pa.list_(pa.int64())), "n_shingles": pa.array(sizes, pa.int64()),
            })

    return rows.mapInArrow(run, "row long, doc_id long, sig binary, paths array<long>, n_shingles long")


RUNS = runs_needed()
#: The coordinates that some run samples at some level, in order; the others are not computed.
WANTED = sorted({c for r in range(RUNS) for level in range(DEPTH) for c in plan(r, level)})


def _buckets(reps: DataFrame) -> DataFrame:
    """rep, n_shingles, bucket: which sets meet where. reps: rep, n_shingles, paths (their values at WANTED)."""

    def chosen(level: int, run):
        """Of a run's two coordinates at a level: hashes of the coordinate and the set's value there."""
        at = F.lit([[WANTED.index(c) for c in plan(r, level)] for r in range(RUNS)])
        return F.transform(at[run], lambda c: F.xxhash64(c, F.get(F.col("paths"), c)))

    rows = reps.select("rep", "n_shingles", "paths", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run"))
    rows = rows.select("rep", "n_shingles", "paths", "run", F.explode(chosen(0, F.col("run"))).alias("key"))
    rows = rows.select("rep", "n_shingles", "paths", "run", F.xxhash64("run", "key").alias("bucket"))
    out = []
    for level in range(DEPTH):
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        met = cut(rows.join(sizes, "bucket"))
        last = level == DEPTH - 1
        out.append(met.filter(F.lit(True) if last else F.col("n") <= SMALL).select("rep", "n_shingles", "bucket"))
        if last or met.filter(F.col("n") > SMALL).isEmpty():
            break
        deeper = met.filter(F.col("n") > SMALL).select("rep", "n_shingles", "paths", "run", "bucket", F.explode(chosen(level + 1, F.col("run"))).alias("key"))
        rows = deeper.select("rep", "n_shingles", "paths", "run", F.xxhash64("bucket", "key").alias("bucket"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def _different(members: DataFrame) -> DataFrame:
    """rep, bucket, blocks without the buckets whose members are those of another bucket (told by count and two sums of hashes).

    blocks: into how many a bucket too large for one task is laid out; 1: none.
    """
    sums = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rep") % (1 << 40)).alias("a"), F.sum(F.hash("rep").cast("long") * 31 + F.xxhash64(F.lit(7), "rep") % (1 << 40)).alias("b"),
        F.sum("n_shingles").alias("s"),
    )
    first = sums.filter("n > 1").groupBy("n", "a", "b").agg(F.min("bucket").alias("bucket"), F.min("s").alias("s"))
    blocks = F.when((F.col("n") > 4 * BLOCK) | (F.col("s") > 4 * BLOCK_SHINGLES), F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES))).otherwise(1)
    return members.join(first.select("bucket", blocks.cast("int").alias("blocks")), "bucket")


COMPARED = "rep long, other long, links long"


class Holders:
    """Which of some lists of numbers hold the numbers of one of them."""

    def __init__(self, lists: list[np.ndarray]):
        self.size = np.array([len(x) for x in lists], np.int64)
        self.ends = np.cumsum(self.size)
        _, of = np.unique(np.concatenate(lists), return_inverse=True)
        self.of = of.astype(np.int32)
        self.by = np.bincount(self.of)
        self.start = np.cumsum(self.by) - self.by
        self.holders = np.repeat(np.arange(len(lists), dtype=np.int32), self.size)[np.argsort(self.of, kind="stable")]
        self.mine = np.zeros(len(self.by), bool)

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many numbers each of the others (places in ascending order) shares with list i.

        Either the holders of the numbers of list i are counted, or the numbers of the others are looked up, whichever is less.
        """
        mine = self.of[self.ends[i] - self.size[i] : self.ends[i]]
        n = self.by[mine]
        if n.sum() <= self.size[others].sum():
            met = self.holders[np.repeat(self.start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            return np.bincount(met, minlength=len(self.size))[others]
        self.mine[mine] = True
        n = self.size[others]
        if len(others) == len(self.size):
            hit = self.mine[self.of]
        else:
            hit = self.mine[self.of[np.repeat(self.ends[others] - np.cumsum(n), n) + np.arange(n.sum())]]
        self.mine[mine] = False
        sums = np.concatenate([[0], np.cumsum(hit)])
        ends = np.cumsum(n)
        return sums[ends] - sums[ends - n]


def _links(sets: list[np.ndarray], lists: list[np.ndarray], bucket: int, split: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """A place in a bucket and the places it is linked with, by pairs that meet in no earlier bucket.

    split: the pairs between the first `split` sets and the others; 0: all pairs. Pairs that have met are ruled out first.
    """
    tokens, earlier = Holders(sets), Holders([x[x < bucket] for x in lists])
    size, every = tokens.size, np.arange(len(sets))
    for i in range(split or len(sets)):
        j = every[split or i + 1 :]
        j = j[(size[j] >= threshold * size[i] - 1e-9) & (size[i] >= threshold * size[j] - 1e-9)]
        if len(j):
            j = j[earlier.shared(i, j) == 0]
        if len(j):
            both = tokens.shared(i, j)
            j = j[both >= threshold * (size[i] + size[j] - both) - 1e-9]
        if len(j):
            yield i, j


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Of a bucket (or a pair of blocks of it): links of each member, and a spanning forest of them."""
    table = table.sort_by([("block", "ascending"), ("rep", "ascending")])
    reps = table.column("rep").to_numpy()
    bucket, split = table.column("bucket")[0].as_py(), 0
    block = table.column("block").to_numpy()
    if block[0] != block[-1]:
        split = int(np.searchsorted(block, block[0], side="right"))
    elif table.column("pair")[0].as_py():
        split = len(reps)  # a pair of blocks of which one is missing here
    sets = [np.frombuffer(x, np.uint64) for x in table.column("data").to_pylist()]
    lists = [np.unique(np.array(x, np.int64)) for x in table.column("buckets").to_pylist()]
    links, label = np.zeros(len(reps), np.int64), np.arange(len(reps))
    edges: list[tuple[int, int]] = []
    if split < len(reps):
        for i, j in _links(sets, lists, bucket, split, threshold):
            links[i] += len(j)
            links[j] += 1
            for c, at in zip(*np.unique(label[j], return_index=True), strict=True):
                if c != label[i]:
                    label[label == c] = label[i]
                    edges.append((i, int(j[at])))
    own = np.flatnonzero(links)
    rep = np.concatenate([reps[own], reps[[a for a, _ in edges]] if edges else np.zeros(0, np.int64)])
    other = pa.array([None] * len(own) + [int(reps[b]) for _, b in edges], pa.int64())
    return pa.table({"rep": pa.array(rep, pa.int64()), "other": other, "links": pa.array(np.concatenate([links[own], np.zeros(len(edges), np.int64)]), pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for the nodes of edges (a, b).

    Each round points every node at the smallest node it has met (first the neighbours of a node, larger ones, then all
    of them): the depth of a component halves. Nothing but the number of changes reaches the driver.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    total = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("low").alias("b")))
        now = cut(small.distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state == total:
            break
        total = state
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _near(rows: DataFrame, threshold: float) -> DataFrame:
    """row, doc_id, root, class_id, rep_id, n_links, n_copies of row (long, unique), doc_id (long), text. root: the class as a number."""
    found = cut(_classes(rows.select("row", "doc_id", "text")))
    sets = found.filter("sig IS NOT NULL").groupBy("sig").agg(
        F.min("row").alias("rep"), F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n_copies"), F.any_value("paths").alias("paths"), F.max("n_shingles").alias("n_shingles")
    )
    members = cut(_different(_buckets(sets.select("rep", "n_shingles", "paths"))))
    lists = members.groupBy("rep").agg(F.collect_list("bucket").alias("buckets"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in (x.slice(k, TOGETHER) for x in batches for k in range(0, x.num_rows, TOGETHER)):
            data = [shingler(x).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"rep": batch.column("rep"), "buckets": batch.column("buckets"), "data": pa.array(data, pa.binary())})

    texts = rows.select(F.col("row").alias("rep"), "text").join(lists, "rep")
    laid = texts.mapInArrow(to_sets, "rep long, buckets array<long>, data binary").select("rep", "buckets", "data", F.explode("buckets").alias("bucket"))
    large = members.filter("blocks > 1").select("bucket", "blocks").distinct()
    laid = laid.join(F.broadcast(large) if large.count() <= 10_000 else large, "bucket", "left")
    block = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, block).alias("x"), F.greatest(x, block).alias("y")))
    laid = laid.select("rep", "buckets", "data", "bucket", F.coalesce(block, F.lit(0)).alias("block"), F.explode_outer(pairs).alias("pair"))
    laid = laid.withColumn("x", F.coalesce("pair.x", F.lit(-1))).withColumn("y", F.coalesce("pair.y", F.lit(-1))).withColumn("pair", F.col("x") != F.col("y"))
    compared = cut(laid.groupBy("bucket", "x", "y").applyInArrow(lambda t: _compare(t, threshold), COMPARED))
    links = compared.filter("other IS NULL").groupBy("rep").agg(F.sum("links").alias("n_links"))
    roots = components(compared.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    linked = cut(sets.select("rep", "rep_id").join(roots, "rep"))
    least = linked.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    linked = linked.join(least, "root").select("rep", "root", "class_id")
    own = sets.select("sig", "rep", "rep_id", "n_copies").join(links, "rep", "left").join(linked, "rep", "left")
    own = own.select("sig", "rep_id", "n_copies", "n_links", F.coalesce("root", "rep").alias("root"), F.when(F.col("root").isNull(), F.col("rep_id")).otherwise(F.col("class_id")).alias("class_id"))
    out, none = found.select("row", "doc_id", "sig").join(own, "sig", "left"), F.col("sig").isNull()
    return out.select(
        "row", "doc_id", F.when(none, F.col("row")).otherwise(F.col("root")).alias("root"), F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(none, F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """docs with the number of each row, the same as row, doc_id (long), text, and the number's name in the first."""
    rows, row = row_ids(docs)
    return rows, rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), row


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, rep_id, n_links, n_copies for each row of docs.

    class_id: the smallest doc_id of the documents that links connect it with (its own if none); rep_id: the smallest
    doc_id with the same set of shingles, n_copies: how many rows have it; n_links: other sets linked with its set, at a
    Jaccard similarity of at least the threshold. Documents without words are linked with nothing: a class of their own.
    Null ids: class_id is null where all rows of a class have none. Repeated rows are copies of each other; rows that
    share a doc_id are documents of their own. Other columns of docs are ignored.
    """
    return _near(_numbered(docs)[1], threshold).drop("row", "root")


def keep_representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all columns: that with the smallest doc_id (null last), of several the first row.

    Rows are compared as rows, so texts that share a doc_id or have none are documents of their own."""
    rows, own, row = _numbered(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    kept = _near(own, threshold).groupBy("root").agg(first).select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*columns(docs))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
