"""Exact duplicates by deterministic block naming.

A text without its white space is cut into blocks of a fixed number of characters. Distinct blocks are sorted and
numbered; the numbers replace the blocks. Then adjacent pairs of numbers are numbered in the same way, again and
again, until one number is left for each document. Texts with equal numbers (and equally many blocks) are equal,
other texts are not: no number stands for two strings.

A 64-bit hash only serves to send short keys instead of blocks to the join that brings the numbers back. That the
hash is unique among the distinct blocks is counted in the same plan; where it is not, the join is run on the blocks.

Skew: blocks and pairs are made distinct before the shuffle (a copy costs one row a task), and the joins are equi-joins
that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmeter.llm.common import columns, cut, row_ids

#: What is deleted before texts are compared.
WHITE = r"[\x20\x09-\x0D]+"
#: Characters in a block. Most documents have one or two blocks of this size.
BLOCK_CHARS = 4096


def _pieces(docs: DataFrame, block_chars: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    # numbered before the blocks are dealt out to rows, since all blocks of a row must share the number
    rid = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    norm = docs.select("doc_id", rid.alias("rid"), F.char_length(text).alias("n_chars"), F.regexp_replace(text, WHITE, "").alias("norm"))
    n = F.greatest(F.lit(1), F.ceil(F.char_length("norm") / block_chars).cast("int"))
    return norm.withColumn("n_blocks", n)


def _blocks(block_chars: int) -> Column:
    """The text in blocks, in one pass over it; an empty text is one block."""
    return F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))


def _numbered(keys: DataFrame, cols: list[str]) -> DataFrame:
    """A number for each distinct row: its place in the sorted partition that its hash sends it to."""
    return keys.distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame, block_chars: int, key: Column, exact: bool) -> DataFrame:
    pieces = _pieces(docs, block_chars)
    keyed = pieces.select(F.explode(_blocks(block_chars)).alias("block")).select(key.alias("h"), "block")
    names = _numbered(keyed, ["h", "block"])
    rows = pieces.select(
        "rid", "doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"),
        F.col("n_blocks").alias("left"), F.posexplode(_blocks(block_chars)).alias("pos", "block"),
    )
    rows = rows.withColumn("h", key)
    if exact:
        named = rows.join(names.withColumn("sharing", F.lit(1).cast("long")), ["h", "block"])
    else:
        by_hash = names.groupBy("h").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("sharing"))
        named = rows.drop("block").join(by_hash, "h")
    return named.select("rid", "doc_id", "n_chars", "text_sha256", "left", "pos", "name", "sharing")


def name_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS, key: Column | None = None) -> DataFrame:
    """rid, doc_id, n_chars, text_sha256, level, name: (level, name) is the same for equal texts only.

    key: expression over the column `block` that the join uses in place of the block; any, also a poor one, is right.
    rid is the column _row of docs where there is one.
    """
    key = F.xxhash64("block") if key is None else key
    now = cut(_first_names(docs, block_chars, key, exact=False))
    if not now.filter("sharing > 1").isEmpty():
        now = cut(_first_names(docs, block_chars, key, exact=True))
    most = now.agg(F.max("left")).first()[0] or 1
    attrs = ["rid", "doc_id", "n_chars", "text_sha256"]
    level, done = 0, []
    while True:
        done.append(now.filter("left = 1").select(*attrs, F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        pair = F.floor(F.col("pos") / 2).cast("int").alias("pos")
        pairs = now.filter("left > 1").groupBy(*attrs, "left", pair).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        names = _numbered(pairs.select("a", "b"), ["a", "b"])
        half = F.ceil(F.col("left") / 2).cast("int").alias("left")
        now = cut(pairs.join(names, ["a", "b"]).select(*attrs, half, "pos", "name"))
        most, level = (most + 1) // 2, level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, key: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Of equal texts the row with the most code points stays, then the smallest doc_id (null last); of rows that are
    repeated whole, one. A null text is empty; empty texts are equal. Other columns are ignored; no rows give no rows.
    """
    return _decided(name_documents(docs.select("doc_id", "text"), block_chars, key)).drop("rid")


def _decided(named: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("n_chars")).alias("size"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("best")
    groups = named.groupBy("level", "name").agg(best, F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256", "rid"
    )


def keep_one(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that stay, with all columns: one of each text, also where texts share a doc_id or have none."""
    rows, row = row_ids(docs)
    kept = _decided(name_documents(rows.select(F.col(row).alias("_row"), "doc_id", "text"), block_chars)).filter("kept").select(F.col("rid").alias(row))
    return rows.join(kept, row, "left_semi").select(*columns(docs))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
