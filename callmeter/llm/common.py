"""What the operators of this subpackage share: inputs, the shared folder, splits of the rows."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="callmeter-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared folder; what computed them is not run again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As cut(), but as a Parquet table: for columns of bytes or text, which a checkpoint stores uncompressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/callmeter/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df needs to be taken for it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def mapped(docs: DataFrame, run: Callable[[Iterator[list]], Iterator[list]], results: dict[str, str], together: int) -> DataFrame:
    """docs with more columns, results (name: kind), made in Arrow batches of `together` rows at most.

    run: from lists of texts (null stays null) to lists of arrays, one for each result. Columns of docs that have the
    name of a result are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in {r.lower() for r in results}]
    text = docs.columns.index("text")
    places = [docs.columns.index(c) for c in kept]
    names = [*kept, *results]

    def batches(whole: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def texts() -> Iterator[list]:
            for batch in whole:
                for k in range(0, batch.num_rows, together):
                    parts.append(batch.slice(k, together))
                    yield parts[-1].column(text).to_pylist()

        for arrays in run(texts()):
            own = parts.pop()
            yield pa.RecordBatch.from_arrays([*(own.column(k) for k in places), *map(pa.array, arrays)], names)

    kinds = StructType([docs.schema[k] for k in places])
    for name, kind in results.items():
        kinds = kinds.add(name, kind)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with dots are not found there
    return plain.mapInArrow(batches, kinds)


def give_back() -> None:
    """Gives memory that this process has freed back to the system: a Python worker stays after its stage, beside the JVM of the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def is_scan(df: DataFrame) -> bool:
    """Whether df is a scan of Parquet files, whose partitions and rows are the same whenever it is read."""
    analyzed = df._jdf.queryExecution().analyzed()
    return analyzed.getClass().getSimpleName() == "LogicalRelation" and "parquet" in analyzed.simpleString(25).lower()


def row_ids(df: DataFrame) -> tuple[DataFrame, str]:
    """df with one column more, and its name: a number of its own for each row, the same whenever the frame is read.

    Of a scan of Parquet files it is the file's number and the row's place in the file; only the files' names reach the
    driver. Other frames are written first.
    """
    row, file, at, number = free(df, "_row", "_file", "_at", "_number")
    if not is_scan(df) or "_metadata" in {c.lower() for c in df.columns}:
        return written(df.withColumn(row, F.monotonically_increasing_id()), "rows"), row
    rows = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    names = sorted(r[0] for r in rows.select(file).distinct().collect())
    files = df.sparkSession.createDataFrame(list(enumerate(names)), f"{number} long, {file} string")
    return rows.join(F.broadcast(files), file).select(*columns(df), (F.shiftleft(number, 40) + F.col(at)).alias(row)), row


def remainder(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; 0 (held out) for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % F.lit(mod), F.lit(0))
