"""The first lines of files, without the rest of them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmeter.functions.scalar import basename, sanitize_project

#: Bytes that are read at once; a line of more takes more reads.
CHUNK = 1 << 16


def first_line(file: BinaryIO, skip_blank: bool = False) -> bytes | None:
    """The first line (that is not blank); None where there is none. No more is read than it takes."""
    held = b""
    while True:
        more = file.read(CHUNK)
        held += more
        *lines, held = held.split(b"\n")
        for line in lines:
            if line.strip() or not skip_blank:
                return line
        if not more:
            return held if held.strip() or (held and not skip_blank) else None


def listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """source_path, mtime, size of the files below root whose path ends as in glob; none is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob.rsplit("/", 1)[-1]).load(f"{root.rstrip('/')}/{glob}")
    return found.select(F.col("_metadata.file_path").alias("source_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def heads(found: DataFrame, skip_blank: bool = False, tasks: int = 64) -> DataFrame:
    """found (with source_path) and head: the first line of each file, read in `tasks` tasks. A file that cannot be opened has none.

    Files are opened by their own file system, of those that pyarrow knows.
    """
    names = [*found.columns, "head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for path in batch.column("source_path").to_pylist():
                try:
                    files, own = pyarrow.fs.FileSystem.from_uri(path)
                    with files.open_input_stream(own, buffer_size=0) as file:
                        lines.append(first_line(file, skip_blank))
                except FileNotFoundError:
                    lines.append(None)
            text = pa.array([None if x is None else x.decode("utf-8", "replace") for x in lines], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names)

    return found.repartition(tasks, "source_path").mapInArrow(run, found.schema.add("head", "string"))


def discover_codex(spark: SparkSession, root: str, tasks: int = 64) -> DataFrame:
    """source_path, project, mtime, size of sessions/YYYY/MM/DD/rollout-*.jsonl whose first line is a session_meta of codex."""
    kind = "type string, payload struct<originator:string,cwd:string>"
    rows = heads(listed(spark, root, "sessions/*/*/*/rollout-*.jsonl"), tasks=tasks).withColumn("e", F.from_json("head", kind))
    rows = rows.filter((F.col("e.type") == "session_meta") & F.lower("e.payload.originator").startswith("codex"))
    return rows.select("source_path", sanitize_project(F.coalesce("e.payload.cwd", F.lit(""))).alias("project"), "mtime", "size")


def discover_pi(spark: SparkSession, root: str, tasks: int = 64) -> DataFrame:
    """source_path, project, mtime, size of */*.jsonl whose first line that is not blank is a session."""
    rows = heads(listed(spark, root, "*/*.jsonl"), skip_blank=True, tasks=tasks).withColumn("e", F.from_json("head", "type string, cwd string"))
    folder = F.regexp_extract("source_path", "([^/]+)/[^/]+$", 1)
    return rows.filter("e.type = 'session'").select("source_path", basename(F.coalesce("e.cwd", folder)).alias("project"), "mtime", "size")
