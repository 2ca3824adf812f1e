"""Exports, stored rollups and reloading of changed sources."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmeter.functions.scalar import cost_header, csv_safe, currency_symbol
from callmeter.operators import reports
from callmeter.sources import store

#: Labels of the exported periods. What is called all projects is the 30 days' set.
EXPORT_PERIODS = {"Today": "today", "7 Days": "week", "30 Days": "30days"}


def export_summary(calls: DataFrame, as_of: dt.date) -> DataFrame:
    """period, cost_usd, calls, sessions of the exported periods, from one pass over the calls of the longest."""
    bounds = F.array(*[F.struct(F.lit(label).alias("period"), F.lit(a).alias("a"), F.lit(b).alias("b")) for label, name in EXPORT_PERIODS.items() for a, b in [reports.period(name, as_of)]])
    per = calls.groupBy("source_path", "session_id", "day").agg(F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("calls"))
    per = per.select("*", F.explode(F.filter(bounds, lambda x: F.col("day").between(x["a"], x["b"]))).alias("p"))
    per = per.groupBy("p.period", "source_path", "session_id").agg(F.sum("cost_usd").alias("cost_usd"), F.sum("calls").alias("calls"))
    found = per.groupBy("period").agg(F.sum("cost_usd").alias("cost_usd"), F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("sessions"))
    labels = calls.sparkSession.createDataFrame([(x,) for x in EXPORT_PERIODS], "period string")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("cost_usd", "calls", "sessions")}
    return labels.join(found, "period", "left").withColumns(zero)


def export_csv(calls: DataFrame, as_of: dt.date, path: str, code: str = "USD", rate: float = 1.0) -> None:
    """Directories summary, daily (by period) and projects (30 days) of CSV files, values made safe for spreadsheets."""
    money = F.round(F.col("cost_usd").cast("double") * rate, 2).alias(cost_header(code))
    daily = None
    for label, name in EXPORT_PERIODS.items():
        own = reports.by_day(reports.in_days(calls, *reports.period(name, as_of))).withColumn("period", F.lit(label))
        daily = own if daily is None else daily.unionByName(own)
    projects = reports.by_project(reports.in_days(calls, *reports.period("30days", as_of)))
    sections = {
        "summary": export_summary(calls, as_of).select("period", money, "calls", "sessions"),
        "daily": daily.orderBy("period", "day").select("period", "day", money, "calls", *reports.TOKENS),
        "projects": projects.orderBy(F.desc("cost_usd"), "project").select("project", money, "calls", "sessions"),
    }
    for name, df in sections.items():
        text = [csv_safe(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]
        line = F.concat_ws(",", *[F.coalesce(x, F.lit("")) for x in text])
        head = df.sparkSession.createDataFrame([(",".join(df.columns),)], "value string")
        head.coalesce(1).write.text(f"{path}/{name}/header")
        df.select(line.alias("value")).write.text(f"{path}/{name}/rows")


def export_json(calls: DataFrame, as_of: dt.date, generated: str, path: str) -> None:
    """One JSON document in files: generated, periods by label, all projects of 30 days by falling cost; values are strings.

    Folders header, projects (sorted over all its files, one project a line) and footer hold it in parts that as many
    tasks write as the projects take; `manifest` lists the files in their order, with their bytes. The document is what
    they hold one after the other.
    """
    spark = calls.sparkSession
    text = lambda c: F.col(c).cast("string").alias(c)
    summary = F.struct(F.struct(text("cost_usd"), text("calls"), text("sessions")).alias("summary"))
    periods = export_summary(calls, as_of).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("period", summary)))).alias("p"))
    head = F.concat(F.lit(f'{{"generated":{json.dumps(generated)},"periods":'), "p", F.lit(',"projects":['))
    periods.select(head.alias("value")).coalesce(1).write.text(f"{path}/header")
    projects = reports.by_project(reports.in_days(calls, *reports.period("30days", as_of))).orderBy(F.desc("cost_usd"), "project")
    first = projects.first()
    comma = F.when(F.col("project").eqNullSafe(F.lit(first["project"] if first else None)), "").otherwise(",")
    line = F.to_json(F.struct(text("project"), text("cost_usd"), text("calls"), text("sessions")))
    projects.select(F.concat(comma, line).alias("value")).write.text(f"{path}/projects")
    spark.range(1).select(F.lit("]}").alias("value")).coalesce(1).write.text(f"{path}/footer")
    files = [(i, f"{part}/{name}", size) for i, (part, name, size) in enumerate((p, n, z) for p in ("header", "projects", "footer") for n, z in store.sizes(spark, f"{path}/{p}"))]
    spark.createDataFrame(files, "place int, file string, bytes long").coalesce(1).write.json(f"{path}/manifest")


def status_json(calls: DataFrame, as_of: dt.date, code: str = "USD", rate: float = 1.0) -> DataFrame:
    """One row: currency, today and month, each with cost (to cents) and calls."""
    s = reports.status(calls, as_of)
    own = lambda n: F.struct(F.round(F.col(f"{n}_cost").cast("double") * rate, 2).alias("cost"), F.col(f"{n}_calls").alias("calls")).alias(n)
    return s.select(F.to_json(F.struct(F.lit(code).alias("currency"), own("today"), own("month"))).alias("value"), currency_symbol(F.lit(code)).alias("symbol"))


_CALL = f"provider string, call_key string, source_path string, line_no long, session_id string, day string, live boolean, cost_usd decimal(28,12), {', '.join(f'{c} long' for c in reports.TOKENS)}"
_LEDGER = "source_path string, mtime timestamp, size long, part string, part_sources long"
_DAILY = f"source_path string, session_id string, cost_usd decimal(38,12), calls long, {', '.join(f'{c} long' for c in reports.TOKENS)}, day string"
_SUMS = ["cost_usd", "calls", *reports.TOKENS]
#: Parts that calls are stored in, at most; the smallest of more are put together with that of the next load.
PARTS = 16


def _commits(spark: SparkSession, path: str) -> list[str]:
    """Names of the loads that were completed, the last one at the end."""
    return [x for x in store.names(spark, f"{path}/commits") if "DONE" in store.names(spark, f"{path}/commits/{x}")]


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """source_path, mtime, size, part, part_sources: the sources of the last load that was completed, those without calls too."""
    done = _commits(spark, path)
    return spark.read.schema(_LEDGER).parquet(f"{path}/commits/{done[-1]}/ledger") if done else spark.createDataFrame([], _LEDGER)


def load_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The rollup of the last load that was completed: source_path, session_id, day, cost_usd, calls, tokens. A filter on day reads only those folders."""
    done = _commits(spark, path)
    return spark.read.schema(_DAILY).parquet(f"{path}/commits/{done[-1]}/usage_daily") if done else spark.createDataFrame([], _DAILY)


def _as_stored(calls: DataFrame) -> DataFrame:
    keyed = F.coalesce("dedup_key", F.lit("")) != ""
    key = F.when(keyed, F.concat(F.lit("k"), "dedup_key")).otherwise(F.concat_ws(":", F.lit("n"), "source_path", F.col("line_no").cast("string")))
    own = {"call_key": key, "day": F.when(F.length("ts_raw") >= 10, F.col("day")), "live": F.col("live") if "live" in calls.columns else F.lit(True)}
    return calls.select(*[own.get(c, F.col(c)).cast(k).alias(c) for c, k in (x.split(" ", 1) for x in _CALL.split(", "))])


def _stored(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """The stored calls of the sources of a ledger. The names of its parts, PARTS and one at most, reach the driver."""
    parts = [r[0] for r in ledger.select("part").distinct().collect()]
    if not parts:
        return spark.createDataFrame([], _CALL)
    rows = spark.read.option("basePath", f"{path}/parts").schema(f"{_CALL}, part string").parquet(*[f"{path}/parts/part={p}" for p in parts])
    return rows.join(ledger.select("source_path", "part"), ["source_path", "part"], "left_semi").drop("part")


def _first_days(rows: DataFrame) -> DataFrame:
    """What the rollup gains and loses: rows of the first call of each key, less those of the first call that it had.

    rows: calls, with had (whether the rollup knows them) and has (whether they count from now on).
    """
    sums, place = F.struct("source_path", "session_id", "day", "live", "cost_usd", *reports.TOKENS), F.struct("source_path", "line_no")
    first = rows.groupBy("provider", "call_key").agg(F.min_by(sums, F.when(F.col("had"), place)).alias("b"), F.min_by(sums, F.when(F.col("has"), place)).alias("a"))
    signed = F.array(F.struct(F.lit(-1).alias("sign"), F.col("b").alias("c")), F.struct(F.lit(1).alias("sign"), F.col("a").alias("c")))
    first = first.filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.explode(signed).alias("s")).select("s.sign", "s.c.*").filter("live AND day IS NOT NULL")
    sign = F.col("sign")
    return first.select("source_path", "session_id", (sign * F.col("cost_usd")).cast("decimal(38,12)").alias("cost_usd"), sign.cast("long").alias("calls"), *[(sign * F.col(c)).alias(c) for c in reports.TOKENS], "day")


def _to_move(same: DataFrame) -> list[str]:
    """Parts whose sources move to the new part: those that are mostly dead, and the smallest of too many."""
    parts = sorted(same.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("part_sources").alias("of")).collect(), key=lambda r: (r["n"], r["part"]))
    dead = [r["part"] for r in parts if 2 * r["n"] < r["of"]]
    rest = [r["part"] for r in parts if r["part"] not in dead]
    return dead + (rest[: len(rest) - PARTS // 2] if len(rest) > PARTS else [])


def save_sessions(found: DataFrame, parse: Callable[[DataFrame], DataFrame], path: str) -> bool:
    """Brings a store to the sources of `found` (source_path, mtime, size); whether there was anything to do.

    Stored are the calls of each source by itself, narrow, in a few parts; the rollup of the first call of each key over
    all sources; and the ledger of sources with their part. A load parses the changed sources alone. It finds the keys
    that they, or the sources that are gone or were rewritten, have or had, and takes from the rollup what their first
    calls were and adds what they are now, so that any number of loads gives what one whole load gives. Both are found in
    one pass over the calls of these keys. A day's rollup is written in as few files as its size takes, not one a task.

    A load is a folder of its own until its last step, one empty file, which makes it count: one that is killed at any
    step leaves the one before. Then what neither this nor the load before needs is removed. One load runs at a time.
    """
    spark = found.sparkSession
    done = _commits(spark, path)
    name = f"{int(done[-1].split('-')[0]) + 1 if done else 1:08d}-{uuid.uuid4().hex}"
    at, part = f"{path}/commits/{name}", name
    found.select("source_path", F.col("mtime").cast("timestamp"), F.col("size").cast("long")).dropDuplicates(["source_path"]).write.parquet(f"{at}/found")
    found, key = spark.read.parquet(f"{at}/found"), ["source_path", "mtime", "size"]
    ledger = load_ledger(spark, path)
    same, stale, changed = ledger.join(found, key, "left_semi"), ledger.join(found, key, "left_anti"), found.join(ledger, key, "left_anti")
    if done and stale.isEmpty() and changed.isEmpty():
        store.remove(spark, at)
        return False

    moved = same.filter(F.col("part").isin(_to_move(same)))
    _as_stored(parse(changed)).write.parquet(f"{path}/parts/part={part}")
    new = spark.read.schema(_CALL).parquet(f"{path}/parts/part={part}")
    old = _stored(spark, path, ledger).join(stale.select("source_path", F.lit(True).alias("gone")), "source_path", "left")
    touched = new.select("provider", "call_key").union(_stored(spark, path, stale).select("provider", "call_key")).distinct()
    before = old.join(touched, ["provider", "call_key"], "left_semi").withColumns({"had": F.lit(True), "has": F.col("gone").isNull()}).drop("gone")
    both = load_sessions(spark, path).unionByName(_first_days(before.unionByName(new.withColumns({"had": F.lit(False), "has": F.lit(True)}))))
    daily = both.groupBy("source_path", "session_id", "day").agg(*[F.sum(c).cast("decimal(38,12)" if c == "cost_usd" else "long").alias(c) for c in _SUMS]).filter("calls <> 0")
    daily.hint("rebalance", "day").write.partitionBy("day").parquet(f"{at}/usage_daily")

    _stored(spark, path, moved).write.mode("append").parquet(f"{path}/parts/part={part}")
    own = changed.unionByName(moved.select(*key))
    own = own.select(*key, F.lit(part).alias("part"), F.lit(own.count()).cast("long").alias("part_sources"))
    same.join(moved.select("source_path"), "source_path", "left_anti").unionByName(own).write.parquet(f"{at}/ledger")
    store.mark(spark, f"{at}/DONE")
    _clean(spark, path)
    return True


def _clean(spark: SparkSession, path: str) -> None:
    kept = _commits(spark, path)[-2:]
    parts = {r[0] for x in kept for r in spark.read.schema(_LEDGER).parquet(f"{path}/commits/{x}/ledger").select("part").distinct().collect()}
    for x in store.names(spark, f"{path}/commits"):
        if x not in kept:
            store.remove(spark, f"{path}/commits/{x}")
    for x in store.names(spark, f"{path}/parts"):
        if x.removeprefix("part=") not in parts:
            store.remove(spark, f"{path}/parts/{x}")


def incremental_load(found: DataFrame, parse: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """The rollup of the sources that are found now, from a store at `path` that is brought up to date: see save_sessions().

    parse: from changed sources (source_path, mtime, size) to the priced calls, with day, of each source by itself: a key
    once a source, but also where another source has it. A row whose column live is false takes its key and counts for
    nothing. Sources that are no longer found drop out; where nothing has changed, nothing is parsed or written.
    """
    save_sessions(found, parse, path)
    return load_sessions(found.sparkSession, path)
