"""Aggregates over priced calls (with day) and turns. Money stays decimal; callers cast at the end."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmeter.functions.scalar import cache_hit_pct, local_day, mcp_server, mcp_tools, one_shot_pct, short_model
from callmeter.operators.ordered import first_last_ts

TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]


def _cost() -> Column:
    return F.sum("cost_usd").alias("cost_usd")


def _calls() -> Column:
    return F.count(F.lit(1)).alias("calls")


def with_day(calls: DataFrame) -> DataFrame:
    return calls.withColumn("day", local_day(F.col("ts_raw")))


def period(name: str, as_of: dt.date) -> tuple[str, str]:
    """First and last local day of today, week (8 days), 30days, month or all."""
    start = {"today": as_of, "week": as_of - dt.timedelta(7), "30days": as_of - dt.timedelta(29), "month": as_of.replace(day=1), "all": dt.date(1, 1, 1)}[name]
    return start.isoformat(), as_of.isoformat()


def period_utc(name: str, as_of: dt.date, zone: str = "UTC") -> tuple[str, str]:
    """First and last second of a period of local days, as the first 19 characters of UTC timestamps."""
    a, b = (dt.datetime.fromisoformat(f"{d}T{t}").replace(tzinfo=ZoneInfo(zone)).astimezone(dt.timezone.utc) for d, t in zip(period(name, as_of), ("00:00:00", "23:59:59"), strict=True))
    return a.isoformat()[:19], b.isoformat()[:19]


def in_days(calls: DataFrame, start: str, end: str) -> DataFrame:
    return calls.filter(F.col("day").between(start, end))


def in_instants(calls: DataFrame, start: str, end: str) -> DataFrame:
    """By the first 19 characters in UTC; rows with a shorter timestamp always stay."""
    return calls.filter((F.length("ts_raw") < 19) | F.substring("ts_raw", 1, 19).between(start, end))


def sessions(calls: DataFrame) -> DataFrame:
    low, high = first_last_ts(F.col("ts_raw"))
    return calls.groupBy("source_path", "session_id", "project").agg(_cost(), _calls(), *[F.sum(c).alias(c) for c in TOKENS], low.alias("first_ts"), high.alias("last_ts"))


def session_days(calls: DataFrame) -> DataFrame:
    return calls.filter(F.length("ts_raw") >= 10).groupBy("source_path", "session_id", "day").agg(_cost(), _calls(), *[F.sum(c).alias(c) for c in TOKENS])


def by_model(calls: DataFrame) -> DataFrame:
    more = ["cached_input_tokens", "reasoning_tokens", "web_search_requests"]
    rows = calls.groupBy(short_model(F.col("model")).alias("model_name")).agg(_cost(), _calls(), *[F.sum(c).alias(c) for c in TOKENS + [c for c in more if c in calls.columns]])
    return rows.withColumn("cache_hit_pct", cache_hit_pct(F.col("cache_read_tokens"), F.col("input_tokens"), F.col("cache_write_tokens")))


def by_tool(calls: DataFrame) -> DataFrame:
    return calls.select(F.explode("tools").alias("tool")).filter(~F.col("tool").startswith("mcp__") & ~F.col("tool").startswith("lang:")).groupBy("tool").agg(_calls())


def by_mcp_server(calls: DataFrame) -> DataFrame:
    return calls.select(F.explode(F.transform(mcp_tools(F.col("tools")), mcp_server)).alias("server")).groupBy("server").agg(_calls())


def by_shell(calls: DataFrame) -> DataFrame:
    return calls.select(F.explode("bash_commands").alias("command")).groupBy("command").agg(_calls())


def by_category(turns: DataFrame) -> DataFrame:
    edit = F.col("has_edits")
    rows = turns.groupBy("category").agg(
        F.count(F.lit(1)).alias("turns"), _cost(), F.count_if(edit).alias("edit_turns"), F.sum(F.when(edit, F.col("retries")).otherwise(0)).cast("long").alias("retries"),
        F.count_if(edit & (F.col("retries") == 0)).alias("one_shot"),
    )
    return rows.withColumn("one_shot_pct", one_shot_pct(F.col("one_shot"), F.col("edit_turns")))


def by_project(calls: DataFrame) -> DataFrame:
    """sessions counts (source, session) pairs, distinct_sessions the ids."""
    per = calls.groupBy("project", "source_path", "session_id").agg(F.sum("cost_usd").alias("c"), F.count(F.lit(1)).alias("n"))
    rows = per.groupBy("project").agg(F.sum("c").alias("cost_usd"), F.sum("n").alias("calls"), F.count(F.lit(1)).alias("sessions"), F.count_distinct("session_id").alias("distinct_sessions"))
    return rows.withColumn("avg_session_cost", F.col("cost_usd").cast("double") / F.col("sessions"))


def by_day(calls: DataFrame) -> DataFrame:
    return calls.groupBy("day").agg(_cost(), _calls(), *[F.sum(c).alias(c) for c in TOKENS])


def overview(calls: DataFrame) -> DataFrame:
    per = calls.groupBy("source_path", "session_id").agg(F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in TOKENS])
    rows = per.agg(F.sum("cost_usd").alias("cost_usd"), F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("sessions"), *[F.sum(c).alias(c) for c in TOKENS])
    return rows.withColumn("cache_hit_pct", cache_hit_pct(F.col("cache_read_tokens"), F.col("input_tokens"), F.col("cache_write_tokens")))


def status(calls: DataFrame, as_of: dt.date) -> DataFrame:
    """Cost and calls of today, the week and the month, in one pass."""
    out = []
    for name in ("today", "week", "month"):
        own = F.col("day").between(*period(name, as_of))
        out += [F.coalesce(F.sum(F.when(own, F.col("cost_usd"))), F.lit(0)).alias(f"{name}_cost"), F.count_if(own).alias(f"{name}_calls")]
    return calls.agg(*out)


def status_utc(calls: DataFrame, as_of: dt.date, zone: str = "UTC") -> DataFrame:
    """As status(), by UTC timestamps alone: no day is needed. Timestamps of fewer than 19 characters are in no period."""
    at, out = F.substring("ts_raw", 1, 19), []
    for name in ("today", "week", "month"):
        own = (F.length("ts_raw") >= 19) & at.between(*period_utc(name, as_of, zone))
        out += [F.coalesce(F.sum(F.when(own, F.col("cost_usd"))), F.lit(0)).alias(f"{name}_cost"), F.count_if(own).alias(f"{name}_calls")]
    return calls.agg(*out)


def file_day_costs(calls: DataFrame) -> DataFrame:
    return calls.groupBy("source_path", F.substring("ts_raw", 1, 10).alias("utc_day")).agg(_cost(), _calls())


def seconds(calls: DataFrame) -> DataFrame:
    """The stored rollup: cost and calls of each second of a session."""
    return calls.groupBy("session_id", F.date_trunc("second", "ts").alias("second")).agg(_cost(), _calls())


def merge(*rollups: DataFrame) -> DataFrame:
    """One rollup of several with the same keys: cost_usd and calls are added."""
    both = rollups[0]
    for x in rollups[1:]:
        both = both.unionByName(x)
    keys = [c for c in both.columns if c not in ("cost_usd", "calls", *TOKENS)]
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in both.columns if c not in keys])


def calendar(daily: DataFrame, as_of: dt.date, days: int = 31) -> DataFrame:
    """The last `days` days up to as_of, 0 where nothing happened; empty days at the start are cut off."""
    axis = daily.sparkSession.range(1).select(F.explode(F.sequence(F.lit(as_of) - F.expr(f"INTERVAL {days - 1} DAY"), F.lit(as_of))).alias("d"))
    own = daily.filter(F.col("day").between((as_of - dt.timedelta(days - 1)).isoformat(), as_of.isoformat()))
    start = own.filter("calls > 0").agg(F.min("day").alias("start"))
    rows = axis.select(F.date_format("d", "yyyy-MM-dd").alias("day")).join(own.select("day", "cost_usd", "calls"), "day", "left").join(F.broadcast(start), F.col("day") >= F.col("start"))
    return rows.select("day", F.coalesce("cost_usd", F.lit(0)).alias("cost_usd"), F.coalesce("calls", F.lit(0)).alias("calls"))


def top(rows: DataFrame, by: str, name: str, n: int) -> DataFrame:
    return rows.orderBy(F.col(by).desc(), F.col(name)).limit(n)


def provider_presence(sources: DataFrame) -> DataFrame:
    return sources.groupBy("provider").agg(F.count_distinct("source_path").alias("sources"))
