"""Calls derived from the `events` table: every event but a view is a model call, a view is a user's prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callmeter.functions.scalar import shell_commands
from callmeter.operators.ordered import dedup_calls
from callmeter.operators.pricing import fallback_prices, price_table, small_table, with_cost
from callmeter.operators.reports import with_day

#: Invented prices: model: input, output, cache write, cache read, multiplier of the fast mode.
PRICES = {
    "model-a": ("0.000005", "0.000025", "0.00000625", "0.0000005", 6),
    "model-a-mini": ("0.0000004", "0.0000016", "0.0000004", "0.0000002", 1),
    "model-b": ("0.000003", "0.000015", "0.00000375", "0.0000003", 1),
}
MODELS = ["model-a", "model-a-mini", "model-b-20250101", "model-b@20250101", "model-b-beta", "unknown-model"]
PROVIDERS = ["claude", "codex", "opencode", "pi", "copilot"]
TOOLS = ["Edit", "Edit,Bash", "Bash", "Read,Grep", "Bash,Read", "mcp__github__search", "WebSearch", "", "TodoWrite", "Skill", "EnterPlanMode", "Agent"]
COMMANDS = ["cd /x && npm test", "git log | head -5", "FOO=1 /usr/bin/env node", 'echo "a && b"; ls', "true"]
MESSAGES = ["fix the bug in auth", "add a login page", "refactor the parser", "npm test", "git push to main", "npm run build", "what if we change it", "explain this", "hello there", "see main.py", "https://example.org", "prefix_it", "brew install jq"]


def _pick(values: list[str], n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls, repeated keys included, without price and day."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts, user = F.col("ts").cast("timestamp"), F.col("user_id")
    ev = ev.select(
        "event_id", "user_id", "event_type", ts.alias("ts"), F.floor(F.col("value") * 100).cast("long").alias("c"), F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.concat(F.lit("s"), user.cast("string"), F.lit("-"), F.floor((F.dayofmonth(ts) - 1) / 10).cast("string")).alias("session_id"),
    )
    # a session is one user's: both windows share the exchange by user
    own, by_user = Window.partitionBy("user_id", "session_id").orderBy("event_id"), Window.partitionBy("user_id").orderBy("event_id")
    ev = ev.withColumn("prev", F.lag("event_id").over(by_user)).withColumn("user_event", F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(own))
    k, e = F.col("k"), F.col("event_id")
    tools = F.filter(F.split(_pick(TOOLS, k % 12), ","), lambda t: t != "")
    command = F.when((k % 12).isin(1, 2, 4), _pick(COMMANDS, k % 5)).otherwise("")
    zero = F.lit(0).cast("long")
    return ev.filter("event_type <> 'view'").select(
        _pick(PROVIDERS, user % 5).alias("provider"), F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl")).alias("source_path"), e.alias("line_no"),
        F.concat(F.lit("home-dev-proj"), (user % 12).cast("string")).alias("project"), "session_id", _pick(MODELS, e % 6).alias("model"),
        F.col("c").alias("input_tokens"), (k * 10).alias("output_tokens"), (k * 7).alias("cache_write_tokens"), (k * 37 % 1000).alias("cache_read_tokens"),
        zero.alias("cached_input_tokens"), zero.alias("reasoning_tokens"), F.when(k % 11 == 0, 1).otherwise(0).cast("long").alias("web_search_requests"),
        F.when(k % 13 == 0, "fast").otherwise("standard").alias("speed"), tools.alias("tools"), shell_commands(command).alias("bash_commands"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts_raw"), "ts",
        F.concat(F.lit("m"), F.when(e % 20 == 19, F.coalesce("prev", e)).otherwise(e).cast("string")).alias("dedup_key"),
        _pick(MESSAGES, F.coalesce("user_event", F.lit(0)) % 13).alias("user_message"), F.coalesce(F.col("user_event").cast("string"), F.lit("")).alias("user_ts"), k.alias("k"), "user_event",
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated, priced calls with day."""
    models = small_table(spark, [(m,) for m in MODELS], "model string")
    return with_day(with_cost(dedup_calls(raw_calls(spark, sf_dir)), price_table(spark, PRICES), fallback_prices(spark), models))


def _case(values: list[str], n: str) -> str:
    return f"CASE {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: The same for DuckDB: f (all calls), p (prices, in 1e-8 dollars), c (deduplicated, with cost in 1e-8 dollars and day).
CTES = f"""
WITH ev AS (
  SELECT event_id, user_id, event_type, ts, CAST(floor(value * 100) AS BIGINT) AS c, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
         concat('s', user_id, '-', CAST(floor((day(ts) - 1) / 10) AS BIGINT)) AS session_id FROM events),
marked AS (
  SELECT *, MAX(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY session_id ORDER BY event_id) AS user_event,
         LAG(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM ev),
f AS (
  SELECT {_case(PROVIDERS, 'user_id % 5')} AS provider, concat('/logs/', session_id, '.jsonl') AS source_path, event_id AS line_no,
    concat('home-dev-proj', user_id % 12) AS project, session_id, {_case(MODELS, 'event_id % 6')} AS model,
    c AS input_tokens, k * 10 AS output_tokens, k * 7 AS cache_write_tokens, (k * 37) % 1000 AS cache_read_tokens,
    CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS web_search_requests, CASE WHEN k % 13 = 0 THEN 'fast' ELSE 'standard' END AS speed,
    [x FOR x IN string_split({_case(TOOLS, 'k % 12')}, ',') IF x <> ''] AS tools,
    CASE WHEN k % 12 NOT IN (1, 2, 4) THEN [] WHEN k % 5 = 0 THEN ['npm'] WHEN k % 5 = 1 THEN ['git', 'head'] WHEN k % 5 = 2 THEN ['env'] WHEN k % 5 = 3 THEN ['echo', 'ls'] ELSE [] END AS bash_commands,
    ts, concat('m', CASE WHEN event_id % 20 = 19 THEN COALESCE(prev, event_id) ELSE event_id END) AS dedup_key,
    {_case(MESSAGES, 'COALESCE(user_event, 0) % 13')} AS user_message, COALESCE(CAST(user_event AS VARCHAR), '') AS user_ts, k, user_event
  FROM marked WHERE event_type <> 'view'),
p(key, i, o, cw, cr, fast) AS (VALUES ('model-a', 500, 2500, 625, 50, 6), ('model-a-mini', 40, 160, 40, 20, 1), ('model-b', 300, 1500, 375, 30, 1)),
named AS (SELECT DISTINCT model, regexp_replace(split_part(model, '@', 1), '-[0-9]{{8}}$', '') AS name FROM f),
priced AS (
  SELECT model, name, key, i, o, cw, cr, fast FROM (
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN name = key THEN 1 ELSE 4 END, length(key) DESC, key) AS n
    FROM named JOIN p ON starts_with(name, key) OR starts_with(key, name)) WHERE n = 1),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, dedup_key ORDER BY source_path, line_no) AS n FROM f) WHERE n = 1),
c AS (
  SELECT u.* EXCLUDE (n), COALESCE(name, u.model) AS model_name, strftime(ts, '%Y-%m-%d') AS day,
    COALESCE(CASE WHEN speed = 'fast' THEN fast ELSE 1 END * (input_tokens * i + output_tokens * o + cache_write_tokens * cw + cache_read_tokens * cr + web_search_requests * 1000000), 0) AS e8
  FROM u LEFT JOIN priced USING (model))
"""
