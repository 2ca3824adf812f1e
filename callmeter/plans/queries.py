"""The registered queries of the reference's operators, each with its SQL over the same tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callmeter.functions import fixed, scalar
from callmeter.operators import classify, incremental, ordered, pricing, reports
from callmeter.plans.fixture import CTES, PRICES, calls, raw_calls

AS_OF = dt.date(2024, 1, 30)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, ctes: str = CTES) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ctes + sql
        return f

    return add


def out(df: DataFrame) -> DataFrame:
    """Money as double, for the comparison with SQL."""
    return df.withColumns({c: F.col(c).cast("double") for c, k in df.dtypes if k.startswith("decimal")})


_COST = "CAST(COALESCE(SUM(e8), 0) AS DOUBLE) / 1e8 AS cost_usd, COUNT(*) AS calls"
_TOKENS = ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in reports.TOKENS)
_HIT = "COALESCE(SUM(cache_read_tokens) * 100.0::DOUBLE / NULLIF(SUM(input_tokens) + SUM(cache_read_tokens) + SUM(cache_write_tokens), 0), 0.0) AS cache_hit_pct"


@query(f" SELECT {_COST}, (SELECT COUNT(*) FROM (SELECT DISTINCT source_path, session_id FROM c)) AS sessions, {_TOKENS}, {_HIT} FROM c")
def overview_totals(spark, sf_dir):
    return out(reports.overview(calls(spark, sf_dir)))


@query(f" SELECT day, {_COST}, {_TOKENS} FROM c GROUP BY day ORDER BY day")
def daily_usage(spark, sf_dir):
    return out(reports.by_day(calls(spark, sf_dir)).orderBy("day"))


@query(""", d AS (SELECT day, SUM(e8) AS e, COUNT(*) AS n FROM c WHERE day BETWEEN '2023-12-31' AND '2024-01-30' GROUP BY day),
axis AS (SELECT strftime(x, '%Y-%m-%d') AS day FROM generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) t(x))
SELECT axis.day, CAST(COALESCE(e, 0) AS DOUBLE) / 1e8 AS cost_usd, COALESCE(n, 0) AS calls FROM axis LEFT JOIN d USING (day) WHERE axis.day >= (SELECT MIN(day) FROM d)""")
def daily_calendar(spark, sf_dir):
    return out(reports.calendar(reports.by_day(calls(spark, sf_dir)), AS_OF))


@query(f" SELECT model_name, {_COST}, {_TOKENS}, 0::BIGINT AS cached_input_tokens, 0::BIGINT AS reasoning_tokens, CAST(SUM(web_search_requests) AS BIGINT) AS web_search_requests, {_HIT} FROM (SELECT * REPLACE (regexp_replace(split_part(model, '@', 1), '-[0-9]{{8}}$', '') AS model_name) FROM c) GROUP BY model_name")
def model_breakdown(spark, sf_dir):
    return out(reports.by_model(calls(spark, sf_dir)))


@query(f" SELECT model, {_HIT} FROM c GROUP BY model")
def model_cache_hit(spark, sf_dir):
    rows = calls(spark, sf_dir).groupBy("model").agg(*[F.sum(c).alias(c) for c in reports.TOKENS])
    return rows.select("model", scalar.cache_hit_pct(F.col("cache_read_tokens"), F.col("input_tokens"), F.col("cache_write_tokens")).alias("cache_hit_pct"))


_PROJECT = f"SELECT project, {_COST}, COUNT(DISTINCT (source_path, session_id)) AS sessions, COUNT(DISTINCT session_id) AS distinct_sessions, CAST(SUM(e8) AS DOUBLE) / 1e8 / COUNT(DISTINCT (source_path, session_id)) AS avg_session_cost FROM c GROUP BY project"


@query(f" {_PROJECT} ORDER BY cost_usd DESC, project LIMIT 8")
def project_top(spark, sf_dir):
    return out(reports.top(reports.by_project(calls(spark, sf_dir)), "cost_usd", "project", 8))


@query(f", x AS ({_PROJECT}) SELECT project, replace(project, '-', '/') AS path, 'dev/' || project AS short, avg_session_cost FROM x".replace("'dev/' || project", "'home/dev/' || replace(project, 'home-dev-', '')"))
def project_avg_session(spark, sf_dir):
    rows = out(reports.by_project(calls(spark, sf_dir)))
    path = scalar.project_path(F.col("project"))
    return rows.select("project", path.alias("path"), scalar.short_project(path).alias("short"), "avg_session_cost")


@query(f" SELECT source_path, session_id, project, {_COST}, {_TOKENS}, strftime(MIN(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS first_ts, strftime(MAX(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS last_ts FROM c GROUP BY source_path, session_id, project")
def session_summary(spark, sf_dir):
    return out(reports.sessions(calls(spark, sf_dir)))


@query(f" SELECT source_path, session_id, day, {_COST}, {_TOKENS} FROM c GROUP BY source_path, session_id, day")
def session_daily(spark, sf_dir):
    return out(reports.session_days(calls(spark, sf_dir)))


@query(" SELECT tool, COUNT(*) AS calls FROM (SELECT unnest(tools) AS tool FROM c) WHERE NOT starts_with(tool, 'mcp__') GROUP BY tool ORDER BY calls DESC, tool LIMIT 10")
def tool_top(spark, sf_dir):
    return reports.top(reports.by_tool(calls(spark, sf_dir)), "calls", "tool", 10)


@query(" SELECT split_part(tool, '__', 2) AS server, COUNT(*) AS calls FROM (SELECT unnest(tools) AS tool FROM c) WHERE starts_with(tool, 'mcp__') GROUP BY server ORDER BY calls DESC, server LIMIT 10")
def mcp_top(spark, sf_dir):
    return reports.top(reports.by_mcp_server(calls(spark, sf_dir)), "calls", "server", 10)


@query(" SELECT command, COUNT(*) AS calls FROM (SELECT unnest(bash_commands) AS command FROM c) GROUP BY command ORDER BY calls DESC, command LIMIT 10")
def shell_top(spark, sf_dir):
    return reports.top(reports.by_shell(calls(spark, sf_dir)), "calls", "command", 10)


def _sql_kw(group: str) -> str:
    return "regexp_matches(user_message, '(?i)(?:^|[^A-Za-z0-9_])(?:" + "|".join(fixed.KEYWORDS[group]) + ")(?:$|[^A-Za-z0-9_])')"


def _sql_any(names: list[str]) -> str:
    return "list_has_any(tools, [" + ", ".join(f"'{n}'" for n in names) + "])"


_TALK = (
    f"CASE WHEN {_sql_kw('brainstorm')} THEN 'Brainstorming' WHEN {_sql_kw('research')} THEN 'Exploration' WHEN {_sql_kw('debug')} THEN 'Debugging' WHEN {_sql_kw('feature')} THEN 'Feature Dev' "
    f"WHEN regexp_matches(user_message, '(?i){fixed.FILE_PATTERN}') OR regexp_matches(user_message, '(?i){fixed.SCRIPT_PATTERN}') THEN 'Coding' WHEN regexp_matches(user_message, '(?i){fixed.URL_PATTERN}') THEN 'Exploration' ELSE 'Conversation' END"
)
_CODING = f"CASE WHEN {_sql_kw('debug')} THEN 'Debugging' WHEN {_sql_kw('refactor')} THEN 'Refactoring' WHEN {_sql_kw('feature')} THEN 'Feature Dev' ELSE 'Coding' END"
_EXPLORING = f"CASE WHEN {_sql_kw('research')} THEN 'Exploration' WHEN {_sql_kw('debug')} THEN 'Debugging' ELSE 'Exploration' END"
_SHELL, _EDIT, _READ = _sql_any(fixed.SHELL_TOOLS), _sql_any(fixed.EDIT_TOOLS), _sql_any(fixed.READ_TOOLS)
TURNS = f""", s AS (
  SELECT *, CASE WHEN user_ts = '' OR LAG(user_ts) OVER w IS DISTINCT FROM user_ts THEN 1 ELSE 0 END AS brk FROM c WINDOW w AS (PARTITION BY source_path, session_id ORDER BY ts, line_no)),
n AS (SELECT *, CAST(SUM(brk) OVER (PARTITION BY source_path, session_id ORDER BY ts, line_no) AS BIGINT) AS turn_no FROM s),
pos AS (SELECT *, {_EDIT} AS is_edit, {_SHELL} AS is_shell, row_number() OVER (PARTITION BY source_path, session_id, turn_no ORDER BY ts, line_no) AS q FROM n),
r AS (SELECT *, is_edit AND COALESCE(MAX(CASE WHEN is_shell THEN q END) OVER b >= MAX(CASE WHEN is_edit THEN q END) OVER b, false) AS is_retry
  FROM pos WINDOW b AS (PARTITION BY source_path, session_id, turn_no ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source_path, session_id, project, turn_no, arg_min(user_message, q) AS user_message, arg_min(day, q) AS day, COUNT(*) AS n_calls, flatten(list(tools ORDER BY q)) AS tools,
  SUM(e8) AS e8, CAST(COUNT(*) FILTER (is_retry) AS INTEGER) AS retries, bool_or(is_edit) AS has_edits FROM r GROUP BY source_path, session_id, project, turn_no),
t AS (SELECT *, CASE WHEN len(tools) = 0 THEN {_TALK} WHEN list_contains(tools, 'EnterPlanMode') THEN 'Planning' WHEN list_contains(tools, 'Agent') THEN 'Delegation'
  WHEN {_SHELL} AND NOT {_EDIT} AND {_sql_kw('test')} THEN 'Testing' WHEN {_SHELL} AND NOT {_EDIT} AND {_sql_kw('git')} THEN 'Git Ops'
  WHEN {_SHELL} AND NOT {_EDIT} AND ({_sql_kw('build')} OR {_sql_kw('install')}) THEN 'Build/Deploy'
  WHEN {_EDIT} THEN {_CODING} WHEN {_SHELL} AND {_READ} THEN {_EXPLORING} WHEN {_SHELL} THEN {_CODING}
  WHEN {_sql_any(fixed.SEARCH_TOOLS)} OR len([x FOR x IN tools IF starts_with(x, 'mcp__')]) > 0 OR {_READ} THEN {_EXPLORING}
  WHEN {_sql_any(fixed.TASK_TOOLS)} THEN 'Planning' WHEN list_contains(tools, 'Skill') THEN 'General' ELSE {_TALK} END AS category FROM g)
"""


@query(TURNS + " SELECT source_path, session_id, turn_no, n_calls FROM t")
def turn_grouping(spark, sf_dir):
    return classify.turns(calls(spark, sf_dir)).select("source_path", "session_id", "turn_no", "n_calls")


@query(TURNS + " SELECT source_path, session_id, turn_no, retries, has_edits FROM t")
def turn_retries(spark, sf_dir):
    return classify.turns(calls(spark, sf_dir)).select("source_path", "session_id", "turn_no", "retries", "has_edits")


@query(TURNS + " SELECT source_path, session_id, turn_no, user_message, array_to_string(tools, ',') AS tools, day, category FROM t")
def turn_classified(spark, sf_dir):
    return classify.turns(calls(spark, sf_dir)).select("source_path", "session_id", "turn_no", "user_message", F.array_join("tools", ",").alias("tools"), "day", "category")


_CATEGORY = TURNS + """ SELECT category, COUNT(*) AS turns, CAST(SUM(e8) AS DOUBLE) / 1e8 AS cost_usd, COUNT(*) FILTER (has_edits) AS edit_turns,
CAST(COALESCE(SUM(retries) FILTER (has_edits), 0) AS BIGINT) AS retries, COUNT(*) FILTER (has_edits AND retries = 0) AS one_shot,
CASE WHEN COUNT(*) FILTER (has_edits) > 0 THEN CAST(floor(COUNT(*) FILTER (has_edits AND retries = 0) * 100.0 / COUNT(*) FILTER (has_edits) + 0.5) AS INTEGER) END AS one_shot_pct FROM t GROUP BY category"""


@query(_CATEGORY + " ORDER BY cost_usd DESC, category")
def category_breakdown(spark, sf_dir):
    return out(reports.by_category(classify.turns(calls(spark, sf_dir)))).orderBy(F.desc("cost_usd"), "category")


@query(f" {_CATEGORY[len(TURNS):]}".replace("SELECT category, COUNT(*) AS turns, CAST(SUM(e8) AS DOUBLE) / 1e8 AS cost_usd,", "SELECT category,"), CTES + TURNS)
def one_shot_pct(spark, sf_dir):
    return reports.by_category(classify.turns(calls(spark, sf_dir))).select("category", "edit_turns", "retries", "one_shot", "one_shot_pct")


def _status_sql() -> str:
    parts = []
    for name in ("today", "week", "month"):
        a, b = reports.period(name, AS_OF)
        parts.append(f"CAST(COALESCE(SUM(e8) FILTER (day BETWEEN '{a}' AND '{b}'), 0) AS DOUBLE) / 1e8 AS {name}_cost, COUNT(*) FILTER (day BETWEEN '{a}' AND '{b}') AS {name}_calls")
    return " SELECT " + ", ".join(parts) + " FROM c"


@query(_status_sql())
def status_periods(spark, sf_dir):
    return out(reports.status(calls(spark, sf_dir), AS_OF))


@query(f" SELECT day, {_COST} FROM c WHERE day BETWEEN '2024-01-23' AND '2024-01-30' GROUP BY day")
def period_filter_day(spark, sf_dir):
    return out(reports.in_days(calls(spark, sf_dir), *reports.period("week", AS_OF)).groupBy("day").agg(F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("calls")))


@query(" SELECT source_path, line_no, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM c WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') BETWEEN '2024-01-10T06:00:00' AND '2024-01-12T18:30:00'")
def period_filter_instant(spark, sf_dir):
    rows = reports.in_instants(calls(spark, sf_dir), "2024-01-10T06:00:00", "2024-01-12T18:30:00")
    return rows.select("source_path", "line_no", F.substring("ts_raw", 1, 19).alias("at"))


@query(" SELECT provider, source_path, line_no, dedup_key FROM u")
def dedup_calls(spark, sf_dir):
    return ordered.dedup_calls(raw_calls(spark, sf_dir)).select("provider", "source_path", "line_no", "dedup_key")


_TALKS = "SELECT conv_id, turn, role, text FROM conversations"


@query(f"SELECT conv_id, turn, LAST_VALUE(CASE WHEN role = 'user' AND trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS user_message FROM ({_TALKS}) QUALIFY role = 'assistant'", "")
def carry_user_message(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = ordered.carry_user(F.col("role") == "user", F.col("text"), F.col("turn"), ordered.by_line("conv_id", "turn"))
    return rows.withColumn("said", said).filter("role = 'assistant'").select("conv_id", "turn", F.col("said.text").alias("user_message"))


@query("""SELECT conv_id, turn, COALESCE(user_message, '') AS user_message FROM (
SELECT *, LAST_VALUE(CASE WHEN role = 'user' AND trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id, seg ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS user_message FROM (
SELECT *, COALESCE(SUM(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM conversations)) WHERE role = 'assistant'""", "")
def consume_user_message(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = ordered.consume_user(rows, F.col("role") == "user", F.col("role") == "assistant", F.col("text"), "conv_id", "turn")
    return rows.filter("role = 'assistant'").select("conv_id", "turn", "user_message")


@query(" SELECT source_path, line_no, COALESCE(LAST_VALUE(CASE WHEN k % 3 = 0 THEN model END IGNORE NULLS) OVER (PARTITION BY source_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'gpt-5') AS model FROM f")
def carry_model(spark, sf_dir):
    rows = raw_calls(spark, sf_dir)
    model = ordered.carry_model(F.when(F.col("k") % 3 == 0, F.col("model")), ordered.by_line(), F.lit("gpt-5"))
    return rows.select("source_path", "line_no", model.alias("model"))


@query("""SELECT user_id, event_id, array_to_string(tools, ',') AS tools FROM (
SELECT *, list(CASE WHEN event_type <> 'purchase' THEN event_type END ORDER BY event_id) FILTER (event_type <> 'purchase') OVER (PARTITION BY user_id, seg) AS tools FROM (
SELECT *, COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM events)) WHERE event_type = 'purchase'""".replace("list(CASE WHEN event_type <> 'purchase' THEN event_type END ORDER BY event_id) FILTER (event_type <> 'purchase') OVER (PARTITION BY user_id, seg)", "list(event_type) FILTER (event_type <> 'purchase') OVER (PARTITION BY user_id, seg ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)").replace("array_to_string(tools, ',')", "COALESCE(array_to_string(tools, ','), '')"), "")
def pending_tools(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    buys = F.col("event_type") == "purchase"
    rows = ordered.pending_tools(rows, F.when(~buys, F.col("event_type")), buys, "user_id", "event_id")
    return rows.filter(buys).select("user_id", "event_id", F.array_join("tools", ",").alias("tools"))


_TOTALS = ", z AS (SELECT source_path, line_no, k, CAST(SUM(CASE WHEN k % 4 = 0 THEN 0 ELSE k END) OVER (PARTITION BY source_path ORDER BY line_no) AS BIGINT) AS total FROM f)"


def _totals(spark, sf_dir):
    running = F.sum(F.when(F.col("k") % 4 == 0, 0).otherwise(F.col("k"))).over(ordered.so_far(ordered.by_line()))
    return raw_calls(spark, sf_dir).select("source_path", "line_no", "k", running.alias("total"))


@query(_TOTALS + """ SELECT source_path, line_no, CASE WHEN k % 3 = 0 THEN k ELSE GREATEST(total - COALESCE(LAST_VALUE(CASE WHEN k % 3 <> 0 THEN total END IGNORE NULLS)
OVER (PARTITION BY source_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) END AS tokens FROM z""")
def cumulative_delta(spark, sf_dir):
    last = F.when(F.col("k") % 3 == 0, F.col("k"))
    return _totals(spark, sf_dir).select("source_path", "line_no", ordered.cumulative_delta(last, F.col("total"), last.isNull(), ordered.by_line()).alias("tokens"))


@query(_TOTALS + " SELECT source_path, line_no, total > 0 AND total = COALESCE(LAG(total) OVER (PARTITION BY source_path ORDER BY line_no), 0) AS repeated FROM z")
def repeat_suppress(spark, sf_dir):
    return _totals(spark, sf_dir).select("source_path", "line_no", ordered.repeat_suppress(F.col("total"), ordered.by_line()).alias("repeated"))


@query("""WITH q AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant')
SELECT a.conv_id, a.turn, q.text AS user_message FROM a LEFT JOIN q USING (conv_id, n)""", "")
def fifo_pair(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return ordered.fifo_pair(rows.filter("role = 'user'"), rows.filter("role = 'assistant'").select("conv_id", "turn"), "conv_id", "turn", "text")


@query(" SELECT model, key, CAST(i AS DOUBLE) / 1e8 AS input, CAST(o AS DOUBLE) / 1e8 AS output FROM priced")
def price_resolution(spark, sf_dir):
    table = pricing.resolve_price(raw_calls(spark, sf_dir).select("model"), pricing.price_table(spark, PRICES), pricing.fallback_prices(spark))
    return out(table.select("model", "key", "input", "output"))


@query(" SELECT DISTINCT model, regexp_replace(split_part(model, '@', 1), '-[0-9]{8}$', '') AS short FROM f")
def short_model_names(spark, sf_dir):
    return raw_calls(spark, sf_dir).select("model", scalar.short_model(F.col("model")).alias("short")).distinct()


_RATES = [("EUR", 0.5, "€"), ("JPY", 128.0, "¥"), ("USD", 1.0, "$"), ("XXX", 0.25, "XXX")]


@query(f", x AS (SELECT day, CAST(SUM(e8) AS DOUBLE) / 1e8 AS usd FROM c GROUP BY day), r(code, rate, symbol) AS (VALUES {', '.join(f"('{a}', {b}::DOUBLE, '{s}')" for a, b, s in _RATES)}) SELECT day, code, symbol, usd * rate AS cost FROM x CROSS JOIN r")
def currency_report(spark, sf_dir):
    daily = reports.by_day(calls(spark, sf_dir)).select("day", F.col("cost_usd").cast("double").alias("usd"))
    table = pricing.rates(spark.createDataFrame([(a, b, None) for a, b, _ in _RATES], "code string, rate double, symbol string"))
    every = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in table.columns]) for r in table.collect()])  # one a currency
    return daily.select("day", "usd", F.explode(every).alias("r")).select("day", "r.code", "r.symbol", (F.col("usd") * F.col("r.rate")).alias("cost"))


@query(", x AS (SELECT day, CAST(SUM(e8) AS DOUBLE) / 1e8 AS usd FROM c GROUP BY day) SELECT day, code, symbol, floor(usd * rate * 100 + 0.5) / 100 AS cost, 'Cost (' || code || ')' AS header FROM x CROSS JOIN (VALUES ('EUR', 0.5::DOUBLE, '€'), ('CHF', 1.0::DOUBLE, 'CHF'), ('USD', 1.0::DOUBLE, '$')) r(code, rate, symbol)")
def converted_daily(spark, sf_dir):
    """Cost of each day in a currency of the table, in one that it lacks, and in dollars, for which its rate does not count."""
    daily = reports.by_day(calls(spark, sf_dir)).select("day", F.col("cost_usd").cast("double").alias("usd"))
    table = pricing.rates(spark.createDataFrame([("EUR", 0.5, None), ("USD", 3.0, None)], "code string, rate double, symbol string"))
    both = None
    for code in ("EUR", "CHF", "USD"):
        own = pricing.in_currency(daily, table, code)
        own = own.select("day", "code", "symbol", scalar.convert_cost(F.col("usd"), F.col("rate")).alias("cost"), F.lit(scalar.cost_header(code)).alias("header"))
        both = own if both is None else both.unionByName(own)
    return both


_STAND_INS = ", ".join(f"'{x}'" for x in scalar.STAND_INS)


@query(f" SELECT DISTINCT project, list_extract([{_STAND_INS}], CAST(CAST('0x' || substr(md5(project), 1, 8) AS BIGINT) % {len(scalar.STAND_INS)} AS INTEGER) + 1) || '-' || substr(md5(project), 9, 2) AS pseudonym FROM f")
def project_pseudonyms(spark, sf_dir):
    return raw_calls(spark, sf_dir).select("project").distinct().withColumn("pseudonym", scalar.pseudonym(F.col("project")))


@query(" SELECT provider, COUNT(DISTINCT source_path) AS sources FROM f GROUP BY provider")
def provider_presence(spark, sf_dir):
    return reports.provider_presence(raw_calls(spark, sf_dir))


@query(f" SELECT source_path, strftime(ts, '%Y-%m-%d') AS utc_day, {_COST} FROM c GROUP BY source_path, utc_day")
def file_day_costs(spark, sf_dir):
    return out(reports.file_day_costs(calls(spark, sf_dir)))


@query(f" SELECT session_id, epoch(date_trunc('second', ts))::BIGINT AS second, {_COST} FROM c GROUP BY session_id, second")
def bucket_summary(spark, sf_dir):
    return out(reports.seconds(calls(spark, sf_dir)).withColumn("second", F.col("second").cast("long")))


def _export_sql() -> str:
    parts = []
    for label, name in incremental.EXPORT_PERIODS.items():
        a, b = reports.period(name, AS_OF)
        parts.append(f"SELECT '{label}' AS period, CAST(COALESCE(SUM(e8), 0) AS DOUBLE) / 1e8 AS cost_usd, COUNT(*) AS calls, COUNT(DISTINCT (source_path, session_id)) AS sessions FROM c WHERE day BETWEEN '{a}' AND '{b}'")
    return " " + " UNION ALL ".join(parts)


@query(_export_sql())
def export_summary(spark, sf_dir):
    return out(incremental.export_summary(calls(spark, sf_dir), AS_OF))


@query(f" SELECT source_path, session_id, day, {_COST}, {_TOKENS} FROM c GROUP BY source_path, session_id, day")
def incremental_merge(spark, sf_dir):
    """A rollup of one half of the sources as stored, and of the other as read anew, gives the whole."""
    rows = calls(spark, sf_dir)
    half = F.crc32("source_path") % 2 == 0
    return out(reports.merge(reports.session_days(rows.filter(half)), reports.session_days(rows.filter(~half))))


_MAPS = ", ".join(f"('{p}', '{a}', '{b}')" for p, m in fixed.TOOL_MAPS.items() for a, b in m.items())


@query(f", m(provider, raw, shown) AS (VALUES {_MAPS}), x AS (SELECT provider, unnest([lower(t) FOR t IN tools]) AS raw FROM f) SELECT x.provider, COALESCE(shown, x.raw) AS tool, COUNT(*) AS calls FROM x LEFT JOIN m USING (provider, raw) GROUP BY ALL")
def map_tools(spark, sf_dir):
    rows = raw_calls(spark, sf_dir).withColumn("raw", F.transform("tools", F.lower))
    shown = F.col("raw")
    for p in fixed.TOOL_MAPS:
        shown = F.when(F.col("provider") == p, scalar.map_tools(F.col("raw"), p)).otherwise(shown)
    return rows.select("provider", F.explode(shown).alias("tool")).groupBy("provider", "tool").agg(F.count(F.lit(1)).alias("calls"))


@query(" SELECT DISTINCT user_message, " + ", ".join(f"{_sql_kw(g)} AS {g}" for g in fixed.KEYWORDS) + " FROM f")
def keyword_flags(spark, sf_dir):
    return raw_calls(spark, sf_dir).select("user_message", *[scalar.has_keyword(F.col("user_message"), g).alias(g) for g in fixed.KEYWORDS]).distinct()


@query(" SELECT day, CASE WHEN v >= 1 THEN printf('$%.2f', v) WHEN v >= 0.01 THEN printf('$%.3f', v) ELSE printf('$%.4f', v) END AS shown, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 1000 THEN printf('%.1fK', n / 1e3) ELSE CAST(n AS VARCHAR) END AS tokens FROM (SELECT day, CAST(SUM(e8) AS DOUBLE) / 1e8 AS v, CAST(SUM(input_tokens) AS BIGINT) AS n FROM c GROUP BY day)")
def formatted_daily(spark, sf_dir):
    daily = reports.by_day(calls(spark, sf_dir))
    return daily.select("day", scalar.format_cost(F.col("cost_usd")).alias("shown"), scalar.format_tokens(F.col("input_tokens")).alias("tokens"))


@query(f" SELECT model_name, {_COST} FROM (SELECT * REPLACE (regexp_replace(split_part(model, '@', 1), '-[0-9]{{8}}$', '') AS model_name) FROM c) GROUP BY model_name ORDER BY cost_usd DESC, model_name LIMIT 10")
def model_top(spark, sf_dir):
    return out(reports.top(reports.by_model(calls(spark, sf_dir)).select("model_name", "cost_usd", "calls"), "cost_usd", "model_name", 10))


@query(_status_sql().replace("day BETWEEN", "strftime(ts, '%Y-%m-%dT%H:%M:%S') BETWEEN").replace(" AND '2024-01-30'", " AND '2024-01-30T23:59:59'"))
def status_utc(spark, sf_dir):
    return out(reports.status_utc(calls(spark, sf_dir), AS_OF))


@query(" SELECT day, format('{:,}', CAST(SUM(input_tokens) AS BIGINT)) AS input_tokens, format('{:,}', COUNT(*)) AS calls FROM c GROUP BY day")
def formatted_numbers(spark, sf_dir):
    daily = reports.by_day(calls(spark, sf_dir))
    return daily.select("day", scalar.format_number(F.col("input_tokens")).alias("input_tokens"), scalar.format_number(F.col("calls")).alias("calls"))


@query(" SELECT DISTINCT source_path, replace(regexp_replace(source_path, '^/+', ''), '/', '-') AS sanitized, split_part(source_path, '/', -1) AS base, CASE k % 3 WHEN 0 THEN concat(chr(39), '=', project) WHEN 1 THEN concat(chr(34), project, ',', chr(34), chr(34), 'x', chr(34)) ELSE project END AS safe, k % 3 = 1 AS valid FROM f")
def text_functions(spark, sf_dir):
    kind = F.col("k") % 3
    value = F.when(kind == 0, F.concat(F.lit("="), "project")).when(kind == 1, F.concat("project", F.lit(',"x'))).otherwise(F.col("project"))
    code = F.when(kind == 1, "EUR").when(kind == 0, "eur").otherwise("EURO")
    path = F.col("source_path")
    rows = raw_calls(spark, sf_dir)
    return rows.select("source_path", scalar.sanitize_project(path).alias("sanitized"), scalar.basename(path).alias("base"), scalar.csv_safe(value).alias("safe"), scalar.valid_currency(code).alias("valid")).distinct()


_REAL = ["claude-opus-4-7", "claude-opus-4-20250514", "claude-sonnet-4-5@20250929", "gpt-5.4-mini-x", "gpt-4o", "own-model"]
_REAL_SQL = "(VALUES ('claude-opus-4-7', 'Opus 4.7', 2500, 500, 6), ('claude-opus-4-20250514', 'Opus 4', 7500, 1500, 1), ('claude-sonnet-4-5@20250929', 'Sonnet 4.5', 1500, 300, 1), ('gpt-5.4-mini-x', 'GPT-5.4 Mini', 160, 40, 1), ('gpt-4o', 'GPT-4o', 1000, 250, 1), ('own-model', 'own-model', 0, 0, 1), ('default', 'default', 1500, 300, 1)) m(model, shown, o, i, fast)"
_REAL_NAME = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_REAL))


@query(f", x AS (SELECT * EXCLUDE (model, provider), CASE WHEN line_no % 7 = 6 THEN 'cursor' WHEN line_no % 2 = 0 THEN 'codex' ELSE 'claude' END AS provider, CASE line_no % 7 {_REAL_NAME} ELSE 'default' END AS model FROM f) SELECT provider, model, shown AS short, CAST(SUM((input_tokens * i + output_tokens * o + CASE WHEN provider = 'codex' THEN k * o ELSE 0 END) * CASE WHEN speed = 'fast' THEN fast ELSE 1 END) AS DOUBLE) / 1e8 AS cost_usd FROM x JOIN {_REAL_SQL} USING (model) GROUP BY ALL")
def real_model_costs(spark, sf_dir):
    """Costs and names of models on sale by provider: exact, dated, marked, by prefix, unknown, and the editor's default one."""
    n, name = F.col("line_no") % 7, F.lit("default")
    for i, m in enumerate(_REAL):
        name = F.when(n == i, m).otherwise(name)
    rows = raw_calls(spark, sf_dir).withColumn("model", name).withColumn("provider", F.when(n == 6, "cursor").when(F.col("line_no") % 2 == 0, "codex").otherwise("claude"))
    rows = rows.select("provider", "model", "input_tokens", "output_tokens", F.when(F.col("provider") == "codex", F.col("k")).otherwise(0).alias("reasoning_tokens"), "speed")
    priced = pricing.with_cost(rows, pricing.fallback_prices(spark), models=spark.createDataFrame([(m,) for m in [*_REAL, "default"]], "model string"))
    return out(priced.groupBy("provider", "model", scalar.short_model(F.col("model")).alias("short")).agg(F.sum("cost_usd").alias("cost_usd")))
