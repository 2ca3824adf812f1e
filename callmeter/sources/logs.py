"""Session logs of coding assistants to rows of calls.

A source is a file of JSON lines. Lines keep their number over all splits of the file; blank and broken ones are left
out where they are parsed. All state that a log carries from line to line is a window over (source_path, line_no).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callmeter.functions import fixed
from callmeter.functions.scalar import basename, epoch_to_ts, instant, map_tools, sanitize_project, shell_commands
from callmeter.operators import ordered

CALL_COLUMNS = [
    "provider", "source_path", "line_no", "project", "session_id", "model", "input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens",
    "cached_input_tokens", "reasoning_tokens", "web_search_requests", "speed", "tools", "bash_commands", "ts_raw", "ts", "dedup_key", "user_message", "user_ts", "cost_logged",
]
_COUNTERS = [c for c in CALL_COLUMNS if c.endswith("_tokens")] + ["web_search_requests"]


def as_calls(df: DataFrame, also: list[str] | None = None, **columns: Column) -> DataFrame:
    """df in the columns of calls; those not given and not in df have their default. also: further columns of df that stay."""
    default = {c: F.lit(0).cast("long") for c in _COUNTERS} | {c: F.lit("") for c in ("project", "user_message", "user_ts", "ts_raw", "dedup_key")}
    default |= {"speed": F.lit("standard"), "tools": F.array().cast("array<string>"), "bash_commands": F.array().cast("array<string>"), "cost_logged": F.lit(None).cast("double")}
    have = {c: F.col(c) for c in df.columns}
    rows = df.select(*[(columns | {k: v for k, v in have.items() if k not in columns}).get(c, default.get(c, F.lit(None))).alias(c) for c in CALL_COLUMNS if c != "ts"], *(also or []))
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in _COUNTERS} | {c: F.coalesce(c, F.lit("")) for c in ("user_message", "user_ts", "ts_raw")})
    return rows.withColumn("ts", instant(F.col("ts_raw"))).select(*CALL_COLUMNS, *(also or []))


def scan_found(found: DataFrame) -> DataFrame:
    """The lines of the files of `found` (source_path) alone. Their paths reach the driver, which lists what it reads anyway."""
    paths = [r[0] for r in found.select("source_path").collect()]
    return scan_lines(found.sparkSession, paths) if paths else found.sparkSession.createDataFrame([], "source_path string, line_no long, value string")


def scan_lines(spark: SparkSession, paths: str | list[str], modified_after: str | None = None) -> DataFrame:
    """source_path, line_no (from 1), value of the lines of text files that are not blank.

    Lines are counted by split of a file; a running sum over the splits, not the lines, says with which number a split
    begins. A file of many splits is numbered by as many tasks, and no line moves for it where the splits' table is small
    enough for Spark to broadcast. The files are read twice, and must not change between.
    """
    reader = spark.read.option("recursiveFileLookup", "false")
    reader = reader.option("modifiedAfter", modified_after) if modified_after else reader
    rows = reader.text(paths).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "value"
    )
    splits = rows.groupBy("source_path", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source_path").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("source_path", "_b", (before - F.col("_first") + 1).alias("_start"))
    numbered = rows.filter("trim(value) <> ''").join(starts, ["source_path", "_b"])
    return numbered.select("source_path", (F.col("_start") + F.col("_i")).alias("line_no"), "value")


class Json:
    """Paths into a line's JSON value; null where it has none of that type."""

    def __init__(self, value: str = "v"):
        self.value = F.col(value)

    def __call__(self, path: str, kind: str = "string") -> Column:
        return F.try_variant_get(self.value, f"$.{path}", kind)


def parsed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("v", F.try_parse_json("value")).filter("v IS NOT NULL").drop("value")


def content_text(j: Json, path: str, kinds: list[str], plain: bool = True) -> Column:
    """Text of a message: a string as it is (if allowed), else its text blocks joined by a space."""
    blocks = j(path, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: b["type"].isin(*kinds) & b["text"].isNotNull()), lambda b: b["text"])
    out = F.when(blocks.isNotNull(), F.array_join(texts, " "))
    return F.coalesce(out, j(path)) if plain else out


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.jsonl)?$", 1)


#: A log of a project, or of a helper of one of its sessions; of nested `projects` folders the last one counts.
_CLAUDE_LOG = r"^(?:.*/)?projects/([^/]+)/(?:[^/]+/subagents/)?[^/]+[.]jsonl$"


def claude_project(path: Column) -> Column:
    return F.regexp_extract(path, _CLAUDE_LOG, 1)


def discover_claude(spark: SparkSession, root: str, depth: int = 8) -> DataFrame:
    """source_path, project, mtime, size of the logs below root: projects/<project>/*.jsonl and .../*/subagents/*.jsonl.

    `projects` folders may lie up to `depth` folders deep; what is in node_modules or .git is left out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    found = found.select(F.col("_metadata.file_path").alias("source_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    below = F.substring_index("source_path", root.split("://", 1)[-1].rstrip("/") + "/", -1)
    deep = F.size(F.split(F.regexp_extract(below, r"^((?:.*/)?)projects/", 1), "/")) - 1
    rows = found.withColumn("project", claude_project(F.col("source_path"))).filter((F.col("project") != "") & (deep <= depth) & ~below.rlike(r"(^|/)(node_modules|[.]git)/"))
    return rows.select("source_path", "project", "mtime", "size")


def status_claude(lines: DataFrame) -> DataFrame:
    """What the status needs of assistant lines, and no content: source_path, line_no, provider, model, tokens, speed, ts_raw, dedup_key."""
    j = Json()
    rows = parsed(lines.filter(F.col("value").contains("assistant"))).filter(j("type") == "assistant")
    use = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_write_tokens": "cache_creation_input_tokens", "cache_read_tokens": "cache_read_input_tokens", "web_search_requests": "server_tool_use.web_search_requests"}
    rows = rows.select(
        "source_path", "line_no", F.lit("claude").alias("provider"), j("message.model").alias("model"), *[F.coalesce(j(f"message.usage.{f}", "bigint"), F.lit(0)).alias(c) for c, f in use.items()],
        F.when(j("message.usage.speed") == "fast", "fast").otherwise("standard").alias("speed"), F.coalesce(j("timestamp"), F.lit("")).alias("ts_raw"), j("message.id").alias("dedup_key"),
        F.try_variant_get("v", "$.message.usage", "variant").isNotNull().alias("has_usage"),
    )
    return ordered.dedup_calls(rows).filter("model IS NOT NULL AND has_usage").drop("has_usage")


def claude_lines(lines: DataFrame) -> DataFrame:
    """Users' and assistants' lines, by themselves: said and said_ts, or the columns of a call; live where they have a model and usage."""
    j = Json()
    rows = parsed(lines.filter(F.col("value").contains('"type":"assistant"') | F.col("value").contains('"type":"user"') | F.col("value").rlike(r'"type"\s*:\s*"(assistant|user)"')))
    blocks = j("message.content", "array<struct<type:string,name:string,input:struct<command:string>>>")
    uses = F.coalesce(F.filter(blocks, lambda b: (b["type"] == "tool_use") & b["name"].isNotNull()), F.array().cast("array<struct<type:string,name:string,input:struct<command:string>>>"))
    shell = F.filter(uses, lambda b: b["name"].isin(*fixed.SHELL_TOOLS) & b["input"]["command"].isNotNull())
    asks = F.col("type") == "user"
    return rows.select(
        "source_path", "line_no", j("type").alias("type"), j("timestamp").alias("ts_raw"), content_text(j, "message.content", ["text"]).alias("said"), j("message.id").alias("dedup_key"),
        j("message.model").alias("model"), j("message.usage.input_tokens", "bigint").alias("input_tokens"), j("message.usage.output_tokens", "bigint").alias("output_tokens"),
        j("message.usage.cache_creation_input_tokens", "bigint").alias("cache_write_tokens"), j("message.usage.cache_read_input_tokens", "bigint").alias("cache_read_tokens"),
        j("message.usage.server_tool_use.web_search_requests", "bigint").alias("web_search_requests"), F.when(j("message.usage.speed") == "fast", "fast").otherwise("standard").alias("speed"),
        (j("message.model").isNotNull() & F.try_variant_get("v", "$.message.usage", "variant").isNotNull()).alias("live"), F.transform(uses, lambda b: b["name"]).alias("tools"),
        F.flatten(F.transform(shell, lambda b: shell_commands(b["input"]["command"]))).alias("bash_commands"),
    ).filter("type IN ('user', 'assistant')").select(
        "*", F.lit("claude").alias("provider"), F.when(asks, F.coalesce("ts_raw", F.lit(""))).alias("said_ts"), claude_project(F.col("source_path")).alias("project"),
    ).withColumns({"said": F.when(asks, F.col("said")), "emits": ~asks})


def claude_candidates(lines: DataFrame) -> DataFrame:
    """Each assistant line in the columns of calls, and live: it has a model and usage. One that has not still takes its message id."""
    rows = claude_lines(lines)
    last = ordered.carry_user(~F.col("emits"), F.col("said"), F.col("said_ts"), ordered.by_line())
    rows = rows.withColumn("last", last).filter("emits")
    return as_calls(rows, also=["live"], session_id=stem(F.col("source_path")), user_message=F.col("last.text"), user_ts=F.col("last.ts"))


def scan_claude(lines: DataFrame) -> DataFrame:
    """Assistant lines with a model and usage; the first line with a message id counts, also if it has no usage."""
    return ordered.dedup_calls(claude_candidates(lines)).filter("live").drop("live")


_USAGE = "input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint,total_tokens:bigint"
_CODEX = (
    "type string, timestamp string, payload struct<type:string,role:string,cwd:string,originator:string,session_id:string,model:string,name:string,content:array<struct<type:string,text:string>>,"
    f"info:struct<model:string,model_name:string,last_token_usage:struct<{_USAGE}>,total_token_usage:struct<{_USAGE}>>>"
)


#: Usage of codex's counts, in the order of its columns.
_CODEX_USE = {"all_input": "input_tokens", "cached_input_tokens": "cached_input_tokens", "output_tokens": "output_tokens", "reasoning_tokens": "reasoning_output_tokens"}


def codex_lines(lines: DataFrame) -> DataFrame:
    """Lines by themselves: head (whether a file that starts with this line is read), project, session_id, session_model, said, tool, and of
    a count (is_count) its total, whether the usage is its own, and the usage, or else the running totals of it."""
    rows = lines.withColumn("e", F.from_json("value", _CODEX, {"mode": "PERMISSIVE"})).filter("e.type IS NOT NULL")
    p, meta, item = F.col("e.payload"), F.col("e.type") == "session_meta", F.col("e.type") == "response_item"
    total, last = p["info"]["total_token_usage"], p["info"]["last_token_usage"]
    texts = F.transform(F.filter(p["content"], lambda b: (b["type"] == "input_text") & (b["text"] != "")), lambda b: b["text"])
    sure = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        "source_path", "line_no", sure(meta & F.lower(p["originator"]).startswith("codex")).alias("head"), sanitize_project(F.coalesce(p["cwd"], F.lit(""))).alias("project"),
        F.when(meta, p["session_id"]).alias("session_id"), F.when(meta, p["model"]).alias("session_model"), F.coalesce(p["info"]["model"], p["info"]["model_name"]).alias("model"),
        F.when(item & (p["type"] == "message") & (p["role"] == "user"), F.array_join(texts, " ")).alias("said"), F.when(item & (p["type"] == "function_call"), p["name"]).alias("tool"),
        sure((F.col("e.type") == "event_msg") & (p["type"] == "token_count") & p["info"].isNotNull()).alias("is_count"), F.coalesce(total["total_tokens"], F.lit(0)).alias("cum"), last.isNotNull().alias("own"),
        *[F.coalesce(F.when(last.isNotNull(), last[f]).otherwise(total[f]), F.lit(0)).alias(c) for c, f in _CODEX_USE.items()], F.coalesce("e.timestamp", F.lit("")).alias("ts_raw"), F.lit("codex").alias("provider"),
    )


def codex_calls(rows: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Calls of counts that have their usage, tools, user_message, session_id, project and session_model. input_tokens are those not
    cached, 0 at least; also: as for as_calls(), such as all_input, the input as it is logged."""
    return as_calls(
        rows, also=also, tools=map_tools(F.col("tools"), "codex"), model=F.coalesce("model", "session_model", F.lit("gpt-5")), input_tokens=F.greatest(F.col("all_input") - F.col("cached_input_tokens"), F.lit(0)),
        cache_read_tokens=F.col("cached_input_tokens"), dedup_key=F.concat_ws(":", F.lit("codex"), "source_path", "ts_raw", F.col("cum").cast("string")),
    )


def scan_codex(lines: DataFrame, also: list[str] | None = None) -> DataFrame:
    """token_count events of files whose first line is a session_meta of an originator that starts with codex. also: as for codex_calls()."""
    w = ordered.by_line()
    rows = codex_lines(lines).withColumn("first", F.first(F.struct("head", "project")).over(ordered.so_far(w))).filter("first.head")
    latest = lambda c: F.last(c, ignorenulls=True).over(ordered.so_far(w))
    rows = rows.withColumns({"session_model": latest("session_model"), "session_id": F.coalesce(latest("session_id"), stem(F.col("source_path"))), "project": F.col("first.project")})
    counts = Window.partitionBy("source_path", "is_count").orderBy("line_no")
    rows = rows.withColumn("live", F.col("is_count") & ~ordered.repeat_suppress(F.col("cum"), counts) & (F.col("own") | (F.col("cum") > 0)))
    recorded = F.col("live") & ~F.col("own")
    rows = rows.withColumns({c: ordered.cumulative_delta(F.when(F.col("own"), F.col(c)), F.col(c), recorded, w) for c in _CODEX_USE})
    rows = rows.withColumn("emits", F.col("live") & (reduce(lambda a, b: a + b, (F.col(c) for c in _CODEX_USE)) > 0))
    rows = ordered.pending_tools(rows, F.col("tool"), F.col("emits"))
    return codex_calls(ordered.consume_user(rows, F.col("said").isNotNull(), F.col("emits"), F.col("said")).filter("emits"), also)


def pi_lines(lines: DataFrame) -> DataFrame:
    """Lines by themselves: head (whether a file that starts with this line is read), project, session_id, said, and the columns of a call."""
    j = Json()
    use = {c: j(f"message.usage.{f}", "bigint") for c, f in {"input_tokens": "input", "output_tokens": "output", "cache_read_tokens": "cacheRead", "cache_write_tokens": "cacheWrite"}.items()}
    whole = reduce(lambda a, b: a & b, (c.isNotNull() for c in use.values()))
    blocks = j("message.content", "array<struct<type:string,name:string,arguments:struct<command:string>>>")
    uses = F.coalesce(F.filter(blocks, lambda b: (b["type"] == "toolCall") & b["name"].isNotNull()), F.array().cast("array<struct<type:string,name:string,arguments:struct<command:string>>>"))
    shell = F.filter(uses, lambda b: (b["name"] == "bash") & b["arguments"]["command"].isNotNull())
    key = F.coalesce(F.nullif(j("message.responseId"), F.lit("")), j("id"), j("timestamp"), (F.col("line_no") - 1).cast("string"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    return parsed(lines).select(
        "source_path", "line_no", sure(j("type") == "session").alias("head"), basename(F.coalesce(j("cwd"), F.regexp_extract("source_path", "([^/]+)/[^/]+$", 1))).alias("project"),
        F.when(j("type") == "session", j("id")).alias("session_id"), F.when(j("message.role") == "user", content_text(j, "message.content", ["text"], plain=False)).alias("said"), F.lit("pi").alias("provider"),
        sure((j("message.role") == "assistant") & whole & ((use["input_tokens"] > 0) | (use["output_tokens"] > 0))).alias("emits"), F.coalesce(j("message.model"), F.lit("gpt-5")).alias("model"),
        *[c.alias(n) for n, c in use.items()], use["cache_read_tokens"].alias("cached_input_tokens"), map_tools(F.transform(uses, lambda b: b["name"]), "pi").alias("tools"), j("timestamp").alias("ts_raw"),
        F.flatten(F.transform(shell, lambda b: shell_commands(b["arguments"]["command"]))).alias("bash_commands"), F.concat_ws(":", F.lit("pi"), "source_path", key).alias("dedup_key"),
    )


def scan_pi(lines: DataFrame) -> DataFrame:
    """Assistant messages with all four usage counters, of files whose first line is a session."""
    w = ordered.by_line()
    rows = pi_lines(lines).withColumn("first", F.first(F.struct("head", "project")).over(ordered.so_far(w))).filter("first.head")
    session = F.last("session_id", ignorenulls=True).over(ordered.so_far(w))
    rows = rows.withColumns({"session_id": F.coalesce(session, stem(F.col("source_path"))), "project": F.col("first.project")})
    return as_calls(ordered.consume_user(rows, F.col("said").isNotNull(), F.col("emits"), F.col("said")).filter("emits"))


def copilot_projects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """directory, project: the last component of `cwd:` in each workspace.yaml, without comment and quotes."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("f"), F.regexp_extract("value", r"(?m)^cwd:[ \t]*([^\r\n]*)", 1).alias("c"))
    bare = F.regexp_replace(F.trim(F.regexp_replace("c", r"\s+#.*$", "")), r"""^["']|["']$""", "")
    return text.select(F.regexp_extract("f", "^(.*)/[^/]+$", 1).alias("directory"), basename(bare).alias("project")).filter("project <> ''")


def copilot_lines(lines: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Lines by themselves: model (a change to it), said, and the columns of a call, which emits if a model is known."""
    j = Json()
    sure = lambda c: F.coalesce(c, F.lit(False))
    directory = F.regexp_extract("source_path", "^(.*)/[^/]+$", 1)
    tools = F.transform(F.filter(F.coalesce(j("data.toolRequests", "array<struct<name:string>>"), F.array().cast("array<struct<name:string>>")), lambda t: t["name"].isNotNull()), lambda t: t["name"])
    rows = parsed(lines).select(
        "source_path", "line_no", directory.alias("directory"), basename(directory).alias("session_id"), F.when(j("type") == "session.model_change", F.nullif(j("data.newModel"), F.lit(""))).alias("model"),
        F.when(j("type") == "user.message", j("data.content")).alias("said"), sure((j("type") == "assistant.message") & (j("data.outputTokens", "bigint") > 0)).alias("emits"),
        j("data.outputTokens", "bigint").alias("output_tokens"), map_tools(tools, "copilot").alias("tools"), j("timestamp").alias("ts_raw"), F.coalesce(j("data.messageId"), F.lit("")).alias("id"), F.lit("copilot").alias("provider"),
    )
    rows = rows.join(projects, "directory", "left") if projects is not None else rows.withColumn("project", F.lit(None).cast("string"))
    return rows.withColumns({"project": F.coalesce("project", "session_id"), "dedup_key": F.when(F.col("id") != "", F.concat_ws(":", F.lit("copilot"), "session_id", "id")).otherwise("")}).drop("id")


def scan_copilot(lines: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Assistant messages with output tokens after a model is known; the session is the directory."""
    rows = copilot_lines(lines, projects)
    rows = rows.withColumn("model", ordered.carry_model(F.col("model"), ordered.by_line())).withColumn("emits", F.col("emits") & F.col("model").isNotNull())
    return as_calls(ordered.consume_user(rows, F.col("said").isNotNull(), F.col("emits"), F.col("said")).filter("emits"))


_MESSAGE = "role string, modelID string, cost double, tokens struct<input:bigint,output:bigint,reasoning:bigint,cache:struct<read:bigint,write:bigint>>"
_PART = "type string, text string, tool string, state struct<input:struct<command:string>>"


def discover_opencode(session: DataFrame) -> DataFrame:
    """session_id, project of sessions that are neither archived nor a child."""
    name = F.coalesce(F.nullif("directory", F.lit("")), F.nullif("title", F.lit("")), F.lit("unknown"))
    return session.filter("time_archived IS NULL AND parent_id IS NULL").select(F.col("id").alias("session_id"), sanitize_project(name).alias("project"))


def scan_opencode(session: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    """Assistant messages with tokens or a cost; parts are gathered per message before the join."""
    wanted = discover_opencode(session)
    parts = part.join(wanted.select("session_id"), "session_id", "left_semi").select("session_id", "message_id", "id", F.from_json("data", _PART).alias("p"))
    parts = parts.groupBy("session_id", "message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "p"))), lambda x: x["p"]).alias("parts"))
    likely = message.filter(F.col("data").contains("assistant") | F.col("data").contains("user"))  # before the parse; roles are compared after it
    rows = likely.join(wanted, "session_id").withColumn("m", F.from_json("data", _MESSAGE)).filter("m.role IN ('user', 'assistant')")
    rows = rows.join(parts, (rows["session_id"] == parts["session_id"]) & (rows["id"] == parts["message_id"]), "left").select(rows["session_id"], "project", "id", "time_created", "m", "parts")
    w = Window.partitionBy("session_id").orderBy("time_created", "id")
    parts_ = F.coalesce("parts", F.array().cast(f"array<struct<{_PART.replace(' string', ':string').replace('state struct', 'state:struct').replace(', ', ',')}>>"))
    text = F.array_join(F.transform(F.filter(parts_, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), " ")
    rows = rows.withColumn("said", ordered.carry_user(F.col("m.role") == "user", text, F.lit(""), w)).withColumn("line_no", F.row_number().over(w).cast("long")).filter("m.role = 'assistant'")
    t = F.col("m.tokens")
    rows = rows.withColumns({c: F.coalesce(v, F.lit(0)) for c, v in {"input_tokens": t["input"], "output_tokens": t["output"], "reasoning_tokens": t["reasoning"], "cache_read_tokens": t["cache"]["read"], "cache_write_tokens": t["cache"]["write"]}.items()})
    rows = rows.filter("input_tokens > 0 OR output_tokens > 0 OR reasoning_tokens > 0 OR cache_read_tokens > 0 OR cache_write_tokens > 0 OR coalesce(m.cost, 0) <> 0")
    uses = F.filter(parts_, lambda p: (p["type"] == "tool") & p["tool"].isNotNull())
    shell = F.filter(uses, lambda p: (p["tool"] == "bash") & p["state"]["input"]["command"].isNotNull())
    return as_calls(
        rows, provider=F.lit("opencode"), source_path=F.concat(F.lit("opencode:"), "session_id"), model=F.coalesce("m.modelID", F.lit("unknown")), cached_input_tokens=F.col("cache_read_tokens"),
        tools=map_tools(F.transform(uses, lambda p: p["tool"]), "opencode"), bash_commands=F.flatten(F.transform(shell, lambda p: shell_commands(p["state"]["input"]["command"]))),
        ts_raw=F.date_format(F.to_utc_timestamp(epoch_to_ts(F.col("time_created").cast("long")), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        user_message=F.col("said.text"), cost_logged=F.col("m.cost"), dedup_key=F.concat_ws(":", F.lit("opencode"), "session_id", "id"),
    )


_BUBBLE = "type int, tokenCount struct<inputTokens:bigint,outputTokens:bigint>, modelInfo struct<modelName:string>, createdAt string, conversationId string, text string, codeBlocks array<struct<languageId:string>>"


def bubble_useful(b: Column, floor: str) -> Column:
    tokens = F.coalesce(b["tokenCount"]["inputTokens"], F.lit(0)) + F.coalesce(b["tokenCount"]["outputTokens"], F.lit(0))
    return (b["createdAt"] > floor) & ((b["type"] == 1) | ((b["type"] == 2) & (tokens > 0)))


def scan_cursor(kv: DataFrame, floor: str) -> DataFrame:
    """Answers with input tokens of a key-value table, paired with questions in their order. Not in union_providers."""
    rows = kv.filter("key LIKE 'bubbleId:%'").select("key", F.from_json("value", _BUBBLE).alias("b")).filter(bubble_useful(F.col("b"), floor))
    rows = rows.select("key", F.coalesce("b.conversationId", F.lit("unknown")).alias("session_id"), F.coalesce("b.createdAt", F.lit("")).alias("ts_raw"), F.substring(F.coalesce("b.text", F.lit("")), 1, 500).alias("text"), "b")
    order = rows.withColumn("at", F.struct("ts_raw", "key"))
    answers = order.filter("b.type = 2 AND b.tokenCount.inputTokens > 0")
    answers = answers.withColumn("output", F.coalesce("b.tokenCount.outputTokens", F.lit(0))).withColumn("dedup_key", F.concat_ws(":", F.lit("cursor"), "session_id", "ts_raw", F.col("b.tokenCount.inputTokens").cast("string"), F.col("output").cast("string")))
    first = Window.partitionBy("dedup_key").orderBy("at")
    answers = answers.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    paired = ordered.fifo_pair(order.filter("b.type = 1 AND text <> ''"), answers, "session_id", "at", "text")
    langs = F.array_distinct(F.filter(F.transform(F.coalesce("b.codeBlocks", F.array().cast("array<struct<languageId:string>>")), lambda c: c["languageId"]), lambda x: x.isNotNull() & ~x.isin("", "plaintext")))
    tools = F.when(F.size(langs) > 0, F.concat(F.array(F.lit("cursor:edit")), F.transform(langs, lambda x: F.concat(F.lit("lang:"), x)))).otherwise(F.array().cast("array<string>"))
    name = F.coalesce("b.modelInfo.modelName", F.lit(""))
    return as_calls(
        paired.withColumn("line_no", F.row_number().over(Window.partitionBy("session_id").orderBy("at")).cast("long")), provider=F.lit("cursor"), source_path=F.concat(F.lit("cursor:"), "session_id"),
        model=F.when(name.isin("", "default"), F.lit("default")).otherwise(name), input_tokens=F.col("b.tokenCount.inputTokens"), output_tokens=F.col("output"), tools=tools,
        user_message=F.trim(F.concat_ws(" ", F.coalesce("user_message", F.lit("")), "text")),
    )


def union_providers(calls: list[DataFrame], provider: str = "all") -> DataFrame:
    both = reduce(DataFrame.unionByName, calls)
    return both if provider == "all" else both.filter(F.col("provider") == provider)


def sources(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source_path, mtime, size of the files that are read: no line is parsed."""
    m = spark.read.format("binaryFile").load(paths)
    return m.select(F.col("_metadata.file_path").alias("source_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def latest_activity(found: DataFrame) -> DataFrame:
    return found.agg(F.max("mtime").alias("latest"))


def changed_sources(found: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources that are as the ledger (source_path, mtime, size) has them, and the others."""
    key = ["source_path", "mtime", "size"]
    return found.join(ledger, key, "left_semi"), found.join(ledger, key, "left_anti")
