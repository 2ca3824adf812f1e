"""Activity of a turn, from its user message and tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmeter.functions import fixed
from callmeter.functions.scalar import any_of, has_keyword
from callmeter.operators.ordered import with_retries, with_turns, with_turns_in_pieces


def conversation(message: Column) -> Column:
    kw = lambda g: has_keyword(message, g)
    return (
        F.when(kw("brainstorm"), "Brainstorming").when(kw("research"), "Exploration").when(kw("debug"), "Debugging").when(kw("feature"), "Feature Dev")
        .when(message.rlike("(?iU)" + fixed.FILE_PATTERN) | message.rlike("(?iU)" + fixed.SCRIPT_PATTERN), "Coding")
        .when(message.rlike("(?i)" + fixed.URL_PATTERN), "Exploration").otherwise("Conversation")
    )


def classify_turn(message: Column, tools: Column) -> Column:
    kw = lambda g: has_keyword(message, g)
    message = F.coalesce(message, F.lit(""))
    shell, edits, reads = any_of(tools, fixed.SHELL_TOOLS), any_of(tools, fixed.EDIT_TOOLS), any_of(tools, fixed.READ_TOOLS)
    search = any_of(tools, fixed.SEARCH_TOOLS) | F.exists(tools, lambda t: t.startswith("mcp__"))
    coding = F.when(kw("debug"), "Debugging").when(kw("refactor"), "Refactoring").when(kw("feature"), "Feature Dev").otherwise("Coding")
    exploring = F.when(kw("research"), "Exploration").when(kw("debug"), "Debugging").otherwise("Exploration")
    return (
        F.when(F.size(tools) == 0, conversation(message))
        .when(F.array_contains(tools, "EnterPlanMode"), "Planning").when(F.array_contains(tools, "Agent"), "Delegation")
        .when(shell & ~edits & kw("test"), "Testing").when(shell & ~edits & kw("git"), "Git Ops").when(shell & ~edits & (kw("build") | kw("install")), "Build/Deploy")
        .when(edits, coding).when(shell & reads, exploring).when(shell, coding).when(search | reads, exploring)
        .when(any_of(tools, fixed.TASK_TOOLS), "Planning").when(F.array_contains(tools, "Skill"), "General").otherwise(conversation(message))
    )


def turns(calls: DataFrame, in_pieces: bool = False) -> DataFrame:
    """One row a turn: source_path, session_id, project, turn_no, user_message, ts_raw, day, n_calls, tools, cost_usd, category, retries, has_edits.

    calls: priced calls with day. A turn belongs to the day of its first call. in_pieces: for sessions too long for a task.
    """
    rows = with_retries((with_turns_in_pieces if in_pieces else with_turns)(calls))
    order = F.struct("ts_raw", "line_no")
    tools = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ts_raw", "line_no", "tools"))), lambda x: x["tools"]))
    out = rows.groupBy("source_path", "session_id", "project", "turn_no").agg(
        F.min_by("user_message", order).alias("user_message"), F.min("ts_raw").alias("ts_raw"), F.min_by("day", order).alias("day"), F.count(F.lit(1)).alias("n_calls"),
        tools.alias("tools"), F.sum("cost_usd").alias("cost_usd"), F.sum(F.col("is_retry").cast("int")).cast("int").alias("retries"), F.max("is_edit").alias("has_edits"),
    )
    return out.withColumn("category", classify_turn(F.col("user_message"), F.col("tools")))
