"""Operators on the lines of a log in their order. Each is a window over (source, line); a source is one log file.

Nulls: a null text, model or counter is as if the line had none. Lines of one source must have different numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from callmeter.functions import fixed
from callmeter.functions.scalar import any_of


def by_line(source: str = "source_path", line: str = "line_no") -> WindowSpec:
    return Window.partitionBy(source).orderBy(line)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def carry_user(is_user: Column, text: Column, ts: Column, w: WindowSpec) -> Column:
    """struct(text, ts) of the latest user line with a text that is not blank."""
    said = F.when(is_user & (F.regexp_replace(text, r"(?U)\s+", "") != ""), F.struct(text.alias("text"), ts.alias("ts")))
    return F.last(said, ignorenulls=True).over(so_far(w))


def segment(emits: Column, w: WindowSpec) -> Column:
    """How many lines before this one have emitted a call."""
    return F.coalesce(F.sum(F.when(emits, 1).otherwise(0)).over(before(w)), F.lit(0))


def consume_user(df: DataFrame, is_user: Column, emits: Column, text: Column, source: str = "source_path", line: str = "line_no") -> DataFrame:
    """Adds user_message: a user text goes to the next emitted call alone."""
    w = by_line(source, line)
    df = df.withColumn("_seg", segment(emits, w)).withColumn("_said", F.when(is_user & (F.regexp_replace(text, r"(?U)\s+", "") != ""), text))
    own = Window.partitionBy(source, "_seg").orderBy(line)
    said = F.coalesce(F.last("_said", ignorenulls=True).over(so_far(own)), F.lit(""))
    return df.withColumn("user_message", F.when(emits, said)).drop("_seg", "_said")


def carry_model(model: Column, w: WindowSpec, default: Column | None = None) -> Column:
    latest = F.last(F.nullif(model, F.lit("")), ignorenulls=True).over(so_far(w))
    return latest if default is None else F.coalesce(latest, default)


def pending_tools(df: DataFrame, tool: Column, emits: Column, source: str = "source_path", line: str = "line_no") -> DataFrame:
    """Adds tools: names since the call before, attached to an emitted call in their order."""
    df = df.withColumn("_seg", segment(emits, by_line(source, line))).withColumn("_tool", F.when(tool.isNotNull(), F.struct(F.col(line).alias("l"), tool.alias("t"))))
    own = Window.partitionBy(source, "_seg")
    tools = F.transform(F.array_sort(F.collect_list("_tool").over(own)), lambda x: x["t"])
    return df.withColumn("tools", F.when(emits, tools)).drop("_seg", "_tool")


def repeat_suppress(total: Column, w: WindowSpec) -> Column:
    """True for a cumulative total that is above 0 and equal to the one before it (0 before the first)."""
    return (total > 0) & (total == F.coalesce(F.lag(total, 1).over(w), F.lit(0)))


def cumulative_delta(last: Column, total: Column, records: Column, w: WindowSpec) -> Column:
    """Own usage if there is one, else the total less the one recorded before, at least 0."""
    recorded = F.last(F.when(records, total), ignorenulls=True).over(before(w))
    return F.coalesce(last, F.greatest(total - F.coalesce(recorded, F.lit(0)), F.lit(0)))


def dedup_calls(calls: DataFrame) -> DataFrame:
    """First call of a key by (source_path, line_no), over all files of a provider. Null and empty keys are all kept.

    A row without a key has a window of its own, so that such rows never gather in one task. That only the first row of a
    window is asked for lets Spark leave out a task's repeated keys before the rows are shuffled.
    """
    keyed = F.coalesce(F.col("dedup_key"), F.lit("")) != ""
    own = F.when(keyed, F.struct(F.col("dedup_key").alias("key"), F.lit("").alias("path"), F.lit(-1).cast("long").alias("line")))
    own = own.otherwise(F.struct(F.lit("").alias("key"), F.col("source_path").alias("path"), F.col("line_no").cast("long").alias("line")))
    first = Window.partitionBy("provider", own).orderBy("source_path", "line_no")
    return calls.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def with_turns(calls: DataFrame) -> DataFrame:
    """Adds turn_no: consecutive calls of a session with one non-empty user_ts; a call without is a turn by itself."""
    w = Window.partitionBy("source_path", "session_id").orderBy("ts_raw", "line_no")
    user = F.coalesce("user_ts", F.lit(""))
    starts = (user == "") | (F.lag(user).over(w).isNull()) | (F.lag(user).over(w) != user)
    return calls.withColumn("_s", F.when(starts, 1).otherwise(0)).withColumn("turn_no", F.sum("_s").over(so_far(w))).drop("_s")


def with_turns_in_pieces(calls: DataFrame, chars: int = 13) -> DataFrame:
    """As with_turns(), but no task holds a session: only what shares the first `chars` characters of ts_raw (13: an hour).

    The order of a session is by ts_raw first, so these pieces lie one after the other in it. Turns are counted in each by
    itself; a row a piece (its first and last user time, its count) says whether its first call starts a turn and how many
    come before. calls are evaluated twice: hand in what is stored.
    """
    keys, user = ["source_path", "session_id", "_piece"], F.coalesce("user_ts", F.lit(""))
    rows = calls.withColumn("_piece", F.coalesce(F.substring("ts_raw", 1, chars), F.lit("")))
    w = Window.partitionBy(*keys).orderBy("ts_raw", "line_no")
    starts = (user == "") | F.coalesce(F.lag(user).over(w) != user, F.lit(False))
    rows = rows.withColumn("_s", F.when(starts, 1).otherwise(0)).withColumn("_own", F.sum("_s").over(so_far(w)))
    place = F.struct("ts_raw", "line_no")
    ends = rows.groupBy(*keys).agg(F.min_by(user, place).alias("first"), F.max_by(user, place).alias("last"), F.sum("_s").alias("n"))
    by = Window.partitionBy("source_path", "session_id").orderBy("_piece")
    opens = F.when((F.col("first") != "") & F.coalesce(F.lag("last").over(by) != F.col("first"), F.lit(True)), 1).otherwise(0)
    ends = ends.withColumn("_opens", opens)
    earlier = F.coalesce(F.sum(F.col("n") + F.col("_opens")).over(before(by)), F.lit(0))
    ends = ends.select(*[F.col(k).alias(f"_of_{k}") for k in keys], (earlier + F.col("_opens")).alias("_earlier"))
    met = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return rows.join(ends, met).withColumn("turn_no", F.col("_own") + F.col("_earlier")).select(*calls.columns, "turn_no")


def with_retries(calls: DataFrame) -> DataFrame:
    """Adds is_edit, is_retry: an edit call after an edit and a shell call since."""
    turn = Window.partitionBy("source_path", "session_id", "turn_no").orderBy("ts_raw", "line_no")
    rows = calls.withColumn("_p", F.row_number().over(turn)).withColumn("is_edit", any_of(F.col("tools"), fixed.EDIT_TOOLS))
    shell = F.max(F.when(any_of(F.col("tools"), fixed.SHELL_TOOLS), F.col("_p"))).over(before(turn))
    edit = F.max(F.when(F.col("is_edit"), F.col("_p"))).over(before(turn))
    return rows.withColumn("is_retry", F.col("is_edit") & F.coalesce(shell >= edit, F.lit(False))).drop("_p")


def fifo_pair(questions: DataFrame, answers: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The nth answer of a conversation gets the nth text, in order; null where texts run out."""
    w = Window.partitionBy(key).orderBy(order)
    q = questions.select(key, F.col(text).alias("user_message"), F.row_number().over(w).alias("_n"))
    return answers.withColumn("_n", F.row_number().over(w)).join(q, [key, "_n"], "left").drop("_n")


def first_last_ts(ts_raw: Column) -> tuple[Column, Column]:
    said = F.nullif(ts_raw, F.lit(""))
    return F.coalesce(F.min(said), F.lit("")), F.coalesce(F.max(said), F.lit(""))
