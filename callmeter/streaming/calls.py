"""Calls from a stream of log chunks, each counted once, and running totals by local day.

Chunks are files that do not change once they are there: a row has source_path, line_no and value, so that a log's lines
keep their place over chunks. A line is read by itself with the columns of the batch scans; only what a log carries from
line to line is state of its source: the user's text, the model, the session, tools since the last call, the last recorded
totals, and the keys that it has had. A source that is quiet for a time that the caller sets loses its state.

The query needs the RocksDB state store: `configure()` sets it in a session.
"""

from __future__ import annotations

import json
import zlib
from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import starmap
from operator import attrgetter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callmeter.functions.scalar import MONEY, local_day
from callmeter.operators.pricing import with_cost
from callmeter.sources import logs

LINES = "source_path string, line_no long, value string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of sources, whose lines are handed out together, and slots of a group, whose sources' states are one row of the store.
#: What is stored goes by both: a stream keeps the numbers that it began with.
GROUPS, SLOTS = 1024, 64
#: By name, the kinds of columns: of a call, and of what a line tells of its log.
_CALL = {
    "provider": "string", "source_path": "string", "line_no": "long", "project": "string", "session_id": "string", "model": "string", "input_tokens": "long", "output_tokens": "long", "cache_write_tokens": "long",
    "cache_read_tokens": "long", "cached_input_tokens": "long", "reasoning_tokens": "long", "web_search_requests": "long", "speed": "string", "tools": "array<string>", "bash_commands": "array<string>", "ts_raw": "string", "dedup_key": "string",
}
_KINDS = _CALL | {"head": "boolean", "emits": "boolean", "is_count": "boolean", "own": "boolean", "live": "boolean", "cum": "long", "all_input": "long", "session_model": "string", "said": "string", "said_ts": "string", "tool": "string"}
_OUT = _CALL | {"user_message": "string", "user_ts": "string", "session_model": "string", "cum": "long", "all_input": "long"}
#: Of columns that a provider's lines lack.
_DEFAULT = {"live": True, "speed": "standard", **{c: 0 for c, kind in _KINDS.items() if kind == "long"}, **{c: False for c, kind in _KINDS.items() if kind == "boolean" and c != "live"}}
#: What a new source carries: wanted, project, session, model, text and its time, last total, last recorded totals, waiting tools.
_NEW = (None, None, None, None, None, None, 0, 0, 0, 0, 0, [])
_USE = ["all_input", "cached_input_tokens", "output_tokens", "reasoning_tokens"]
#: By provider: columns of its lines, whether a text goes to one call alone, whether a file is judged by its first line.
PROVIDERS: dict[str, tuple[Callable[..., DataFrame], bool, bool]] = {
    "claude": (logs.claude_lines, False, False), "codex": (logs.codex_lines, True, True), "pi": (logs.pi_lines, True, True), "copilot": (logs.copilot_lines, True, False),
}


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


class _Carry(StatefulProcessor):
    """Takes the new lines of a group of sources, source by source and in their order, through the state of each.

    Lines of a source come in their order over batches. columns: of the lines; shown: of the calls.
    """

    def __init__(self, provider: str, quiet_ms: int, columns: list[str], shown: list[str]):
        self.provider, self.quiet_ms, self.columns, self.shown = provider, quiet_ms, columns, shown
        _, self.consumes, self.judged = PROVIDERS[provider]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.logs = handle.getMapState("logs", "slot int", "sources string")
        self.keys = handle.getMapState("keys", "source string, key string", "line long")
        lacking = {c: _DEFAULT.get(c) for c in _KINDS if c not in self.columns}
        self.line = namedtuple("Line", [*self.columns, *lacking], defaults=lacking.values())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, sources, out = timerValues.getCurrentProcessingTimeInMs(), {}, []
        for some in rows:
            for line in starmap(self.line, zip(*(some[c].tolist() for c in self.columns))):
                sources.setdefault(line.source_path, []).append(line)
        slots: dict[int, list] = {}
        for source in sources:
            slots.setdefault(zlib.crc32((source or "").encode()) % SLOTS, []).append(source)
        for slot, touched in slots.items():
            held = self._held(self.logs.getValue((slot,)))
            for source in touched:
                before = held[source][:-1] if source in held else _NEW
                held[source] = [*self._taken(source, sorted(sources[source], key=attrgetter("line_no")), before, out), now]
            self.logs.updateValue((slot,), (json.dumps(list(held.items())),))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(now + self.quiet_ms)
        yield pd.DataFrame(out, columns=self.shown, dtype=object)

    @staticmethod
    def _held(row: tuple | None) -> dict[str | None, list]:
        """What the sources of a slot carry, and last when each was seen."""
        return dict(json.loads(row[0])) if row else {}

    def _taken(self, source: str, lines: list[NamedTuple], held: tuple, out: list[tuple]) -> tuple:
        """What a source carries after some more lines; their calls are added to out."""
        wanted, project, session, model, said, said_ts, cum, *recorded, waiting = held
        waiting = list(waiting)
        for line in lines:
            if wanted is None:
                wanted, project = not self.judged or line.head, line.project
            if not wanted:
                break
            session = line.session_id or session
            model = (line.model if self.provider == "copilot" else line.session_model) or model
            if line.tool is not None:
                waiting.append(line.tool)
            if line.said is not None and line.said.strip():
                said, said_ts = line.said, line.said_ts
            emits, names = line.emits, {}
            if line.is_count:
                emits = (line.cum == 0 or line.cum != cum) and (line.own or line.cum > 0)
                cum = line.cum
                use = [getattr(line, c) for c in _USE]
                if emits and not line.own:
                    totals = use
                    use = [max(0, at - before) for at, before in zip(totals, recorded, strict=True)]
                    recorded = totals
                emits = emits and sum(use) > 0
                names = dict(zip(_USE, use)) | {"tools": waiting}
            if not emits or self.provider == "copilot" and not model:
                continue
            if self.provider == "claude" and line.dedup_key:
                if self.keys.containsKey((source, line.dedup_key)):
                    continue
                self.keys.updateValue((source, line.dedup_key), (line.line_no,))
            if not line.live:
                continue
            names |= {"session_id": session, "project": project if self.judged else line.project, "user_message": said or "", "user_ts": said_ts or ""}
            names |= {"session_model": model} if self.provider == "codex" else {"model": model} if self.provider == "copilot" else {}
            out.append(tuple(names[c] if c in names else getattr(line, c) for c in self.shown))
            if self.consumes:
                said, said_ts = None, None
            if line.is_count:
                waiting = []
        return wanted, project, session, model, said, said_ts, cum, *recorded, waiting

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        gone, left = set(), []
        for (slot,), row in list(self.logs.iterator()):
            held = self._held(row)
            stays = {source: own for source, own in held.items() if own[-1] + self.quiet_ms > now}
            left += [own[-1] for own in stays.values()]
            if len(stays) < len(held):
                gone |= held.keys() - stays.keys()
                self.logs.updateValue((slot,), (json.dumps(list(stays.items())),)) if stays else self.logs.removeKey((slot,))
        for own in [k for k in self.keys.keys() if k[0] in gone] if self.provider == "claude" and gone else []:
            self.keys.removeKey(tuple(own))
        if left:
            # a group is looked through sixteen times in the quiet time at most, however many sources become quiet
            self.handle.registerTimer(max(min(left) + self.quiet_ms, now + self.quiet_ms // 16))
        return iter([])

    def close(self) -> None:
        pass


def _columns(rows: DataFrame, kinds: dict[str, str]) -> list[Column]:
    """Columns of those kinds; what rows lacks has its default, and no number or flag is null."""
    default = {"long": F.lit(0), "boolean": F.lit(False), "array<string>": F.array()}
    out = []
    for c, kind in kinds.items():
        own = F.col(c) if c in rows.columns else F.lit(_DEFAULT.get(c) if kind != "array<string>" else None)
        out.append((F.coalesce(own, default[kind]) if kind in default else own).cast(kind).alias(c))
    return out


def stream_calls(lines: DataFrame, provider: str, quiet_seconds: int, projects: DataFrame | None = None, also: list[str] | None = None) -> DataFrame:
    """Calls of new lines in all columns of the provider's batch scan: claude, codex, pi or copilot.

    What a source carries survives from one batch to the next and a restart, until it is quiet for quiet_seconds (of
    processing time), or up to a sixteenth more; later lines start it anew. Repeated keys within a source are left out
    here, over sources by stream_dedup(). projects: as for scan_copilot(); also: as for scan_codex(), of codex alone.

    Sources are dealt by their hash to GROUPS groups. The new lines of a group in one batch are in a task's hands at a time,
    so that a source costs no frames and timers of its own, and the sources of a slot are read and stored together.
    """
    read = PROVIDERS[provider][0]
    rows = read(lines, projects) if provider == "copilot" else read(lines)
    own = {c: kind for c, kind in _KINDS.items() if c in rows.columns and c != "provider"}  # what all lines have alike is added below
    made = {"session_id", "project", "user_message", "user_ts", *(["tools"] if "tool" in own else [])}
    shown = {c: kind for c, kind in _OUT.items() if c in own or c in made}
    rows = rows.select(F.pmod(F.xxhash64("source_path"), F.lit(GROUPS)).alias("_group"), *_columns(rows, own))
    out = rows.groupBy("_group").transformWithStateInPandas(_Carry(provider, 1000 * quiet_seconds, list(own), list(shown)), ", ".join(f"{c} {kind}" for c, kind in shown.items()), "append", "processingTime")
    out = out.withColumns({"provider": F.lit(provider), "session_id": F.coalesce("session_id", logs.stem(F.col("source_path")))})
    out = out.select(*_columns(out, _OUT))
    return logs.codex_calls(out, also) if provider == "codex" else logs.as_calls(out)


def stream_dedup(calls: DataFrame, late: str = "2 days") -> DataFrame:
    """First call of a provider's key to arrive; keys older than the watermark are forgotten, which bounds the state.

    Calls without a key all stay. A call whose timestamp cannot be read is never late, and its key is forgotten soonest.
    """
    own = F.when(F.coalesce("dedup_key", F.lit("")) != "", F.col("dedup_key")).otherwise(F.concat_ws("\n", F.lit(""), "source_path", "line_no"))
    return calls.withColumn("_key", own).withWatermark("ts", late).dropDuplicatesWithinWatermark(["provider", "_key"]).drop("_key")


def stream_cost(calls: DataFrame, prices: DataFrame, fallback: DataFrame | None = None, models: DataFrame | None = None) -> DataFrame:
    """Adds cost_usd by a stream-static join with the prices of `models` (column model), by default of the names that have a price."""
    spark = calls.sparkSession
    if models is None:
        models = prices.select(F.col("key").alias("model"))
        models = models if fallback is None else models.union(fallback.select("key"))
    return with_cost(calls, prices, fallback, spark.createDataFrame(models.distinct().collect(), "model string"))


def stream_daily(calls: DataFrame) -> DataFrame:
    """Running totals of each day in the session's time zone, for output mode update or complete, as the batch's by_day() has them.

    The day is that of the call's own timestamp by the zone's clock, so it has 23 or 25 hours where the clock changes.
    Days are state as long as the query runs: one row a day. calls: with cost_usd, see stream_cost().
    """
    return calls.groupBy(local_day(F.col("ts_raw")).alias("day")).agg(
        F.sum("cost_usd").cast(MONEY).alias("cost_usd"), F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")]
    )


def each_batch(df: DataFrame, on_batch, checkpoint: str, seconds: int = 5, once: bool = False):
    """Starts a query that hands each batch to on_batch; every `seconds` (1 at least), or for what is there now."""
    writer = df.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(1, seconds)} seconds")).start()
