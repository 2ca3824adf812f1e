"""Streams of logs that are cut anywhere against the batch scans of the whole logs."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from callmeter.operators import pricing, reports
from callmeter.sources import logs
from callmeter.streaming import calls as streaming


@pytest.fixture(autouse=True)
def store(spark):
    streaming.configure(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else the timers of states keep a query for what is there now alive
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def at(r, k):
    return f"2024-03-{9 + k % 3:02d}T{r.randrange(24):02d}:{k % 60:02d}:00Z"


def claude_log(r, n):
    for k in range(n):
        kind, ts = r.random(), at(r, k)
        if kind < 0.3:
            yield {"type": "user", "timestamp": ts, "message": {"content": r.choice(["do it", " ", [{"type": "text", "text": f"q{k}"}], [{"type": "tool_result"}]])}}
        elif kind < 0.9:
            use = {"usage": {"input_tokens": k, "output_tokens": 3, "cache_read_input_tokens": 2, "server_tool_use": {"web_search_requests": 1}, "speed": r.choice(["fast", "x"])}} if r.random() < 0.8 else {}
            content = [{"type": "tool_use", "name": "Bash", "input": {"command": "ls | wc"}}] if r.random() < 0.5 else []
            yield {"type": "assistant", "timestamp": ts, "message": {"id": r.choice([None, f"m{r.randrange(n)}"]), "model": r.choice(["claude-opus-4-7", "gpt-5", None]), "content": content, **use}}
        else:
            yield r.choice(["{broken", "", {"type": "summary"}])


def codex_log(r, n):
    yield {"type": "session_meta", "payload": {"originator": r.choice(["codex_cli", "Codex", "codex", "other"]), "cwd": "/a/b", "session_id": r.choice([None, "s"]), "model": r.choice([None, "gpt-5.4"])}}
    use = lambda: {"input_tokens": r.randrange(9), "cached_input_tokens": r.randrange(3), "output_tokens": r.randrange(9), "reasoning_output_tokens": r.randrange(3), "total_tokens": r.choice([0, 5, 7, r.randrange(99)])}
    for k in range(n):
        kind = r.random()
        if kind < 0.2:
            yield {"type": "response_item", "payload": {"type": "message", "role": r.choice(["user", "user", "assistant"]), "content": [{"type": r.choice(["input_text", "other"]), "text": f"t{k}"}]}}
        elif kind < 0.4:
            yield {"type": "response_item", "payload": {"type": "function_call", "name": r.choice(["exec_command", "own"])}}
        elif kind < 0.9:
            info = {"total_token_usage": r.choice([None, use(), use()]), "last_token_usage": r.choice([None, use()]), "model": r.choice([None, None, "gpt-4o"])}
            yield {"type": "event_msg", "timestamp": at(r, k), "payload": {"type": r.choice(["token_count", "token_count", "other"]), "info": r.choice([info, info, info, None])}}
        else:
            yield r.choice(["{broken", {"type": "session_meta", "payload": {"originator": "codex", "model": "gpt-5.3-codex", "session_id": "later"}}])


def pi_log(r, n):
    yield {"type": r.choice(["session", "session", "other"]), "id": "sid", "cwd": "/home/proj"}
    for k in range(n):
        if r.random() < 0.3:
            yield {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": r.choice([f"hi{k}", " "])}]}}
        else:
            use = {"input": r.randrange(3), "output": r.randrange(3), "cacheRead": 1} | ({"cacheWrite": 2} if r.random() < 0.8 else {})
            yield {"type": "message", "id": f"i{k}", "timestamp": at(r, k), "message": {"role": "assistant", "usage": use, "content": [{"type": "toolCall", "name": "bash", "arguments": {"command": "cd x; git log"}}]}}


def copilot_log(r, n):
    for k in range(n):
        yield r.choice([
            {"type": "session.model_change", "data": {"newModel": r.choice(["", "gpt-5", "claude-sonnet-4"])}}, {"type": "user.message", "data": {"content": f"u{k}"}},
            {"type": "assistant.message", "timestamp": at(r, k), "data": {"outputTokens": r.randrange(4), "messageId": r.choice(["", f"m{k}"]), "toolRequests": [{"name": "bash"}]}}, "{",
        ])


LOGS = {"claude": claude_log, "codex": codex_log, "pi": pi_log, "copilot": copilot_log}


def write_chunks(folder, sources, r, parts):
    """The lines of all sources in files, cut anywhere: a file has the next lines of some sources."""
    folder.mkdir()
    left = {path: list(enumerate(rows, 1)) for path, rows in sources.items()}
    for part in range(parts):
        (folder / f"{part:03d}.json").write_text("")
        with (folder / f"{part:03d}.json").open("w") as f:
            for path, rows in left.items():
                n = len(rows) if part == parts - 1 else r.randrange(len(rows) // 2 + 2)
                for line, value in rows[:n]:
                    f.write(json.dumps({"source_path": path, "line_no": line, "value": value}) + "\n")
                del rows[:n]


def plain(rows):
    return sorted(str(r.asDict()) for r in rows)


@pytest.mark.parametrize("provider", list(LOGS))
def test_stream_is_the_batch(spark, tmp_path, provider):
    r = random.Random(len(provider))
    sources = {f"/x/projects/p{i}/d{i}/s{i}.jsonl" if provider != "claude" else f"/x/projects/p{i}/s{i}.jsonl": [x if isinstance(x, str) else json.dumps(x, separators=(",", ":")) for x in LOGS[provider](r, 40)] for i in range(5)}
    if provider == "claude":
        sources = {k: [v.replace('"id":"m', f'"id":"{i}m') for v in rows] for i, (k, rows) in enumerate(sources.items())}
    write_chunks(tmp_path / "in", sources, r, 4)
    projects = spark.createDataFrame([("/x/projects/p1/d1", "named")], "directory string, project string") if provider == "copilot" else None
    all_lines = spark.read.schema(streaming.LINES).json(str(tmp_path / "in"))
    scan = {"claude": logs.scan_claude, "codex": logs.scan_codex, "pi": logs.scan_pi, "copilot": lambda x: logs.scan_copilot(x, projects)}[provider]
    want = scan(all_lines)
    got = []
    for stop in (1, 4):  # each is a query of its own, with the state of the one before
        (tmp_path / "now").mkdir(exist_ok=True)
        for k in range(stop):
            if not (tmp_path / f"now/{k:03d}.json").exists():
                (tmp_path / f"now/{k:03d}.json").write_text((tmp_path / f"in/{k:03d}.json").read_text())
                os.utime(tmp_path / f"now/{k:03d}.json", (1.7e9 + k, 1.7e9 + k))  # files are taken in the order of their times
        df = streaming.stream_calls(streaming.stream_lines(spark, str(tmp_path / "now"), 1), provider, 3600, projects)
        assert df.columns == want.columns == logs.CALL_COLUMNS
        streaming.each_batch(df, lambda b, _: got.extend(b.collect()), str(tmp_path / "ck"), once=True).awaitTermination()
    assert plain(got) == plain(want.collect()) and got


def test_daily_totals_by_the_zone(spark, tmp_path):
    """New York, over the night in which the clock goes forward: days, costs and tokens of the stream are those of the batch."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    times = ["2024-01-02T02:00:00Z", "2024-01-02T13:00:00Z", "2024-03-10T04:59:59Z", "2024-03-10T05:00:00Z", "2024-03-11T03:59:59Z", "2024-03-11T04:00:00Z", "2024-11-03T04:00:00Z", "2024-11-04T04:59:59Z", "short"]
    rows = [json.dumps({"type": "assistant", "timestamp": t, "message": {"id": f"m{i}", "model": ["claude-opus-4-7", "claude-opus-4-20250514", "none"][i % 3], "content": [], "usage": {"input_tokens": 10 + i, "output_tokens": 1}}}, separators=(",", ":")) for i, t in enumerate(times)]
    write_chunks(tmp_path / "in", {"/x/projects/p/s.jsonl": rows, "/x/projects/p/copy.jsonl": rows[:3]}, random.Random(1), 3)
    prices = pricing.fallback_prices(spark)
    names = spark.createDataFrame([("claude-opus-4-7",), ("claude-opus-4-20250514",)], "model string")
    calls = streaming.stream_calls(streaming.stream_lines(spark, str(tmp_path / "in"), 1), "claude", 3600)
    daily = streaming.stream_daily(streaming.stream_cost(streaming.stream_dedup(calls, "400 days"), prices, models=names))
    query = daily.writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = logs.scan_claude(spark.read.schema(streaming.LINES).json(str(tmp_path / "in")))
    want = reports.by_day(reports.with_day(pricing.with_cost(batch, prices)))
    money = F.col("cost_usd").cast("double").alias("cost_usd")
    got = {r["day"]: r for r in spark.table("daily").withColumn("cost_usd", money).collect()}
    assert got == {r["day"]: r for r in want.withColumn("cost_usd", money).select(*spark.table("daily").columns).collect()}
    assert {d: got[d]["calls"] for d in ("2024-01-01", "2024-01-02", "2024-03-09", "2024-03-10", "2024-03-11")} == {"2024-01-01": 1, "2024-01-02": 1, "2024-03-09": 1, "2024-03-10": 2, "2024-03-11": 1}


def test_quiet_sources_lose_their_state(spark, tmp_path):
    first = [json.dumps({"type": "user", "timestamp": "t", "message": {"content": "old"}}, separators=(",", ":"))]
    later = [json.dumps({"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "message": {"id": None, "model": "m", "usage": {"input_tokens": 1}}}, separators=(",", ":"))]
    (tmp_path / "in").mkdir()
    got = []
    for k, (line, rows) in enumerate([(1, first), (2, later)]):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps({"source_path": "s", "line_no": line, "value": v}) for v in rows))
        if k:
            (tmp_path / "in/9.json").write_text(json.dumps({"source_path": "other", "line_no": 1, "value": first[0]}))
        df = streaming.stream_calls(streaming.stream_lines(spark, str(tmp_path / "in"), 1), "claude", 3600)
        streaming.each_batch(df, lambda b, _: got.extend(b.collect()), str(tmp_path / "ck"), once=True).awaitTermination()
    assert [r["user_message"] for r in got] == ["old"]


class FakeStore:
    """The state of one group, and how often it is asked."""

    def __init__(self):
        self.maps, self.timers, self.calls = {}, set(), 0

    def getMapState(self, name, *_):  # noqa: N802
        return self.Map(self, self.maps.setdefault(name, {}))

    def listTimers(self):  # noqa: N802
        return iter([(t,) for t in self.timers])

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    class Map:
        def __init__(self, store, rows):
            self.store, self.rows = store, rows

        def _called(self, out):
            self.store.calls += 1
            return out

        def getValue(self, k):  # noqa: N802
            return self._called(self.rows.get(k))

        def updateValue(self, k, v):  # noqa: N802
            self._called(self.rows.update({k: v}))

        def containsKey(self, k):  # noqa: N802
            return self._called(k in self.rows)

        def removeKey(self, k):  # noqa: N802
            self._called(self.rows.pop(k))

        def iterator(self):
            return self._called(iter(list(self.rows.items())))

        def keys(self):
            return self._called(iter(list(self.rows)))


class Now:
    def __init__(self, ms):
        self.getCurrentProcessingTimeInMs = lambda: ms


def claude_frame(lines):
    named = ["source_path", "line_no", "said", "said_ts", "dedup_key", "emits", "live"]
    return pd.DataFrame([dict(zip(named, x)) for x in lines], dtype=object)


def carried(store, quiet_ms=1000):
    own = streaming._Carry("claude", quiet_ms, ["source_path", "line_no", "said", "said_ts", "dedup_key", "emits", "live"], ["source_path", "line_no", "user_message"])
    own.init(store)
    return own, lambda ms, *frames: [x for df in own.handleInputRows((0,), iter(frames), Now(ms)) for x in df.itertuples(index=False, name=None)]


def test_sources_of_a_group_share_calls_of_the_store():
    store = FakeStore()
    _, take = carried(store)
    says, answers = ([(f"s{i}", n, f"t{i}" if n == 1 else None, "", "", n == 2, n == 2) for i in range(500)] for n in (1, 2))
    assert take(0, claude_frame(says[:200]), claude_frame(says[200:])) == []
    assert store.calls <= 2 * streaming.SLOTS + 1 and len(store.timers) == 1
    assert sorted(take(10, claude_frame(answers))) == sorted((f"s{i}", 2, f"t{i}") for i in range(500))


def test_each_source_of_a_group_is_quiet_by_itself():
    store = FakeStore()
    own, take = carried(store)
    said = lambda s, n, text: (s, n, text, "", None, False, False)
    called = lambda s, n, key=None: (s, n, None, None, key, True, True)
    take(0, claude_frame([said(s, 1, "old") for s in "abc"] + [called("a", 2, "k"), called("c", 2, "k")]))
    take(900, claude_frame([called("c", 3)]))
    assert store.timers == {1000}
    assert list(own.handleExpiredTimer((0,), Now(1000), None)) == []  # a and b are gone with their keys, c is not
    assert store.timers == {1000, 1900} and set(store.maps["keys"]) == {("c", "k")}
    assert sorted(take(1100, claude_frame([called(s, 4, "k") for s in "abc"] + [called(s, 5) for s in "bc"]))) == [("a", 4, ""), ("b", 4, ""), ("b", 5, ""), ("c", 5, "old")]
    assert list(own.handleExpiredTimer((0,), Now(9000), None)) == [] and not store.maps["logs"] and not store.maps["keys"]
