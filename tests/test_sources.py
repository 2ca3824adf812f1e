import datetime as dt
import json
import random
import re

import pytest

from callmeter.operators import classify, incremental, ordered, pricing, reports
from callmeter.sources import logs
from callmeter.streaming import calls as streaming


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, separators=(",", ":")) for r in rows) + "\n")


def user(text, ts):
    return {"type": "user", "timestamp": ts, "message": {"content": text}}


def answer(i, ts, usage=True, blocks=(), model="claude-opus-4-7", **more):
    m = {"id": i, "model": model, "content": list(blocks)}
    if usage:
        m["usage"] = {"input_tokens": 10, "output_tokens": 5, **more}
    return {"type": "assistant", "timestamp": ts, "message": m}


@pytest.fixture
def claude(spark, tmp_path):
    bash = {"type": "tool_use", "name": "Bash", "input": {"command": "cd x && npm test"}}
    write(tmp_path / "projects/p1/s1.jsonl", [
        user("[not json", "2024-01-01T00:00:00Z"), answer("a", "2024-01-01T00:00:01Z", blocks=[bash, {"type": "tool_use", "name": "Edit"}]), "", "{broken", {"type": "other"},
        {"type": "user", "timestamp": "t", "message": {"content": [{"type": "tool_result"}]}}, answer("b", "2024-01-01T00:00:02Z", usage=False), answer("b", "2024-01-01T00:00:03Z"),
        user([{"type": "text", "text": "two"}, {"type": "text", "text": "blocks"}], "2024-01-01T00:01:00Z"), answer(None, "2024-01-01T00:01:01Z", speed="fast"), answer(None, "2024-01-01T00:01:02Z"),
    ])
    write(tmp_path / "projects/p2/s2.jsonl", [answer("a", "2024-01-02T00:00:00Z"), answer("c", "2024-01-02T00:00:01Z", server_tool_use={"web_search_requests": 2})])
    return tmp_path


def test_claude(spark, claude):
    got = logs.scan_claude(logs.scan_lines(spark, str(claude / "projects/*/*.jsonl"))).orderBy("source_path", "line_no").collect()
    assert [(r["project"], r["session_id"], r["line_no"], r["dedup_key"], r["user_message"], r["speed"]) for r in got] == [
        ("p1", "s1", 2, "a", "[not json", "standard"), ("p1", "s1", 10, None, "two blocks", "fast"), ("p1", "s1", 11, None, "two blocks", "standard"), ("p2", "s2", 2, "c", "", "standard"),
    ]
    assert got[0]["tools"] == ["Bash", "Edit"] and got[0]["bash_commands"] == ["npm"] and got[3]["web_search_requests"] == 2


def test_discovery_and_status(spark, claude):
    for path in ("projects/p1/s1/subagents/a.jsonl", "desk/deep/projects/p9/x.jsonl", "node_modules/projects/p8/x.jsonl", "projects/p1/s1/other/b.jsonl", "a/b/c/d/e/f/g/h/i/projects/p7/x.jsonl"):
        write(claude / path, [answer("q" + path, "2024-01-02T00:00:00Z")])
    found = sorted((r["source_path"].split(str(claude))[1][1:], r["project"]) for r in logs.discover_claude(spark, str(claude)).collect())
    assert found == [("desk/deep/projects/p9/x.jsonl", "p9"), ("projects/p1/s1.jsonl", "p1"), ("projects/p1/s1/subagents/a.jsonl", "p1"), ("projects/p2/s2.jsonl", "p2")]
    lines = logs.scan_lines(spark, str(claude / "projects/*/*.jsonl"))
    rows = reports.status_utc(pricing.with_cost(logs.status_claude(lines), pricing.fallback_prices(spark)), dt.date(2024, 1, 2)).first()
    assert (rows["today_calls"], rows["week_calls"], rows["month_calls"]) == (1, 4, 4)
    assert reports.period_utc("today", dt.date(2024, 7, 2), "America/New_York") == ("2024-07-02T04:00:00", "2024-07-03T03:59:59")
    assert logs.latest_activity(logs.sources(spark, str(claude / "projects/*/*.jsonl"))).first()["latest"] is not None


def test_costs_and_turns(spark, claude):
    calls = logs.scan_claude(logs.scan_lines(spark, str(claude / "projects/*/*.jsonl")))
    priced = reports.with_day(pricing.with_cost(calls, pricing.fallback_prices(spark)))
    cost = {r["line_no"]: float(r["cost_usd"]) for r in priced.filter("project = 'p1'").collect()}
    assert cost == pytest.approx({2: 175e-6, 10: 6 * 175e-6, 11: 175e-6})
    turns = classify.turns(priced).orderBy("source_path", "turn_no").collect()
    assert [(t["n_calls"], t["category"]) for t in turns] == [(1, "Coding"), (2, "Conversation"), (1, "Conversation")]


def count(total=None, last=None, ts="t"):
    return {"type": "event_msg", "timestamp": ts, "payload": {"type": "token_count", "info": {"total_token_usage": total, "last_token_usage": last}}}


def test_codex(spark, tmp_path):
    meta = {"type": "session_meta", "payload": {"originator": "Codex_cli", "cwd": "/a/b", "session_id": "s", "model": "gpt-5.4"}}
    tool = lambda n: {"type": "response_item", "payload": {"type": "function_call", "name": n}}
    said = {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do it"}]}}
    full = lambda i, o, t, c=0: {"input_tokens": i, "output_tokens": o, "cached_input_tokens": c, "reasoning_output_tokens": 0, "total_tokens": t}
    write(tmp_path / "sessions/2024/01/01/rollout-1.jsonl", [
        meta, said, tool("exec_command"), count(full(100, 10, 110, 40), None, "t1"), count(full(100, 10, 110, 40), None, "t1b"), tool("own"), count(full(0, 0, 0), full(0, 0, 0), "t2"),
        count(full(300, 30, 330, 40), full(7, 3, 10), "t3"), count(full(150, 20, 170, 40), None, "t4"), count(full(50, 5, 55, 0), None, "t5"),
    ])
    write(tmp_path / "sessions/2024/01/01/rollout-2.jsonl", [{"type": "session_meta", "payload": {"originator": "other"}}, count(full(1, 1, 2))])
    got = logs.scan_codex(logs.scan_lines(spark, str(tmp_path / "sessions/*/*/*/rollout-*.jsonl"))).orderBy("line_no").collect()
    assert [(r["ts_raw"], r["input_tokens"], r["cached_input_tokens"], r["output_tokens"], r["tools"], r["user_message"]) for r in got] == [
        ("t1", 60, 40, 10, ["Bash"], "do it"), ("t3", 7, 0, 3, ["own"], ""), ("t4", 50, 0, 10, [], ""),
    ]
    assert {(r["project"], r["session_id"], r["model"]) for r in got} == {("a-b", "s", "gpt-5.4")}


def test_pi(spark, tmp_path):
    use = {"input": 1, "output": 2, "cacheRead": 3, "cacheWrite": 4}
    call = lambda **m: {"type": "message", "message": {"role": "assistant", "model": "gpt-5", "usage": use, **m}}
    write(tmp_path / "d/x.jsonl", [
        {"type": "session", "id": "sid", "cwd": "/home/proj"}, {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "hi"}]}},
        call(responseId="r", content=[{"type": "toolCall", "name": "bash", "arguments": {"command": "ls | wc"}}]), call() | {"id": "i"}, call(), call(usage={"input": 1, "output": 1, "cacheRead": 0}),
    ])
    got = logs.scan_pi(logs.scan_lines(spark, str(tmp_path / "d/*.jsonl"))).orderBy("line_no").collect()
    assert [(r["dedup_key"].rsplit(":", 1)[1], r["tools"], r["bash_commands"], r["user_message"]) for r in got] == [("r", ["Bash"], ["ls", "wc"], "hi"), ("i", [], [], ""), ("4", [], [], "")]
    assert {(r["project"], r["session_id"], r["cache_write_tokens"]) for r in got} == {("proj", "sid", 4)}


def test_copilot(spark, tmp_path):
    say = lambda n, i: {"type": "assistant.message", "timestamp": "t", "data": {"outputTokens": n, "messageId": i, "toolRequests": [{"name": "bash"}]}}
    write(tmp_path / "s9/events.jsonl", [say(5, "early"), {"type": "session.model_change", "data": {"newModel": "m"}}, {"type": "user.message", "data": {"content": "q"}}, say(0, "none"), say(7, "ok")])
    (tmp_path / "s9/workspace.yaml").write_text("id: 1\ncwd: '/w/proj'  # here\n")
    got = logs.scan_copilot(logs.scan_lines(spark, str(tmp_path / "*/events.jsonl")), logs.copilot_projects(spark, str(tmp_path / "*/workspace.yaml"))).collect()
    assert [(r["project"], r["session_id"], r["model"], r["output_tokens"], r["user_message"], r["tools"], r["dedup_key"]) for r in got] == [("proj", "s9", "m", 7, "q", ["Bash"], "copilot:s9:ok")]


def test_opencode(spark):
    session = spark.createDataFrame([("s", "/a/b", "t", 1, None, None), ("old", "", "t", 1, 5, None), ("kid", "", "t", 1, None, "s")], "id string, directory string, title string, time_created long, time_archived long, parent_id string")
    said = json.dumps({"role": "user"})
    message = spark.createDataFrame([("m1", "s", 1_700_000_000, said), ("m2", "s", 1_700_000_001_000 // 1000, json.dumps({"role": "assistant", "modelID": "x", "cost": 0.5, "tokens": {"input": 0, "output": 0}})), ("m3", "s", 1_700_000_002_000, json.dumps({"role": "assistant", "cost": 0}))], "id string, session_id string, time_created long, data string")
    part = spark.createDataFrame([("p1", "s", "m1", json.dumps({"type": "text", "text": "go"})), ("p2", "s", "m2", json.dumps({"type": "tool", "tool": "bash", "state": {"input": {"command": "ls"}}}))], "id string, session_id string, message_id string, data string")
    calls = logs.scan_opencode(session, message, part)
    got = pricing.with_cost(calls, pricing.fallback_prices(spark)).collect()
    assert [(r["project"], r["user_message"], r["tools"], r["bash_commands"], float(r["cost_usd"]), r["ts_raw"]) for r in got] == [("a-b", "go", ["Bash"], ["ls"], 0.5, "2023-11-14T22:13:21.000Z")]


def test_cursor(spark):
    b = lambda k, **v: (f"bubbleId:{k}", json.dumps(v))
    kv = spark.createDataFrame([
        b(1, type=1, createdAt="2024-02-01", conversationId="c", text="q1"), b(2, type=2, createdAt="2024-02-02", conversationId="c", text="a1", tokenCount={"inputTokens": 5, "outputTokens": 1}, codeBlocks=[{"languageId": "py"}, {"languageId": "plaintext"}]),
        b(3, type=2, createdAt="2024-02-03", conversationId="c", tokenCount={"inputTokens": 0, "outputTokens": 9}), b(4, type=2, createdAt="2024-02-04", conversationId="c", tokenCount={"inputTokens": 5, "outputTokens": 1}), b(5, type=1, createdAt="2020-01-01", conversationId="c", text="old"), ("other", "{}"),
    ], "key string, value string")
    got = logs.scan_cursor(kv, "2024-01-01").orderBy("line_no").collect()
    cost = pricing.with_cost(logs.scan_cursor(kv, "2024-01-01"), pricing.fallback_prices(spark)).orderBy("line_no").first()["cost_usd"]
    assert float(cost) == pytest.approx(5 * 3e-6 + 1 * 15e-6)
    assert [(r["user_message"], r["tools"], r["model"]) for r in got] == [("q1 a1", ["cursor:edit", "lang:py"], "default"), ("", [], "default")]


def test_prices(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"v/m": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6}, "zero": {"input_cost_per_token": 0, "output_cost_per_token": 0}, "half": {"input_cost_per_token": 1e-6}, "new-model-9": {"input_cost_per_token": 3e-6, "output_cost_per_token": 1e-6, "provider_specific_entry": {"fast": 6}}}))
    prices = pricing.scan_prices(spark, str(tmp_path / "p.json"))
    got = {r["key"]: r for r in prices.collect()}
    assert sorted(got) == ["m", "new-model-9", "v/m"] and float(got["m"]["cache_write"]) == 1.25e-6 and float(got["new-model-9"]["fast"]) == 6
    names = spark.createDataFrame([(x,) for x in ("m", "new-model-9-x", "new-model", "claude-opus-4-9", "gpt-5.4-mini-x", "nothing")], "model string")
    found = {r["model"]: r["key"] for r in pricing.resolve_price(names, prices, pricing.fallback_prices(spark)).collect()}
    assert found == {"m": "m", "new-model-9-x": "new-model-9", "new-model": "new-model-9", "claude-opus-4-9": "claude-opus-4", "gpt-5.4-mini-x": "gpt-5.4-mini"}


def test_rates(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"code": "EUR", "rate": 0.5}\n{"code": "USD", "rate": 7}\n{"code": "GBP"}\n{"code": "ABC", "rate": 2, "symbol": "@"}\n')
    table = pricing.scan_rates(spark, str(tmp_path / "r.json"))
    assert {tuple(r) for r in table.collect()} == {("EUR", 0.5, "€"), ("USD", 1.0, "$"), ("GBP", 1.0, "£"), ("ABC", 2.0, "@")}
    one = spark.createDataFrame([(1.239,)], "c double")
    assert [tuple(pricing.in_currency(one, table, c).first())[1:] for c in ("EUR", "XYZ")] == [("EUR", 0.5, "€"), ("XYZ", 1.0, "XYZ")]


def test_exports(spark, claude, tmp_path):
    calls = reports.with_day(pricing.with_cost(logs.scan_claude(logs.scan_lines(spark, str(claude / "projects/*/*.jsonl"))), pricing.fallback_prices(spark))).cache()
    day = dt.date(2024, 1, 2)
    incremental.export_csv(calls, day, str(tmp_path / "csv"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "csv/summary/rows")).collect()} >= {"Today,0.02,1,1"}
    incremental.export_json(calls, day, 'n"ow', str(tmp_path / "json"))
    whole = joined(tmp_path / "json")
    assert whole["generated"] == 'n"ow'
    incremental.export_json(calls.limit(0), day, "now", str(tmp_path / "none"))
    assert joined(tmp_path / "none")["projects"] == []
    assert whole["periods"]["7 Days"]["summary"]["calls"] == "4" and {p["project"] for p in whole["projects"]} == {"p1", "p2"}
    assert json.loads(incremental.status_json(calls, day).first()["value"])["month"]["calls"] == 4


def joined(folder):
    """The document that the files of the manifest are one after the other."""
    names = sorted((json.loads(x) for f in (folder / "manifest").glob("part-*") for x in f.read_text().splitlines()), key=lambda x: x["place"])
    assert all((folder / x["file"]).stat().st_size == x["bytes"] for x in names)
    return json.loads("".join((folder / x["file"]).read_text() for x in names))


def test_export_json_is_written_by_many_tasks(spark, tmp_path):
    n = 100_000
    calls = spark.range(n).selectExpr("'s' AS source_path", "concat('x', id) AS session_id", "concat('p\"', id) AS project", "'2024-01-02' AS day", "CAST(id % 1000 AS decimal(28,12)) AS cost_usd")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        incremental.export_json(calls, dt.date(2024, 1, 2), "now", str(tmp_path / "json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    listed = [p["project"] for p in joined(tmp_path / "json")["projects"]]
    assert listed == sorted((f'p"{i}' for i in range(n)), key=lambda p: (-(int(p[2:]) % 1000), p))
    parts = [len(f.read_text().splitlines()) for f in (tmp_path / "json/projects").glob("part-*")]
    assert len(parts) == 4 and max(parts) < n / 2  # as many as the shuffle has; ranges of the order


def test_retries(spark):
    def retries(tools):
        rows = [("s", "x", "t", i, t, "u", "m", "d", "p", 0) for i, t in enumerate(tools)]
        df = spark.createDataFrame(rows, "source_path string, session_id string, ts_raw string, line_no long, tools array<string>, user_ts string, user_message string, day string, project string, cost_usd int")
        return classify.turns(df).first()["retries"]

    assert retries([["Edit"], ["Bash"], ["Edit"], ["Bash"], ["Edit"]]) == 2
    assert retries([["Edit"], ["Bash"]]) == 0
    assert retries([["Edit", "Bash"], ["Edit"]]) == 1


def test_turns_in_pieces(spark):
    r = random.Random(6)
    rows = [(r.choice("ab"), r.choice(["x", "y", None]), r.choice([None, "", "short", *[f"2024-01-0{d}T0{h}:1{h}:00Z" for d in (1, 2) for h in range(5)]]), i, r.choice(["", "", None, "u1", "u2", "u2"])) for i in range(400)]
    df = spark.createDataFrame(rows, "source_path string, session_id string, ts_raw string, line_no long, user_ts string")
    want = sorted(map(tuple, ordered.with_turns(df).collect()), key=str)
    for chars in (13, 10, 3, 30):
        got = ordered.with_turns_in_pieces(df, chars)
        assert sorted(map(tuple, got.collect()), key=str) == want
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    assert all("_piece" in x for x in windows) and len(windows) >= 3


def test_null_keys_are_all_kept(spark):
    rows = [("a", "f1", 1, "k"), ("a", "f2", 1, "k"), ("b", "f1", 2, "k"), ("a", "f1", 3, None), ("a", "f1", 4, None), ("a", "f1", 5, "")]
    df = spark.createDataFrame(rows, "provider string, source_path string, line_no long, dedup_key string")
    assert sorted(tuple(r)[:3] for r in ordered.dedup_calls(df).collect()) == [("a", "f1", 1), ("a", "f1", 3), ("a", "f1", 4), ("a", "f1", 5), ("b", "f1", 2)]


def test_streaming(spark, tmp_path):
    streaming.configure(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else the timeouts of states keep a query for what is there now alive
    lines = [user("first", "2024-01-01T00:00:00Z"), answer("a", "2024-01-01T00:00:01Z"), "{broken"]
    later = [answer("b", "2024-01-01T00:00:02Z"), answer("a", "2024-01-01T00:00:03Z")]
    src, got = tmp_path / "in", []

    def chunk(name, rows, start):
        src.mkdir(exist_ok=True)
        text = "\n".join(json.dumps({"source_path": "s", "line_no": start + i, "value": r if isinstance(r, str) else json.dumps(r)}) for i, r in enumerate(rows))
        (src / name).write_text(text)

    def run():
        df = streaming.stream_dedup(streaming.stream_calls(streaming.stream_lines(spark, str(src)), "claude", 3600))
        streaming.each_batch(df, lambda b, _: got.extend(b.collect()), str(tmp_path / "ck"), once=True).awaitTermination()

    chunk("1.json", lines, 1)
    run()
    chunk("2.json", later, 4)
    run()
    assert sorted((r["dedup_key"], r["user_message"]) for r in got) == [("a", "first"), ("b", "first")]


def test_lines_are_numbered_by_split(spark, tmp_path):
    r = random.Random(3)
    whole = {}
    for i in range(5):
        lines = [r.choice(["", " ", "x" * r.randrange(200), "é" * r.randrange(30)]) for _ in range((0, 1, 300, 900, 400)[i])]
        (tmp_path / f"{i}.jsonl").write_bytes("\n".join(lines).encode())
        whole |= {(f"{i}.jsonl", n): x for n, x in enumerate(lines, 1) if x.strip(" ")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = logs.scan_lines(spark, str(tmp_path / "*.jsonl"))
        assert {(x["source_path"].rsplit("/", 1)[1], x["line_no"]): x["value"] for x in rows.collect()} == whole
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window") == 1 and "Window [sum(_n" in plan  # over splits
        assert rows.rdd.getNumPartitions() > 15
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_prices_by_prefix(spark):
    """Against every name compared with every key."""
    r = random.Random(4)
    name = lambda: "-".join(r.choice(["a", "b", "ab", "1"]) for _ in range(r.randrange(4)))
    tables = [{name(): ("0.1", "0.2", "0", "0", 1) for _ in range(25)} for _ in range(2)]
    models = sorted({name() + r.choice(["", "", "x", "@v", "-20250101"]) for _ in range(300)})
    own, other = (pricing.price_table(spark, t) for t in tables)
    table = pricing.resolve_price(spark.createDataFrame([(m,) for m in [*models, None]], "model string"), own, other)

    def brute(model):
        n = re.sub("-[0-9]{8}$", "", model.split("@")[0])
        tiers = [
            [k for k in tables[0] if k == n], [k for k in tables[1] if k == n], [k for k in tables[1] if n.startswith(k + "-")],
            [k for k in tables[0] if n and (n.startswith(k) or k.startswith(n))], [k for k in tables[1] if n.startswith(k)],
        ]
        return next((min(t, key=lambda k: (-len(k), k)) for t in tiers if t), None)

    assert {x["model"]: x["key"] for x in table.collect()} == {m: brute(m) for m in models if brute(m) is not None}
    assert "NestedLoop" not in table._jdf.queryExecution().executedPlan().toString()


def test_repeated_keys_go_before_the_shuffle(spark, tmp_path):
    spark.range(0, 4000, 1, 1).selectExpr("'claude' AS provider", "'s' AS source_path", "id AS line_no", "concat('k', id % 5) AS dedup_key", "repeat('x', 50) AS text").write.parquet(str(tmp_path / "calls"))
    rows = ordered.dedup_calls(spark.read.parquet(str(tmp_path / "calls")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(x["line_no"] for x in rows.collect()) == [0, 1, 2, 3, 4]
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
