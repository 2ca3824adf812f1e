import pytest
from pyspark.sql import functions as F

from callmeter.functions import scalar
from callmeter.operators.classify import classify_turn

SHELL = [
    ("ls", ["ls"]), ("git add . && git commit -m x", ["git", "git"]), ("cat a | grep b", ["cat", "grep"]), ("make; make test", ["make", "make"]), ("/usr/bin/python3 x.py", ["python3"]),
    ("cd /tmp && ls", ["ls"]), ('echo "a && b"', ["echo"]), ("", []), ("   ", []), ("a | b | c && d", ["a", "b", "c", "d"]), ("FOO=1 node x", ["node"]), ("A=1 B=2 npm test", ["npm"]),
    ("true && false", []), (None, []), ("x" * 200_000 + " && ls", ["x" * 200_000, "ls"]),
]


def test_shell_commands(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(SHELL)], "i int, c string")
    got = {r["i"]: r["s"] for r in df.select("i", scalar.shell_commands(F.col("c")).alias("s")).collect()}
    assert [got[i] for i in range(len(SHELL))] == [w for _, w in SHELL]


TURNS = [
    ("please change it", ["Edit"], "Coding"), ("fix the error", ["Edit"], "Debugging"), ("add a page", ["Edit"], "Feature Dev"), ("refactor this", ["Edit"], "Refactoring"), ("npm test", ["Bash"], "Testing"),
    ("git push", ["Bash"], "Git Ops"), ("npm run build", ["Bash"], "Build/Deploy"), ("look", ["Read", "Grep"], "Exploration"), ("x", ["EnterPlanMode"], "Planning"), ("x", ["Agent"], "Delegation"),
    ("what if we wait", [], "Brainstorming"), ("hello", [], "Conversation"), ("see main.py", [], "Coding"), ("https://example.org", [], "Exploration"), ("x", ["TodoWrite"], "Planning"), ("x", ["Skill"], "General"),
    ("prefix_it", [], "Conversation"), ("éfix it", [], "Debugging"), (None, [], "Conversation"), ("x", ["mcp__a__b"], "Exploration"),
]


def test_classify(spark):
    df = spark.createDataFrame([(i, m, t) for i, (m, t, _) in enumerate(TURNS)], "i int, m string, t array<string>")
    got = {r["i"]: r["c"] for r in df.select("i", classify_turn(F.col("m"), F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(TURNS))] == [w for _, _, w in TURNS]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, want", [("a@20250101", "a"), ("a-b-20250101", "a-b"), ("plain", "plain"), ("a-2025", "a-2025")])
def test_canonical_model(spark, value, want):
    assert one(spark, value, scalar.canonical_model) == want


@pytest.mark.parametrize("value, want", [("claude-opus-4-7-20260101", "Opus 4.7"), ("claude-opus-4-20250514", "Opus 4"), ("gpt-5.4-mini", "GPT-5.4 Mini"), ("own", "own")])
def test_short_model(spark, value, want):
    assert one(spark, value, scalar.short_model) == want


@pytest.mark.parametrize("value, want", [("=1", "'=1"), ("+1", "'+1"), ("-1", "'-1"), ("@a", "'@a"), ("plain", "plain"), ("a,b", '"a,b"'), ('a"b', '"a""b"'), ("=a,b", "\"'=a,b\"")])
def test_csv_safe(spark, value, want):
    assert one(spark, value, scalar.csv_safe) == want


@pytest.mark.parametrize(
    "value, want",
    [("2024-03-10T03:30:00Z", "2024-03-09"), ("2024-03-10T12:00:00+00:00", "2024-03-10"), ("2024-03-10T03:30:00.123Z", "2024-03-09"), ("2024-03-10T03:30:00", "2024-03-09"), ("2024-03-10", "2024-03-10"), ("2024-11-03T05:30:00Z", "2024-11-03"), ("x", "x")],
)
def test_local_day(spark, value, want):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, value, scalar.local_day) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_formats(spark):
    assert [one(spark, x, scalar.format_cost, "double") for x in (12.345, 0.5, 0.001)] == ["$12.35", "$0.500", "$0.0010"]
    assert [one(spark, x, scalar.format_tokens, "long") for x in (999, 1500, 2_500_000)] == ["999", "1.5K", "2.5M"]
    assert one(spark, "/home/me/a/b/c/d", lambda c: scalar.short_project(c, "/home/me")) == "b/c/d"
    assert one(spark, "/a/b", scalar.short_project) == "a/b"
    assert [one(spark, x, lambda c: scalar.epoch_to_ts(c).cast("long"), "long") for x in (1_700_000_000, 1_700_000_000_000)] == [1_700_000_000] * 2
    assert one(spark, "mcp__github__search", scalar.mcp_server) == "github" and one(spark, "mcp__", scalar.mcp_server) == "mcp__"
    assert [one(spark, x, scalar.valid_currency) for x in ("EUR", "eur", "EURO")] == [True, False, False]
