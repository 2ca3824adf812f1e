"""The registered queries against their SQL, at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__
from callmeter.plans import log_queries, queries

SQL = queries.SQL | log_queries.SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(columns, values):
    def plain(x):
        return f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([plain(v[i]) for i in order] for v in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    got = (queries.QUERIES | log_queries.QUERIES)[name](spark, DATA)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["scan_codex", "stream_codex"])
def test_more_is_cached_than_read(spark, tmp_path, name):
    """A count of 5 tokens of input, 6 of them cached."""
    values = [(e, 1, kind, 0.0 if e % 2 else 3.5, k) for e, (kind, k) in enumerate([("view", 1), ("click", 6), ("signup", 2), ("purchase", 6), ("click", 13), ("click", 20)])]
    rows = spark.createDataFrame(values, "event_id long, user_id long, event_type string, value double, k int")
    rows.selectExpr("event_id", "timestamp_ntz '2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, event_id) AS ts", "user_id", "event_type", "value", "format_string('{\"k\": %d}', k) AS props").write.parquet(f"{tmp_path}/events.parquet")
    got = log_queries.QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(SQL[name])
    assert rows_of(got, want) and min(r["input_tokens"] for r in got.collect()) == -1


@pytest.mark.parametrize("kinds", [[], ["view"], ["click", "view", "purchase", "click"]])
def test_logs_of_few_events_are_streamed(spark, tmp_path, kinds):
    """No log has a line for each chunk."""
    rows = spark.createDataFrame([(e, e % 3, kind, 3.5, 6) for e, kind in enumerate(kinds)], "event_id long, user_id long, event_type string, value double, k int")
    rows.selectExpr("event_id", "timestamp_ntz '2024-01-01 10:00:00' AS ts", "user_id", "event_type", "value", "format_string('{\"k\": %d}', k) AS props").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows_of(log_queries.stream_codex(spark, str(tmp_path)), c.sql(SQL["stream_codex"]))


def rows_of(got, want):
    return rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_usage_reads_events_once(spark):
    plan = queries.QUERIES["daily_usage"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 6  # two are over the list of models


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
