"""Loads of a store, over random changes, kills and compactions, against one whole load."""

import json
import random

import pytest
from pyspark.sql import functions as F

from callmeter.operators import incremental, pricing, reports
from callmeter.sources import logs, store


def log(r, n):
    for _ in range(n):
        use = {"usage": {"input_tokens": r.randrange(9), "output_tokens": 1}} if r.random() < 0.8 else {}
        yield {"type": "assistant", "timestamp": f"2024-01-0{r.randrange(1, 5)}T00:00:00Z", "message": {"id": r.choice([None, *[f"m{k}" for k in range(12)]]), "model": "claude-opus-4-7", "content": [], **use}}


class Logs:
    """Files that a test writes, and a parse that counts the sources it reads."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.parsed = spark, folder, []

    def write(self, r, name, n=8):
        path = self.folder / f"projects/p/{name}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(json.dumps(x, separators=(",", ":")) for x in log(r, n)))

    def found(self):
        return logs.sources(self.spark, str(self.folder / "projects/*/*.jsonl"))

    def lines(self, paths=None):
        return logs.scan_lines(self.spark, paths or str(self.folder / "projects/*/*.jsonl"))

    def priced(self, calls):
        return reports.with_day(pricing.with_cost(calls, pricing.fallback_prices(self.spark)))

    def parse(self, changed):
        paths = [r["source_path"] for r in changed.collect()]
        self.parsed.append(len(paths))
        rows = logs.claude_candidates(self.lines(paths or None))
        return self.priced(rows if paths else rows.limit(0))

    def whole(self):
        return plain(reports.session_days(self.priced(logs.scan_claude(self.lines()))))


def plain(rows):
    return sorted(tuple(r) for r in rows.select("source_path", "session_id", "day", F.col("cost_usd").cast("double"), "calls", *reports.TOKENS).collect())


def test_any_loads_are_one_whole_load(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "PARTS", 2)
    r, own, at = random.Random(7), Logs(spark, tmp_path), str(tmp_path / "store")
    names = [f"s{i}" for i in range(6)]
    for name in names[:4]:
        own.write(r, name)
    for step in range(4):
        assert plain(incremental.incremental_load(own.found(), own.parse, at)) == own.whole()
        for name in r.sample(names, 2):  # written, rewritten or gone
            own.write(r, name, 9 + step) if r.random() < 0.7 else (tmp_path / f"projects/p/{name}.jsonl").unlink(missing_ok=True)
        if step == 2:
            own.write(r, "empty", 0)
    assert plain(incremental.incremental_load(own.found(), own.parse, at)) == own.whole()
    assert own.parsed[0] == 4 and max(own.parsed[1:]) <= 3
    assert incremental.load_ledger(spark, at).count() == own.found().count()
    seen = len(own.parsed)
    assert not incremental.save_sessions(own.found(), own.parse, at) and len(own.parsed) == seen  # nothing changed
    assert len(store.names(spark, f"{at}/commits")) == 2 and len(store.names(spark, f"{at}/parts")) <= 2 * (incremental.PARTS + 1)


def test_size_follows_the_live_sources(spark, tmp_path):
    r, own, at = random.Random(8), Logs(spark, tmp_path), str(tmp_path / "store")
    for i in range(12):
        own.write(r, f"s{i}", 40)
    incremental.incremental_load(own.found(), own.parse, at)
    for i in range(1, 12):
        (tmp_path / f"projects/p/s{i}.jsonl").unlink()
    for n in (2, 3):
        own.write(r, "t", n)
        assert plain(incremental.incremental_load(own.found(), own.parse, at)) == own.whole()
    stored = incremental._stored(spark, at, incremental.load_ledger(spark, at)).count()
    on_disk = sum(spark.read.parquet(f"{at}/parts/{p}").count() for p in store.names(spark, f"{at}/parts"))
    assert stored == 43 and on_disk <= 2 * stored + 5


@pytest.mark.parametrize("step", ["parse", "rollup", "commit", "clean"])
def test_a_killed_load_leaves_the_one_before(spark, tmp_path, monkeypatch, step):
    r, own, at = random.Random(9), Logs(spark, tmp_path), str(tmp_path / "store")
    for name in ("a", "b"):
        own.write(r, name)
    before = plain(incremental.incremental_load(own.found(), own.parse, at))
    own.write(r, "b", 11)
    (tmp_path / "projects/p/a.jsonl").unlink()

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(*{"parse": (own, "parse"), "rollup": (incremental, "_first_days"), "commit": (store, "mark"), "clean": (incremental, "_clean")}[step], killed)
        with pytest.raises(KeyboardInterrupt):
            incremental.incremental_load(own.found(), own.parse, at)
    assert plain(incremental.load_sessions(spark, at)) == (own.whole() if step == "clean" else before)
    own.write(r, "c")
    assert plain(incremental.incremental_load(own.found(), own.parse, at)) == own.whole()
    assert len(store.names(spark, f"{at}/commits")) == 2


def test_a_day_is_not_a_file_of_each_task(spark, tmp_path):
    """The rollup of a day is small: its files do not grow in number with the tasks that count it."""
    r, own, at = random.Random(11), Logs(spark, tmp_path), str(tmp_path / "store")
    for k in range(12):
        own.write(r, f"s{k}", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert plain(incremental.incremental_load(own.found(), own.parse, at)) == own.whole()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    days = list((tmp_path / "store/commits").glob("*/usage_daily/day=*"))
    assert days and all(len(list(d.glob("*.parquet"))) == 1 for d in days)
