"""Discovery by first lines, and the monitor of changes."""

import io
import json
import os
import random

import pytest
from test_incremental import Logs, plain

from callmeter.sources import heads, logs
from callmeter.streaming.refresh import poll_refresh


class Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


@pytest.mark.parametrize("data,skip,want", [(b"", False, None), (b"", True, None), (b"\n\n a \nb", True, b" a "), (b"\na", False, b""), (b"only", False, b"only"), (b" \n ", True, None), (b"x" * 200_000 + b"\ny", False, b"x" * 200_000)])
def test_first_line(data, skip, want):
    assert heads.first_line(io.BytesIO(data), skip) == want


def test_a_head_costs_no_more_in_a_longer_file():
    taken = []
    for n in (10**5, 10**7):
        file = Counted(b'{"type":"other"}\n' + b"x" * n)
        heads.first_line(file)
        taken.append(file.taken)
    assert taken == [heads.CHUNK] * 2


def test_discovery(spark, tmp_path):
    def put(path, *lines):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))

    meta = lambda who, **more: {"type": "session_meta", "payload": {"originator": who, **more}}
    put("c/sessions/2024/01/02/rollout-1.jsonl", meta("Codex_cli", cwd="/a b/c"), "x" * 300_000)
    put("c/sessions/2024/01/02/rollout-2.jsonl", meta("else"), meta("codex"), "x" * 300_000)
    put("c/sessions/2024/01/02/rollout-3.jsonl", "", meta("codex"))
    put("c/sessions/2024/01/02/rollout-4.jsonl", "{broken")
    put("c/sessions/2024/01/02/rollout-5.jsonl")
    put("c/sessions/2024/01/02/rollout-6.jsonl", meta("codex"))
    put("c/sessions/2024/01/02/other-7.jsonl", meta("codex"))
    got = heads.discover_codex(spark, str(tmp_path / "c"), tasks=3)
    assert sorted((r["source_path"].rsplit("/", 1)[1], r["project"]) for r in got.collect()) == [("rollout-1.jsonl", "a b-c"), ("rollout-6.jsonl", "")]
    assert sorted(r["source_path"].rsplit("/", 1)[1] for r in logs.scan_found(got).collect()) == ["rollout-1.jsonl", "rollout-1.jsonl", "rollout-6.jsonl"]
    assert logs.scan_found(got.limit(0)).count() == 0
    put("p/one/x.jsonl", " ", {"type": "session", "cwd": "/h/proj/"})
    put("p/two/y.jsonl", {"type": "session"})
    put("p/two/z.jsonl", {"type": "message"}, {"type": "session"})
    assert sorted((r["source_path"].rsplit("/", 1)[1], r["project"]) for r in heads.discover_pi(spark, str(tmp_path / "p")).collect()) == [("x.jsonl", "proj"), ("y.jsonl", "two")]


def test_refresh_parses_what_was_touched(spark, tmp_path):
    r, own, at, slept = random.Random(3), Logs(spark, tmp_path), str(tmp_path / "store"), []
    for i in range(5):
        own.write(r, f"s{i}")

    def sleep(seconds):
        slept.append(seconds)
        if len(slept) == 2:
            own.write(r, "s3", 20)
            os.utime(tmp_path / "projects/p/s3.jsonl", (2e9, 2e9))

    got = [plain(x) for x in poll_refresh(own.found, own.parse, at, seconds=0.2, polls=4, sleep=sleep)]
    assert len(got) == 2 and got[1] == own.whole() and own.parsed == [5, 1] and slept == [1.0] * 3
