"""Recomputes a stored rollup when its sources change."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from callmeter.operators.incremental import incremental_load
from callmeter.sources.logs import latest_activity


def poll_refresh(find: Callable[[], DataFrame], parse: Callable[[DataFrame], DataFrame], path: str, seconds: float = 5, polls: int | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator[DataFrame]:
    """Yields the rollup of a store at `path` as it is at first, and again each time the newest change of its sources moves.

    find lists the sources (source_path, mtime, size) and reads none of them; parse is as for incremental_load(), which
    reads the changed ones alone. Polls come every `seconds`, 1 at least, for ever or `polls` times. A source that only
    goes away moves nothing: it drops out with the next change. Without sources there is nothing to yield.
    """
    latest = None
    for n in itertools.count() if polls is None else range(polls):
        if n:
            sleep(max(1.0, seconds))
        found = find()
        now = latest_activity(found).first()["latest"]
        if now is not None and now != latest:
            latest = now
            yield incremental_load(found, parse, path)
