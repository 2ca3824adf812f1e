"""Benchmark passages in documents, found by the q-gram lemma and proven by banded alignment.

Benchmark texts are cut into overlapping windows. A window that a document holds with at most k edits shares at least
m + 1 - q - k q of its q-grams with it, on diagonals that differ by no more than k. So shared q-grams are counted for
each window in overlapping bands of diagonals, of which one holds all of them; bands below the bound are dropped, the
others aligned. Nothing within the edit budget is lost.

Both sides are compared in lower case, with each run of white space as one space. Documents are streamed through Arrow
batches and never shuffled. Benchmark texts are a stated query set: they go to the tasks in blocks of bounded size, each
against all documents. Equal windows, of items with one prompt, are one; q-grams that many windows share are counted for a
part of the windows at a time, and bands are aligned a bounded number at a time, so that neither takes more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.llm.common import columns, row_ids, written

#: Characters of a window, and from one window of a text to the next.
WINDOW, STRIDE = 80, 40
#: A power of two.
Q = 8
#: Edits allowed, as a share of the window.
BUDGET = 0.1
#: Characters of benchmark texts that go to the tasks at a time; their index takes about 150 bytes for each in a worker.
BLOCK_CHARS = 1_000_000
#: Characters of documents that are looked at together.
TOGETHER = 1 << 17
#: Shared q-grams that are counted, and bands that are aligned, together.
POSTINGS, BANDS = 1 << 20, 1 << 13
_BASE = np.array(0x9E3779B97F4A7C15, np.uint64)
_GAP = 0x10FFFF  # stands between texts; no window has it


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(points: np.ndarray) -> np.ndarray:
    """Of the Q characters from each place on: of one, two, four and then eight."""
    out, base, k = points.astype(np.uint64), _BASE, 1
    while k < Q:
        n = max(0, len(out) - k)
        out = out[:n] * base + out[k : k + n]
        base, k = np.square(base, dtype=np.uint64), 2 * k
    return out ^ out >> np.uint64(29)


class Hit(NamedTuple):
    doc: int  # place among the documents given
    window: int  # of the index, which says what items have it
    start: int  # in the normalised document
    end: int
    edits: int


class Index:
    """Different windows of benchmark texts by their q-grams, and the items that have each."""

    def __init__(self, texts: list[str | None]):
        items: dict[bytes, list[int]] = {}
        for item, text in enumerate(texts):
            p = _points(normal(text))
            last = max(0, len(p) - WINDOW)
            for w in dict.fromkeys(p[a : a + WINDOW].tobytes() for a in sorted({*range(0, last + 1, STRIDE), last})) if len(p) else ():
                items.setdefault(w, []).append(item)
        self.items = list(items.values())
        self.windows = [np.frombuffer(w, np.uint32) for w in items]
        self.size = np.array([len(w) for w in self.windows], np.int64)
        self.edits = np.minimum((BUDGET * self.size).astype(np.int64), np.maximum(0, (self.size - Q) // Q))
        self.need = np.maximum(1, self.size + 1 - Q - self.edits * Q)
        grams = [_hashes(w) for w in self.windows]
        of = np.repeat(np.arange(len(grams), dtype=np.int64), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams] or [np.zeros(0, np.int32)])
        all_grams = np.concatenate(grams or [np.zeros(0, np.uint64)])
        order = np.argsort(all_grams, kind="stable")
        grams = []
        self.at = at[order]
        self.grams, number = np.unique(all_grams[order], return_inverse=True)
        self.posts = number.astype(np.int64) * len(self.windows) + of[order]  # ascending: by q-gram, then window
        self.shift = np.uint64(64 - 22)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.grams >> self.shift).astype(np.int64)] = True
        self.short = [k for k, n in enumerate(self.size.tolist()) if n < Q]  # no q-gram: found as they are

    def search(self, texts: list[str]) -> list[Hit]:
        """Windows within their budget in normalised texts."""
        hits: list[Hit] = []
        kept: dict[int, list[tuple[np.ndarray, ...]]] = {}
        held = begin = 0

        def aligned() -> None:
            for parts in kept.values():
                hits.extend(self._align(*(np.concatenate(x) for x in zip(*parts, strict=True))))
            kept.clear()

        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size < TOGETHER):
                size += len(texts[end])
                end += 1
            for found in self._regions(texts[begin:end], begin):
                kept.setdefault(found[0].shape[1], []).append(found)
                held += len(found[0])
                if held >= BANDS:
                    aligned()
                    held = 0
            begin = end
        aligned()
        for w in self.short:
            text = "".join(map(chr, self.windows[w].tolist()))
            for doc, x in enumerate(texts):
                p = f" {x} ".find(f" {text} ")
                if p >= 0:
                    hits.append(Hit(doc, w, p, p + len(text), 0))
        return hits

    def _shared(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of q-grams (their numbers): places in `at` and in the postings that go together, by ranges of windows that take no more than POSTINGS or are one window."""
        ranges = [(0, len(self.windows))]
        while ranges:
            low, high = ranges.pop()
            first, last = (np.searchsorted(self.posts, at * len(self.windows) + w) for w in (low, high))
            n = last - first
            total = int(n.sum())
            if total > POSTINGS and high - low > 1:
                ranges += [(low, (low + high) // 2), ((low + high) // 2, high)]
            elif total:
                row = np.repeat(np.arange(len(at)), n)
                yield row, first[row] + np.arange(total) - np.repeat(np.cumsum(n) - n, n)

    def _regions(self, texts: list[str], first_doc: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Pattern, region, window, doc and place in it, for bands that meet the bound, of one window size at a time."""
        size = np.array([len(x) + 1 for x in texts], np.int64)
        begin = np.cumsum(size) - size
        points = _points(chr(_GAP).join(texts) + chr(_GAP))
        hashes = _hashes(points)
        place = np.flatnonzero(self.maybe[(hashes >> self.shift).astype(np.int64)])
        if not len(place) or not len(self.grams):
            return
        got = hashes[place]
        at = np.minimum(np.searchsorted(self.grams, got), len(self.grams) - 1)
        real = self.grams[at] == got
        place, at = place[real], at[real]
        wide = int(self.edits.max(initial=0)) + 1  # a band has 2 * wide diagonals and starts wide after the one before
        span = (len(points) + 3 * WINDOW) // wide + 2
        for row, post in self._shared(at):
            window = self.posts[post] % len(self.windows)
            band = (place[row] - self.at[post] + WINDOW) // wide  # of a diagonal that is never negative
            keys, counts = np.unique(np.concatenate([window * span + band, window * span + np.maximum(band - 1, 0)]), return_counts=True)
            keys = keys[counts >= self.need[keys // span]]
            windows, diagonals = keys // span, (keys % span) * wide - WINDOW
            for m in np.unique(self.size[windows]).tolist():
                of_size = np.flatnonzero(self.size[windows] == m)
                for own in (of_size[k : k + BANDS] for k in range(0, len(of_size), BANDS)):
                    edge = int(self.edits[windows[own]].max())
                    from_ = diagonals[own] - edge
                    columns = from_[:, None] + np.arange(m + 2 * (wide + edge))
                    region = np.where((columns >= 0) & (columns < len(points)), points[np.clip(columns, 0, len(points) - 1)], _GAP)
                    # a band over the edge of a text belongs to the text that holds its middle
                    doc = np.searchsorted(begin, np.clip(from_ + edge + wide + m // 2, 0, len(points) - 1), side="right") - 1
                    outside = (columns < begin[doc][:, None]) | (columns >= (begin + size - 1)[doc][:, None])
                    region[outside] = _GAP
                    yield np.stack([self.windows[x] for x in windows[own].tolist()]), region, windows[own], doc + first_doc, from_ - begin[doc]

    def _align(self, pattern: np.ndarray, region: np.ndarray, windows: np.ndarray, docs: np.ndarray, from_: np.ndarray) -> Iterator[Hit]:
        """Bands that hold an alignment of the whole window within the budget, anywhere in the band."""
        for k in range(0, len(pattern), 512):
            p, r, budget = pattern[k : k + 512], region[k : k + 512], self.edits[windows[k : k + 512]]
            wide = r.shape[1] + 1
            ramp = np.arange(wide, dtype=np.int64)
            state = np.tile(ramp, (len(p), 1))  # cost * 4096 and the column where the alignment that ends here starts
            gap = np.where(r == _GAP, 3 * 4096, 4096)
            for i in range(p.shape[1]):
                best = state + 4096
                np.minimum(best[:, 1:], state[:, :-1] + np.where(r != p[:, i : i + 1], gap, 0), out=best[:, 1:])
                state = np.minimum.accumulate(best - ramp * 4096, axis=1) + ramp * 4096
            end = state.argmin(axis=1)
            least = state[np.arange(len(p)), end]
            for i in np.flatnonzero(least // 4096 <= budget).tolist():
                a = int(least[i] % 4096)
                if (r[i, a : end[i]] != _GAP).all():
                    at = int(from_[k + i])
                    yield Hit(int(docs[k + i]), int(windows[k + i]), at + a, at + int(end[i]), int(least[i] // 4096))


def _origins(text: str) -> list[int]:
    """For each character of normal(text), the place in text that it comes from."""
    out: list[int] = []
    for i, c in enumerate(text):
        if c.isspace():
            if out and out[-1] >= 0:
                out.append(-1 - i)
            continue
        if out and out[-1] < 0:
            out[-1] = -1 - out[-1]
        out += [i] * len(c.lower())
    return [x for x in out if x >= 0]


def passages(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start, end, edits, n_windows: the benchmark texts of which a document holds a window.

    start, end: code points of the document from the first to the last window found; edits: the fewest of a window.
    Null and empty texts on either side match nothing; a text of fewer than 8 characters is looked for between spaces.
    Repeated rows of docs give repeated results, of benchmark none but their own ids.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    parts = []
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        part = _search(docs, [r["item_id"] for r in own], [r["text"] for r in own])
        parts.append(written(part, "passages") if blocks > 1 else part)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


#: Results that a task holds before it passes them on.
ROWS = 1 << 16
FOUND = "item_id long, start long, end long, edits int, n_windows int"


#: The last index that a worker has built, by its texts.
_last: list[tuple[list[str], Index]] = []


def _index_of(texts: list[str]) -> Index:
    if not _last or _last[0][0] != texts:
        _last[:] = []  # the old one goes first
        _last[:] = [(texts, Index(texts))]
    return _last[0][1]


def _search(docs: DataFrame, ids: list[int | None], texts: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from callmeter.llm import decontaminate  # the worker's module, which keeps the index from one task to the next

        index = decontaminate._index_of(texts)

        def made(own: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2
            arrays = [own.take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "start", "end", "edits", "n_windows"])

        for batch in batches:
            own = batch.column("doc_id")
            rows: list[tuple] = []
            for begin in range(0, batch.num_rows, 128):
                raw = batch.column("text").slice(begin, 128).to_pylist()
                by_doc: dict[int, list[Hit]] = {}
                for h in index.search([normal(x) for x in raw]):
                    by_doc.setdefault(h.doc, []).append(h)
                for doc, found in sorted(by_doc.items()):
                    from_ = _origins(raw[doc])
                    by_item: dict[int, list[Hit]] = {}
                    for h in found:
                        for item in index.items[h.window]:
                            by_item.setdefault(item, []).append(h)
                    for item, hits in sorted(by_item.items()):
                        a, b = min(h.start for h in hits), max(h.end for h in hits)
                        rows.append((begin + doc, ids[item], from_[a], from_[b - 1] + 1, min(h.edits for h in hits), len({h.start for h in hits})))
                    if len(rows) > ROWS:
                        yield made(own, rows)
                        rows = []
            yield made(own, rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {FOUND}")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that hold no window of a benchmark text; of rows with one doc_id, each by itself."""
    rows, row = row_ids(docs)
    found = passages(rows.select(F.col(row).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(found, row, "left_anti").select(*columns(docs))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
