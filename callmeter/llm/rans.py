"""Static range asymmetric numeral system over interleaved lanes, in numpy.

One table of frequencies serves all blocks. In a block, symbol number t * lanes + j belongs to step t of lane j; all
lanes take a step at a time and share one stream of 32-bit words. The states before every `SECTION`th step are kept as
checkpoints, each with its place in the words and the checksum of the symbols up to the next one. A reader takes all
sections of a block at once, as rows of one array, or any section alone.

Block: HEAD, then per section (first word, crc32 of its symbols as little-endian u32), then its states (u64 a lane), then
the words. The head has a checksum of itself, the index and the states, and one of the words; besides, a section must
end in the states of the next one, and the last in the state that encoding began with.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np

#: Magic, crc32 of the table, symbols, lanes, steps, sections, words, crc32 of the words, crc32 of head (with 0 here), index and states.
HEAD = struct.Struct("<4sIQIIIIII")
MAGIC = b"rAN2"
#: States stay within [LOW, LOW << 32).
LOW = np.uint64(1 << 31)
SECTION = 128
MAX_LANES = 2048
_32 = np.uint64(32)


class Table(NamedTuple):
    bits: int
    freq: np.ndarray  # of each symbol; the sum is 1 << bits
    first: np.ndarray  # sum of the frequencies before it
    crc: int


def table(counts: np.ndarray) -> Table:
    """Frequencies of 2 ** bits in all, at least 1 for each symbol that occurs. counts: per symbol, over the corpus."""
    counts = np.trim_zeros(np.asarray(counts, np.int64), "b")
    used = np.flatnonzero(counts)
    bits = int(min(24, max(12, int(len(used)).bit_length() + 4)))
    freq = np.zeros(len(counts), np.int64)
    if len(used):
        room = (1 << bits) - len(used)
        exact = counts[used] / counts.sum() * room
        freq[used] = 1 + np.floor(exact).astype(np.int64)
        rest = (1 << bits) - int(freq.sum())
        freq[used[np.argsort(np.floor(exact) - exact, kind="stable")[:rest]]] += 1
    first = np.concatenate([[0], np.cumsum(freq)[:-1]])
    return Table(bits, freq.astype(np.uint64), first.astype(np.uint64), zlib.crc32(freq.astype("<u4").tobytes()))


def encode(symbols: np.ndarray, t: Table) -> bytes:
    """One block. All symbols must occur in the table."""
    n = len(symbols)
    if n and int(np.max(symbols)) >= len(t.freq):
        raise ValueError("a symbol is missing from the table")
    lanes = int(min(MAX_LANES, max(1, n // 512)))
    steps = -(-n // lanes)
    padded = np.full(steps * lanes, int(np.argmax(t.freq)) if n else 0, np.int64)
    padded[:n] = symbols
    freq, first = t.freq[padded].reshape(steps, lanes), t.first[padded].reshape(steps, lanes)
    if n and not freq.all():
        raise ValueError("a symbol is missing from the table")
    bits = np.uint64(t.bits)
    limit = freq << np.uint64(63 - t.bits)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    count = 0
    for k in range(steps - 1, -1, -1):
        full = x >= limit[k]
        if full.any():
            words.append(x[full].astype(np.uint32))
            count += len(words[-1])
            x = np.where(full, x >> _32, x)
        q = x // freq[k]
        x = (q << bits) + (x - q * freq[k]) + first[k]
        if k % SECTION == 0:
            marks.append((count, x.copy()))
    marks.reverse()
    stream = (np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)).astype("<u4").tobytes()
    size = SECTION * lanes
    crcs = [zlib.crc32(np.asarray(symbols[i * size : (i + 1) * size]).astype("<u4").tobytes()) for i in range(len(marks))]
    fields = (MAGIC, t.crc, n, lanes, steps, len(marks), count, zlib.crc32(stream))
    index = b"".join([struct.pack("<II", count - c, crc) for (c, _), crc in zip(marks, crcs, strict=True)] + [m.astype("<u8").tobytes() for _, m in marks])
    return b"".join([HEAD.pack(*fields, zlib.crc32(index, zlib.crc32(HEAD.pack(*fields, 0)))), index, stream])


class Reader:
    """Blocks of one table back to symbols."""

    def __init__(self, t: Table):
        self.t = t
        self.symbol = np.repeat(np.arange(len(t.freq)), t.freq.astype(np.int64)).astype(np.uint32)

    def sections(self, block: bytes) -> int:
        return HEAD.unpack_from(block)[5]

    def decode(self, block: bytes, section: int | None = None) -> np.ndarray:
        """Symbols of a block, or of one section of it. Raises ValueError where something does not fit."""
        if len(block) < HEAD.size:
            raise ValueError("not a block of this table")
        *fields, crc = HEAD.unpack_from(block)
        magic, of_table, n, lanes, steps, sections, count, words_crc = fields
        if magic != MAGIC or of_table != self.t.crc:
            raise ValueError("not a block of this table")
        at = HEAD.size + 8 * sections * (1 + lanes)
        if zlib.crc32(block[HEAD.size : at], zlib.crc32(HEAD.pack(*fields, 0))) != crc or len(block) != at + 4 * count:
            raise ValueError("the index of a block is damaged")
        index = np.frombuffer(block, "<u4", 2 * sections, HEAD.size).reshape(sections, 2)
        states = np.frombuffer(block, "<u8", lanes * sections, HEAD.size + 8 * sections).reshape(sections, lanes)
        words = np.frombuffer(block, "<u4", count, at)
        if section is None and zlib.crc32(words.tobytes()) != words_crc:
            raise ValueError("the words of a block are damaged")
        first, last = (0, sections) if section is None else (section, section + 1)
        ends = np.vstack([states[1:], np.full((1, lanes), LOW)])[first:last] if sections else states
        if first == last:
            return np.zeros(0, np.uint32)
        got = self._sections(states[first:last].astype(np.uint64), ends, words, index[first:last, 0].astype(np.int64), min(SECTION, steps - (last - 1) * SECTION))
        got = got[: n - first * SECTION * lanes]
        for s in range(first, last):
            own = got[(s - first) * SECTION * lanes : (s + 1 - first) * SECTION * lanes]
            if zlib.crc32(own.astype("<u4").tobytes()) != int(index[s, 1]):
                raise ValueError("a section of a block is damaged")
        return got

    def _sections(self, x: np.ndarray, ends: np.ndarray, words: np.ndarray, at: np.ndarray, last_steps: int) -> np.ndarray:
        """Symbols of neighbouring sections, all of SECTION steps but the last. x: their states, at: their next words."""
        t, (rows, lanes) = self.t, x.shape
        out = np.empty((rows, SECTION, lanes), np.uint32)
        bits, mask = np.uint64(t.bits), np.uint64((1 << t.bits) - 1)
        padded = np.append(words, np.uint32(0))
        for k in range(SECTION):
            if k == last_steps:  # the last one has ended
                rows -= 1
                if (x[-1] != ends[rows]).any():
                    raise ValueError("a section of a block is damaged")
                x, at = x[:-1], at[:-1]
                if not rows:
                    break
            slot = x & mask
            out[:rows, k] = sym = self.symbol[slot]
            x = t.freq[sym] * (x >> bits) + slot - t.first[sym]
            low = x < LOW
            place = at[:, None] + np.cumsum(low, axis=1) - 1
            x = np.where(low, (x << _32) | padded[np.minimum(np.where(low, place, 0), len(words))], x)
            at = at + low.sum(axis=1)
        if rows and (x != ends[:rows]).any():
            raise ValueError("a section of a block is damaged")
        return out.reshape(-1, lanes)[: (len(out) - 1) * SECTION + last_steps].ravel()
