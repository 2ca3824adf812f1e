"""Language-model scores by a weighted backoff automaton.

The automaton has states of four levels. The state of a rare word, one that was learned and is not frequent, holds for the
token right behind it: its arcs are all words (and the end) that have followed it, at the discounted share (c - D2) / n; its
failure arc leads, at the weight that the discounts leave, to the state of the last frequent word that was read. That one's
arcs are all words (and the end) that have been read there, at (c - D2) / n; its failure arc leads to the root. The root has
an arc for each word that was learned, at (c - D) / N, and a failure arc, at D V / N, to the states that spell tokens. A
spelling state is a context of up to `ORDER` - 1 bytes of the token; its arcs read the bytes that have followed it, and its
failure arc leads to the context without its first byte: p = (c + M p_shorter) / (c_context + M). Bytes are counted over the
different words of each document, since what is spelled is rarely a frequent word. Rare words do not make the automaton
forget the last frequent one. One left-to-right traversal of each text carries the states and adds the log-probabilities; the
ways to read a token are added. All token sequences together have probability 1. D is n1 / (n1 + 2 n2), from the words seen
once and twice.

A word is frequent if it makes up a share of `FREQUENT` of the training tokens, so there are at most 1 / `FREQUENT` of them at
any size of the corpus, and only they are sent to all tasks. No task holds the rest of the model. `BLOCK_ROWS` rows of a
file are a block. A block sends the words, byte n-grams and pairs of words that occur in it, with how often they occur
in its training documents; each is dealt by its hash to one of many slices, whose group adds up what all blocks count of
it and gives every block the sums it asked for; and the block's documents meet them again (cogroup). So a block's
automaton has all arcs that its own texts can take and no others, and memory follows the block, not the corpus. The
number of slices grows with the bytes of the texts, so a slice's group stays about as large. Whatever is counted is sent
once a block at most, not once an occurrence, and what a block and a slice have for each other is one row.

Pairs with a rare word are sent as bits of hashes of their words, 63 of the first and 48 of the second (a frequent first word
by its number), and come back as counts alone, in the order of these. All pairs of a rare word meet in one slice, which says
how many different words follow it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.llm.common import remainder, row_ids, written

#: Bytes in the longest n-gram, and the weight of what a shorter context says.
ORDER, M = 5, 3.0
#: Share of the training tokens from which on a word is frequent, and the discount of the arcs of word states.
FREQUENT, D2 = 1e-5, 0.75
#: Share of the training tokens from which on a word is a state: 0 for all words; above 0 rarer words are none, and take no arcs.
SHARE = 0.0
#: Rows of a file in a block: a power of two.
BLOCK_ROWS = 4096
#: Marks that no UTF-8 has: before a text and after it.
BEGIN, END = 0xFE, 0xFF
#: Bytes that can follow a state; the lowest state deals what it leaves evenly to them.
SYMBOLS = 255
#: Bytes of a text that one lane of the traversal reads.
LANE = 2048
#: Bytes of text of a block, and tokens, that are in Arrow's and numpy's hands at a time.
CHUNK, TOKEN_CHUNK = 1 << 24, 1 << 20
#: Rows of the model that are joined up at a time.
PACK = 1 << 19
#: Different tokens that are spelled at a time.
SPELLED = 1 << 17
#: Slices that counts are dealt to: one for so many bytes of text, but at least so many. A state's pairs go to one in
#: STATE_SLICES of them.
SLICE_BYTES, SLICES, STATE_SLICES = 1 << 22, 512, 16
ALPHA = 0.1
#: What blocks count, by its first byte: words, the end, pairs of a word state and a frequent word or the end, tokens
#: after a word state, tokens and bytes that were spelled. Byte n-grams have their order as the first byte.
WORD, END_WORD, PAIR, AFTER, TOKENS, BYTES = b"w", b"e", b"p", b"h", b"t", b"s"


class Laid(NamedTuple):
    """Texts as one array of bytes: ORDER - 1 begin marks, the tokens, an end mark, for each."""

    data: np.ndarray
    start: np.ndarray  # of each text's first symbol
    size: np.ndarray  # symbols of each text, with the end


class Read(NamedTuple):
    """The tokens of texts: words (A-Z in lower case), cut at white space (space and U+0009 to U+000D)."""

    words: pa.Array  # the different ones, as bytes
    code: np.ndarray  # of each token, its place in words
    n: np.ndarray  # tokens of each text


def _pieces(texts: pa.ChunkedArray) -> Iterator[pa.Array]:
    """The texts in arrays of about CHUNK bytes; one longer text is an array of its own."""
    for whole in texts.chunks:
        wide = np.int64 if pa.types.is_large_string(whole.type) else np.int32
        at = np.frombuffer(whole.buffers()[1], wide)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else []
        begin = 0
        while begin < len(whole):
            end = max(begin + 1, int(np.searchsorted(at, int(at[begin]) + CHUNK, side="right")) - 1)
            yield whole.slice(begin, end - begin)
            begin = end


def read(texts: pa.ChunkedArray) -> Read:
    words, codes, sizes, before = [], [], [], 0
    for some in _pieces(texts):
        plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(some, "")))
        cut = pc.ascii_split_whitespace(plain)
        token = cut.flatten()  # an empty text is cut into one empty string
        sizes.append(np.where(pc.equal(plain, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(cut).to_numpy()).astype(np.int64))
        coded = token.filter(pc.not_equal(token, "")).dictionary_encode()
        words.append(coded.dictionary.cast(pa.large_binary()))
        codes.append(coded.indices.to_numpy().astype(np.int64) + before)
        before += len(coded.dictionary)
    if len(words) == 1:
        return Read(words[0], codes[0], sizes[0])
    all_of = pa.concat_arrays(words).dictionary_encode()
    return Read(all_of.dictionary, all_of.indices.to_numpy()[np.concatenate(codes)], np.concatenate(sizes))


def _parts(n: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Ranges of texts of about TOKEN_CHUNK tokens, and those of their tokens; one longer text is a range of its own."""
    ends = np.concatenate([[0], np.cumsum(n)])
    begin = 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + TOKEN_CHUNK, side="right")) - 1)
        yield slice(begin, end), slice(int(ends[begin]), int(ends[end]))
        begin = end


def _with_ends(of_token: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
    """Numbers of the tokens of texts, and `end` after each text."""
    out = np.full(len(of_token) + len(n), end, np.int64)
    out[np.arange(len(of_token)) + np.repeat(np.arange(len(n)), n)] = of_token
    return out


def _around(before: bytes, words: pa.Array, behind: bytes) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(before, words.type), words, pa.scalar(behind, words.type), pa.scalar(b"", words.type))


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word is among others; -1: nowhere."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy().astype(np.int64)


def lay(words: list[list[bytes]]) -> Laid:
    begin, end = bytes([BEGIN]) * (ORDER - 1), bytes([END])
    texts = [b"".join((begin, b" ".join(w), b" " if w else b"", end)) for w in words]
    length = np.array([len(x) for x in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64) + ORDER - 1
    return Laid(np.frombuffer(b"".join(texts), np.uint8), start, length - (ORDER - 1))


def _spelled(words: pa.Array) -> Iterator[tuple[slice, Laid]]:
    """Ranges of different words, and these and an end laid as tokens."""
    for k in range(0, max(len(words), 1), SPELLED):
        some = _around(b"", words.slice(k, SPELLED), b" ")
        data, at = _raw(some)
        data = np.concatenate([np.full(ORDER - 1, BEGIN, np.uint8), data[at[0] : at[-1]], np.array([END], np.uint8)])
        at = at - at[0] + ORDER - 1
        yield slice(k, k + len(some)), Laid(data, at, np.append(np.diff(at), 1))


def grams_at(laid: Laid) -> np.ndarray:
    """For each place, the ORDER bytes that end there, as one number; begin marks stand for bytes before the token."""
    out = laid.data.astype(np.int64)
    within = np.ones(len(out), bool)
    for k in range(1, ORDER):
        before = np.concatenate([np.full(k, BEGIN, np.uint8), laid.data])[: len(out)]
        within &= (before != 0x20) & (before != BEGIN)
        out |= np.where(within, before, BEGIN).astype(np.int64) << 8 * k
    return out


def _symbols(laid: Laid) -> np.ndarray:
    """The places of the bytes that are symbols of texts, text by text."""
    return np.arange(int(laid.size.sum())) + np.repeat(laid.start - (np.cumsum(laid.size) - laid.size), laid.size)


def _merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(grams, return_inverse=True)
    return grams, np.bincount(where, weights=counts, minlength=len(grams)).astype(np.int64)


def long_grams(laid: Laid, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-grams of some texts, and how often they occur if each text does so as often as `times` has it (below 2 ** 23)."""
    both = np.sort(grams_at(laid)[_symbols(laid)] << 23 | np.repeat(times, laid.size))
    first = np.flatnonzero(np.diff(both >> 23, prepend=-1))
    return both[first] >> 23, np.add.reduceat(both & (1 << 23) - 1, first) if len(first) else first


def shorter(grams: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per order from ORDER to 1: the n-grams, which are the ends of longer ones, and their counts."""
    for n in range(ORDER, 0, -1):
        yield n, grams, counts
        grams, counts = _merged(grams & ((1 << 8 * (n - 1)) - 1), counts)


#: What a block sends to a slice: its grams joined, their sizes (int32) and counts (int64).
ASKED = "slice long, block long, grams binary, sizes binary, counts binary"
#: With pairs of which a word is rare: their first words' ids, of each of these how many words follow it, and the ids (6 bytes) and
#: training counts (int32) of these.
ASKED_PAIRS = f"{ASKED}, heads binary, followed binary, followers binary, times binary"


def _fixed(raw: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, wide = raw.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * wide + 1, wide, dtype=np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def _dealt(key: np.ndarray, slices: int) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % slices


def _grouped(key: np.ndarray, grams: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """The different keys of grams, ascending, and for each key its grams joined, their sizes and counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    data, at = _raw(grams.take(pa.array(order)))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    joined = _joined(data[at[0] : at[-1]], at[cuts] - at[0]), _joined(np.diff(at).astype(np.int32), cuts * 4), _joined(counts[order], cuts * 8)
    return key[cuts[:-1]], *joined


def _sent(block: int, to: np.ndarray, grams: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    to, *joined = _grouped(to.astype(np.min_scalar_type(int(to.max()))), grams, counts)
    return pa.RecordBatch.from_arrays([pa.array(to.astype(np.int64)), pa.array(np.full(len(to), block, np.int64)), *joined], ["slice", "block", "grams", "sizes", "counts"])


def _words_asked(block: int, texts: pa.ChunkedArray, learn: np.ndarray, slices: int) -> Iterator[pa.RecordBatch]:
    tokens = read(texts)
    counts = np.bincount(tokens.code[np.repeat(learn, tokens.n)], minlength=len(tokens.words))
    to = np.fromiter(map(zlib.crc32, tokens.words.to_numpy(zero_copy_only=False)), np.int64, len(tokens.words)) % slices
    yield _sent(block, np.append(to, 0), pa.concat_arrays([_around(WORD, tokens.words, b""), pa.array([END_WORD], pa.large_binary())]), np.append(counts, learn.sum()))


def states_before(number: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """The word state before each token: the last frequent word of the text before it; -1: none.

    number: of the tokens of texts in a row, those of frequent words from 0 on, others below; n_tokens: of each text.
    """
    at = np.arange(len(number))
    last = np.maximum.accumulate(np.where(number >= 0, at, -1)) if len(number) else at
    before = np.concatenate([[-1], last[:-1]])[: len(number)]
    start = np.repeat(np.cumsum(n_tokens) - n_tokens, n_tokens)
    return np.where(before >= start, number[np.maximum(before, 0)], -1)


def _pairs(number: np.ndarray, state: np.ndarray, wide: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a word state and a frequent word or the end (number -2) after it, and how often they are in what `of` marks."""
    ahead = (state >= 0) & (number != -1)
    code = state[ahead] * wide + np.where(number[ahead] == -2, wide - 1, number[ahead])
    both, times = np.unique(code << 1 | of[ahead], return_counts=True)
    first = np.flatnonzero(np.diff(both >> 1, prepend=-1))
    return both[first] >> 1, np.add.reduceat(np.where(both & 1, times, 0), first) if len(first) else first


def _ids(words: pa.Array) -> np.ndarray:
    """64 bits of a hash of each word, and of the end, which is as no word is."""
    return hash_array(np.append(words.to_numpy(zero_copy_only=False), np.array([b""], object)), categorize=False)


def _rare_reads(word: np.ndarray, number: np.ndarray, state: np.ndarray, n: np.ndarray, frequent: int, wide: int) -> tuple[np.ndarray, ...]:
    """The tokens right behind a rare word, and the rare words behind a frequent one: their places, and with the word before as numbers.

    Frequent words are numbered as they are, rare ones from `frequent` on by their places among a block's different words.
    """
    behind = np.concatenate([[False], number[:-1] == -1])[: len(number)]
    behind[np.cumsum(n) - n] = False
    behind, rare = np.flatnonzero(behind), np.flatnonzero((number == -1) & (state >= 0))
    return behind, (frequent + word[behind - 1]) * wide + word[behind], rare, state[rare] * wide + word[rare]


def _dealt_pairs(pairs: np.ndarray, ids: np.ndarray, frequent: int, slices: int) -> tuple[np.ndarray, ...]:
    """The order of the pairs of _rare_reads() by their slice, the id of the first word and that of the second; and these three in it.

    All pairs of a rare word go to one slice, those of a frequent one to one in STATE_SLICES of them.
    """
    first, second = pairs // len(ids), pairs % len(ids)
    own, heads, followers = first >= frequent, first.astype(np.uint64), ids[second] >> np.uint64(16)
    heads[own] = ids[first[own] - frequent] | np.uint64(1 << 63)
    some = max(slices // STATE_SLICES, 1)
    to = np.where(own, _dealt(heads, slices), _dealt(first * some + (followers % np.uint64(some)).astype(np.int64), slices))
    order = np.lexsort((followers, heads, to))
    to, heads, followers = to[order], heads[order], followers[order]
    return order, to, heads, followers


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows of the columns differ from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = columns[0][1:] != columns[0][:-1]
    for c in columns[1:]:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _different(numbers: np.ndarray) -> np.ndarray:
    """Different numbers, ascending; by sorting, which takes a fifth of the time of np.unique()'s hashes."""
    numbers = np.sort(numbers)
    return numbers[_changes(numbers)]


def _pairs_sent(block: int, sent: pa.RecordBatch, pairs: np.ndarray, counts: np.ndarray, ids: np.ndarray, frequent: int, slices: int) -> pa.RecordBatch:
    """What a block sends, with its pairs: still one row a slice."""
    order, to, heads, followers = _dealt_pairs(pairs, ids, frequent, slices)
    counts = counts[order].astype("<i4")
    del order
    head, cut = _changes(to, heads), _changes(to)
    ends, of_head = np.append(cut, len(to)), np.append(np.searchsorted(head, cut), len(head))
    six = np.ascontiguousarray(followers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)
    joined = [_joined(heads[head].astype("<u8"), of_head * 8), _joined(np.diff(np.append(head, len(to))).astype("<i4"), of_head * 4), _joined(six, ends * 6), _joined(counts, ends * 4)]
    own = pa.array(to[cut].astype(np.int64))
    all_of = pc.unique(pa.concat_arrays([sent.column(0), own]))
    blank = lambda values, among: pc.fill_null(values.take(pc.index_in(all_of, value_set=among)), b"")
    columns = [blank(sent.column(k), sent.column(0)) for k in range(2, 5)] + [blank(j, own) for j in joined]
    return pa.RecordBatch.from_arrays([all_of, pa.array(np.full(len(all_of), block, np.int64)), *columns], [c.split()[0] for c in ASKED_PAIRS.split(", ")])


def _grams_asked(block: int, texts: pa.ChunkedArray, learn: np.ndarray, frequent: pa.Array, slices: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """whole: whether rare words are states, too."""
    tokens = read(texts)
    number_of = _places(tokens.words, frequent)
    wide = len(frequent) + 1  # the last number is the end's
    within = np.zeros(len(tokens.words), np.int64)  # documents to learn from that have each word
    after = np.zeros((2, len(frequent)), np.int64)
    pairs, pair_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rare, rare_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part, of_part in _parts(tokens.n):
        code, n, taught = tokens.code[of_part], tokens.n[part], learn[part]
        own = np.repeat(taught, n)
        in_text = np.sort(np.repeat(np.arange(len(n)), n)[own] * len(tokens.words) + code[own])
        within += np.bincount(in_text[np.diff(in_text, prepend=-1) > 0] % max(len(tokens.words), 1), minlength=len(tokens.words))
        number, of = _with_ends(number_of[code], n, -2), np.repeat(taught, n + 1)
        state = states_before(number, n + 1)
        after += np.stack([np.bincount(state[(state >= 0) & (of == y)], minlength=len(frequent)) for y in (True, False)])
        more, times = _pairs(number, state, wide, of)
        pairs, pair_counts = _merged(np.concatenate([pairs, more]), np.concatenate([pair_counts, times])) if len(pairs) else (more, times)
        if whole:
            behind, more, place, also = _rare_reads(_with_ends(code, n, len(tokens.words)), number, state, n + 1, len(frequent), len(tokens.words) + 1)
            rare, rare_counts = _merged(np.concatenate([rare, more, also]), np.concatenate([rare_counts, of[behind], of[place]]))
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    spelled = 0
    for some, laid in _spelled(tokens.words):
        times = np.append(within[some], 0 if some.start else learn.sum())
        spelled += int((times * laid.size).sum())
        more, times = long_grams(laid, times)
        grams, counts = _merged(np.concatenate([grams, more]), np.concatenate([counts, times]))
    asked, h, x = np.flatnonzero(after.sum(axis=0)), pairs // wide, pairs % wide
    some_states = max(slices // STATE_SLICES, 1)
    to = [np.zeros(2, np.int64), _dealt(asked, slices), _dealt(h * some_states + x % some_states, slices)]
    what = [pa.array([TOKENS, BYTES], pa.binary()), _fixed(_numbers(AFTER, asked)), _fixed(_numbers(PAIR, h, x))]
    times = [np.array([within.sum() + learn.sum(), spelled]), after[0][asked], pair_counts]
    for n, grams, counts in shorter(grams, counts):
        raw = np.empty((len(grams), n + 1), np.uint8)
        raw[:, 0] = n
        for k in range(n):
            raw[:, 1 + k] = grams >> 8 * (n - 1 - k) & 0xFF
        to.append(_dealt(grams << 3 | n, slices))
        what.append(_fixed(raw))
        times.append(counts)
    sent = _sent(block, np.concatenate(to), pa.concat_arrays(what), np.concatenate(times).astype(np.int64))
    del grams, counts, to, what, times
    yield _pairs_sent(block, sent, rare, rare_counts, _ids(tokens.words), len(frequent), slices)


def _numbers(kind: bytes, *columns: np.ndarray) -> np.ndarray:
    raw = [np.full((len(columns[0]), 1), kind[0], np.uint8)]
    return np.concatenate(raw + [c.astype(">u4").view(np.uint8).reshape(-1, 4) for c in columns], axis=1)


#: Many rows of the model: of a block, its n-grams joined, their sizes (int32) and counts (int64); or, without a block, of a
#: word state, its different arcs and the tokens that they read in training; or, without both, all words of a slice.
PACKED = "block long, grams binary, sizes binary, counts binary, state long, arcs long, seen long"


def _raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values, and where each begins and ends in them."""
    wide = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    at = np.frombuffer(values.buffers()[1], wide)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8), at


def _big_endian(data: np.ndarray, at: np.ndarray, wide: int) -> np.ndarray:
    """The `wide` bytes after each place as numbers."""
    out = np.zeros(len(at), np.int64)
    for k in range(wide):
        out = out << 8 | data[at + (1 + k)]
    return out


def _joined(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in data, cut at the ends (of bytes; the first is 0)."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _pack(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PACKED of rows block, gram, count, first (whether the row is the first of its gram)."""
    table = pa.Table.from_batches(parts)
    block, count, first = (table.column(c).to_numpy() for c in ("block", "count", "first"))
    grams = pa.concat_arrays(table.column("gram").chunks)
    blocks, *joined = _grouped(block, grams, count)
    none = pa.nulls(len(blocks), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(blocks), *joined, none, none, none], ["block", "grams", "sizes", "counts", "state", "arcs", "seen"])
    data, at = _raw(grams)
    own = np.flatnonzero(first & (count > 0) & (data[at[:-1]] == PAIR[0]))
    states, of, arcs = np.unique(_big_endian(data, at[own], 4), return_inverse=True, return_counts=True)
    seen = np.bincount(of, weights=count[own], minlength=len(states)).astype(np.int64)
    none, blank = pa.nulls(len(states), pa.int64()), pa.nulls(len(states), pa.binary())
    yield pa.RecordBatch.from_arrays([none, blank, blank, blank, pa.array(states), pa.array(arcs, pa.int64()), pa.array(seen)], ["block", "grams", "sizes", "counts", "state", "arcs", "seen"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, n = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            n += batch.num_rows
        if n >= PACK:
            yield from _pack(parts)
            parts, n = [], 0
            pa.default_memory_pool().release_unused()
    if parts:
        yield from _pack(parts)


#: With what a slice has of a block's pairs with a rare word, ascending by the ids of their words: how often they occur (int32);
#: and how many different words follow each first word of them there (int32).
ANSWERED = f"{PACKED}, slice long, follow binary, followers binary"


def _followed(asked: pa.Table) -> tuple[pa.Array, pa.Array, pa.Array, tuple[np.ndarray, ...]]:
    """Of what blocks sent to a slice: the blocks, and for each of them ANSWERED's follow and followers; and of frequent first words
    their numbers, different words after them and tokens that these read."""
    heads, sizes, six, times = (_Slice._whole(asked.column(c)) for c in ("heads", "followed", "followers", "times"))
    heads, sizes, times = heads.view("<u8"), sizes.view("<i4"), times.view("<i4").astype(np.int64)
    second = np.zeros((len(times), 8), np.uint8)
    second[:, :6] = six.reshape(-1, 6)
    second = second.view("<u8").reshape(-1)
    block = np.repeat(asked.column("block").to_numpy(), pc.binary_length(asked.column("heads")).to_numpy() // 8)
    block, first = np.repeat(block, sizes), np.repeat(heads, sizes)
    order = np.lexsort((second, first))
    block, first, second, times = block[order], first[order], second[order], times[order]
    pair = _changes(first, second)
    count = np.add.reduceat(times, pair) if len(pair) else times
    of = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(first))))
    head = _changes(first[pair])
    of_head = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(pair))))
    arcs, seen = (np.bincount(of_head, weights=w, minlength=len(head)).astype(np.int64) for w in (count > 0, count))
    blocks, at = np.unique(block, return_inverse=True)
    own = _different(at * max(len(pair), 1) + of)  # by block, and then by the words' ids
    at, of = own // max(len(pair), 1), own % max(len(pair), 1)
    heads = _changes(at, of_head[of])
    cuts = np.arange(len(blocks) + 1)
    follow = _joined(count[of].astype("<i4"), np.searchsorted(at, cuts) * 4)
    followers = _joined(arcs[of_head[of[heads]]].astype("<i4"), np.searchsorted(at[heads], cuts) * 4)
    names = first[pair[head]]
    known = (names < np.uint64(1 << 32)) & (arcs > 0)
    return pa.array(blocks, pa.int64()), follow, followers, (names[known].astype(np.int64), arcs[known], seen[known])


def _summed(asked: pa.Table) -> pa.RecordBatch:
    """Rows block, gram, count (what all blocks have of it), first (whether the row is the first of its gram) of a slice."""
    own = _Slice(asked)
    n = pc.binary_length(pc.cast(asked.column("sizes"), pa.large_binary())).to_numpy() // 4
    coded = own.grams().dictionary_encode()
    of = coded.indices.to_numpy()
    count = np.bincount(of, weights=own.count).astype(np.int64)[of]
    first = np.diff(np.maximum.accumulate(of), prepend=-1) > 0  # codes ascend with the places of their first rows
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(asked.column("block").to_numpy(), n)), own.grams(), pa.array(count), pa.array(first)], ["block", "gram", "count", "first"])


def _answered(asked: pa.Table) -> pa.Table:
    """ANSWERED of what blocks sent to a slice."""
    blocks, follow, followers, (states, arcs, seen) = _followed(asked)
    kinds = dict(zip(("block", "grams", "sizes", "counts", "state", "arcs", "seen"), [pa.int64(), *[pa.binary()] * 3, *[pa.int64()] * 3]))
    packed = pa.Table.from_batches(list(_packed(iter([_summed(asked)]))), pa.schema(kinds))
    own, found = packed.filter(pc.is_valid(packed.column("block"))), packed.filter(pc.is_null(packed.column("block"))).select(["state", "arcs", "seen"])
    found = pa.concat_tables([found, pa.table({"state": states, "arcs": arcs, "seen": seen})])
    all_of = pc.unique(pa.concat_arrays([*own.column("block").chunks, blocks]))
    with_grams, with_pairs = pc.index_in(all_of, value_set=own.column("block").combine_chunks()), pc.index_in(all_of, value_set=blocks)
    rows = {c: pc.fill_null(own.column(c).take(with_grams), b"") for c in ("grams", "sizes", "counts")}
    rows |= {"slice": pa.array(np.full(len(all_of), asked.column("slice")[0].as_py()), pa.int64())}
    rows |= {c: pc.fill_null(x.take(with_pairs), b"") for c, x in (("follow", follow), ("followers", followers))}
    kinds |= {"slice": pa.int64(), "follow": pa.binary(), "followers": pa.binary()}
    out = [pa.table({c: part.get(c, pa.nulls(n, kind)) for c, kind in kinds.items()}) for part, n in (({"block": all_of, **rows}, len(all_of)), ({c: found.column(c) for c in found.column_names}, len(found)))]
    pa.default_memory_pool().release_unused()
    return pa.concat_tables(out)


def _words_answered(asked: pa.Table) -> pa.Table:
    """As _answered(), with a row of the slice's words that were learned."""
    summed = _summed(asked)
    out = pa.Table.from_batches(list(_packed(iter([summed]))))
    known = summed.filter(pc.and_(summed.column("first"), pc.greater(summed.column("count"), 0)))
    if known.num_rows:
        _, *joined = _grouped(np.zeros(known.num_rows, np.int8), known.column("gram"), known.column("count").to_numpy())
        none = pa.nulls(1, pa.int64())
        out = pa.concat_tables([out, pa.Table.from_arrays([none, *joined, none, none, none], schema=out.schema)])
    pa.default_memory_pool().release_unused()
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, v, n1, n2 of slices of the vocabulary: tokens, different ones, and those seen once and twice."""
    for batch in batches:
        for counts in batch.column("counts").to_pylist():
            c = np.frombuffer(counts, np.int64)
            yield pa.RecordBatch.from_pydict({"n": [int(c.sum())], "v": [len(c)], "n1": [int((c == 1).sum())], "n2": [int((c == 2).sum())]})


def _often(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the words of slices of the vocabulary with a count of `least` at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, counts = _Slice(pa.Table.from_batches([batch.slice(k, 1)])).words()
                yield pa.RecordBatch.from_arrays([words.filter(pa.array(counts >= least)).cast(pa.binary())], ["word"])

    return run


class Automaton:
    """A block's part of the spelling states: failure-resolved arcs between the contexts that occur in its texts.

    States are contexts of ORDER - 1 bytes at most. `arcs` are pairs of a state and a byte that some text reads there;
    each has a log-probability and leads to a state.
    """

    def __init__(self, orders: dict[int, tuple[np.ndarray, np.ndarray]], tokens: int, size: int):
        """orders: of each n, the n-grams in ascending order and the corpus's counts of them; tokens, size: tokens and
        bytes that the corpus has spelled. A context is followed as often as it occurs as an n-gram, the empty one as
        often as there are bytes, and that of begin marks as often as there are tokens."""
        prob, below, count_below = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for n in range(1, ORDER + 1):
            grams, count = orders[n]
            if n == 1:
                lower, context = np.full(len(grams), 1 / SYMBOLS), np.full(len(grams), size)
            else:
                # the failure arc: what the context without its first byte gives, at the weight left for it
                lower = prob[np.searchsorted(below, grams & ((1 << 8 * (n - 1)) - 1))]
                starts = (grams >> 8 & 0xFF) == BEGIN
                at = np.minimum(np.searchsorted(below, grams >> 8), len(below) - 1)
                context = np.where(starts, tokens, count_below[at])
            prob, below, count_below = (count + M * lower) / (context + M), grams, count
        self.log_prob = np.log10(prob)
        mask = (1 << 8 * (ORDER - 1)) - 1
        root = int.from_bytes(bytes([BEGIN]) * (ORDER - 1))
        after = np.where((below & 0xFF == 0x20) | (below & 0xFF == END), root, below & mask)
        self.states, of = np.unique(np.concatenate([below >> 8, after]), return_inverse=True)
        self.target = of[len(below) :]
        self.arcs = of[: len(below)] << 8 | below & 0xFF  # ascending, as the n-grams are

    def log_probs(self, laid: Laid) -> np.ndarray:
        """log10 probability of each byte of laid.data that is a symbol of a text.

        Long texts go to several lanes; a lane starts in the state that its text is in there.
        """
        pieces = -(-laid.size // LANE)
        text = np.repeat(np.arange(len(pieces)), pieces)
        first = np.concatenate([[0], np.cumsum(pieces)[:-1]]).astype(np.int64)
        at = laid.start[text] + (np.arange(len(text)) - first[text]) * LANE
        size = np.minimum(LANE, laid.start[text] + laid.size[text] - at)
        by_size = np.argsort(-size, kind="stable")
        at, size = at[by_size], size[by_size]
        contexts = grams_at(laid)[at] >> 8
        state = np.searchsorted(self.states, contexts).astype(np.int64)
        out = np.zeros(len(laid.data))
        running = np.searchsorted(-size, -np.arange(1, size[0] + 1) if len(size) else [], side="right")
        for k, n in enumerate(running.tolist()):
            place = at[:n] + k
            arc = np.searchsorted(self.arcs, state[:n] << 8 | laid.data[place])
            out[place] = self.log_prob[arc]
            state[:n] = self.target[arc]
        return out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double"


class Totals(NamedTuple):
    """What all blocks know: sums of the words, and of each frequent word's arcs."""

    tokens: int
    types: int
    discount: float
    frequent: list[bytes]
    arcs: np.ndarray  # different arcs of each frequent word's state
    seen: np.ndarray  # tokens that they read in training
    slices: int
    whole: bool  # whether rare words are states, too


class _Slice:
    """A block's counts by kind."""

    def __init__(self, model: pa.Table):
        self.data, sizes, counts = (self._whole(model.column(c)) for c in ("grams", "sizes", "counts"))
        self.at = np.concatenate([[0], np.cumsum(sizes.view(np.int32), dtype=np.int64)])
        self.count = counts.view(np.int64)
        self.kind = self.data[self.at[:-1]]

    @staticmethod
    def _whole(column: pa.ChunkedArray) -> np.ndarray:
        data, at = _raw(pa.concat_arrays(column.chunks))
        return data[at[0] : at[-1]]

    def numbers(self, kind: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Of one kind: the `wide` bytes after the first as numbers, in ascending order, and their counts."""
        own = np.flatnonzero(self.kind == kind)
        out, first = np.unique(_big_endian(self.data, self.at[own], wide), return_index=True)
        return out, self.count[own][first]

    def grams(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self.count), [None, pa.py_buffer(self.at), pa.py_buffer(self.data)])

    def words(self) -> tuple[pa.Array, np.ndarray]:
        own = np.flatnonzero(self.kind == WORD[0])
        data, at = _raw(self.grams().take(pa.array(own)))
        names = pa.py_buffer(np.delete(data[at[0] : at[-1]], at[:-1] - at[0])), pa.py_buffer(at - at[0] - np.arange(len(at)))
        return pa.Array.from_buffers(pa.large_binary(), len(own), [None, names[1], names[0]]), self.count[own]

    def one(self, kind: bytes) -> int:
        return int(self.count[np.flatnonzero(self.kind == kind[0])[0]])


class _RarePairs:
    """A block's pairs with a rare word, as _rare_reads() numbers them, and what the slices have of them."""

    def __init__(self, pairs: np.ndarray, ids: np.ndarray, model: pa.Table, totals: Totals):
        frequent = len(totals.frequent)
        rows = model.filter(pc.is_valid(model.column("slice"))).sort_by("slice")
        count, arcs = (_Slice._whole(rows.column(c)).view("<i4") for c in ("follow", "followers"))
        order, to, heads, followers = _dealt_pairs(pairs, ids, frequent, totals.slices)
        pair, head = _changes(to, heads, followers), _changes(to, heads)
        del to, heads, followers
        if (len(pair), len(head)) != (len(count), len(arcs)):
            raise ValueError(f"a block has {len(pair)} pairs of {len(head)} words, its slices {len(count)} of {len(arcs)}")
        self.pairs, self.count, self.arcs = pairs, np.zeros(len(pairs), np.int32), np.zeros(len(ids), np.int32)
        self.count[order] = np.repeat(count, np.diff(np.append(pair, len(pairs))))
        first = pairs[order[head]] // len(ids) - frequent
        self.arcs[first[first >= 0]] = arcs[first >= 0]  # of rare words: they have one slice

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        return self.count[np.searchsorted(self.pairs, pairs)]


def _score_block(block: pa.Table, model: pa.Table, totals: Totals) -> pa.Table:
    learn = block.column("learn").to_pylist()
    tokens = read(block.column("text"))
    part_of = _Slice(model)
    names, counts = part_of.words()
    # of each different token, the end last
    count = np.append(counts[_places(tokens.words, names)], part_of.one(END_WORD)).astype(np.float64)
    frequent = pa.array(totals.frequent, pa.large_binary())
    state_of = np.append(_places(tokens.words, frequent), -2)
    wide = len(frequent) + 1
    pairs, pair_counts = part_of.numbers(PAIR[0], 8)
    pairs = (pairs >> 32) * wide + (pairs & 0xFFFFFFFF)
    states, after = part_of.numbers(AFTER[0], 4)
    n_after = np.zeros(wide)
    n_after[states] = after
    rest = np.zeros(wide - 1)
    rest[states] = np.log10((n_after[states] - totals.seen[states] + D2 * totals.arcs[states]) / np.maximum(n_after[states], 1))
    automaton = Automaton({n: part_of.numbers(n, n) for n in range(1, ORDER + 1)}, part_of.one(TOKENS), part_of.one(BYTES))
    left = totals.discount * totals.types / totals.tokens if totals.tokens else 1.0
    # how a token is spelled does not depend on what came before it: each different one is read once
    spelled = np.zeros(len(tokens.words) + 1)
    for some, laid in _spelled(tokens.words):
        read_of = np.add.reduceat(automaton.log_probs(laid)[_symbols(laid)], np.cumsum(laid.size) - laid.size)
        spelled[some], spelled[-1] = read_of[:-1], read_of[-1]
    del automaton, part_of, names
    # at the root: log10 of the two ways to read a token
    root_of = spelled + np.log10(left)
    known = count > 0
    root_of[known] = np.log10(np.maximum(count[known] - totals.discount, 0) / max(totals.tokens, 1) + 10.0 ** root_of[known])
    based = np.log10(count + ALPHA)

    def reads(part: slice, of_part: slice) -> tuple[np.ndarray, ...]:
        n = tokens.n[part] + 1
        word = _with_ends(tokens.code[of_part], tokens.n[part], len(count) - 1)
        token = state_of[word]
        state = states_before(token, n)
        return n, word, token, state, *_rare_reads(word, token, state, n, len(frequent), len(count))

    if totals.whole:
        asked = np.zeros(0, np.int64)
        for part, of_part in _parts(tokens.n):
            *_, more, _, also = reads(part, of_part)
            asked = _different(np.concatenate([asked, more, also]))
        rare = _RarePairs(asked, _ids(tokens.words), model, totals)
    out: dict[str, list] = {"n_tokens": [], "n_known": [], "log_counts": [], "score": []}
    for part, of_part in _parts(tokens.n):
        n, word, token, state, behind, after_rare, place, of_state = reads(part, of_part)
        first = np.cumsum(n) - n
        some = np.flatnonzero(state >= 0)
        h = state[some]
        way = root_of[word]
        way[some] += rest[h]
        ahead = token[some] != -1
        some, h = some[ahead], h[ahead]
        code = h * wide + np.where(token[some] == -2, wide - 1, token[some])
        c = pair_counts[np.searchsorted(pairs, code)]
        followed = c > 0
        way[some[followed]] = np.log10((c[followed] - D2) / n_after[h[followed]] + 10.0 ** way[some[followed]])
        if totals.whole:
            c = rare.counts(of_state)
            place, c = place[c > 0], c[c > 0]
            way[place] = np.log10((c - D2) / n_after[state[place]] + 10.0 ** way[place])
            own = count[word[behind - 1]] > 0  # of words that were learned
            behind, c = behind[own], rare.counts(after_rare[own])
            h = word[behind - 1]
            way[behind] = np.log10(np.maximum(c - D2, 0) / count[h] + D2 * rare.arcs[h] / count[h] * 10.0 ** way[behind])
        out["n_tokens"].append(n)
        out["n_known"].append(np.add.reduceat(known[word], first, dtype=np.int64))
        out["log_counts"].append(np.add.reduceat(based[word], first))
        out["score"].append(np.add.reduceat(way, first))
    pa.default_memory_pool().release_unused()
    ids = {"doc_id": block.column("doc_id"), "held_out": pa.array([not x for x in learn])}
    return pa.table(ids | {k: pa.array(np.concatenate(v)) for k, v in out.items()})


def _by_block(use: Callable[[int, pa.ChunkedArray, np.ndarray], Iterator[pa.RecordBatch]]) -> Callable:
    """For mapInArrow: use() on the rows (block, text, learn) of one block after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, learn = -1, [], []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if blocks[a] != now and texts:
                    yield from use(now, pa.chunked_array(texts), np.concatenate(learn))
                    texts, learn = [], []
                    pa.default_memory_pool().release_unused()
                now = int(blocks[a])
                texts.append(batch.column("text").slice(a, b - a))
                learn.append(batch.column("learn").slice(a, b - a).to_numpy(zero_copy_only=False))
        if texts:
            yield from use(now, pa.chunked_array(texts), np.concatenate(learn))

    return run


def score(docs: DataFrame, learn_mod: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id long, text).

    The model learns from rows whose crc32(doc_id as text) modulo learn_mod is not 0; a null id is held out. A null text
    is empty: it has the end token alone. Repeated rows count as often as they occur, other columns are ignored. With
    nothing to learn from, counts are 0 and the automaton deals evenly. What is no scan of Parquet files is written first.
    """
    rows, row = row_ids(docs)
    rows = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder("doc_id", learn_mod) != 0).alias("learn"), F.shiftright(row, BLOCK_ROWS.bit_length() - 1).alias("block")
    )
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    dealt = max(SLICES, size // SLICE_BYTES)
    asked = rows.select("block", "text", "learn").mapInArrow(_by_block(lambda b, texts, learn: _words_asked(b, texts, learn, dealt)), ASKED)
    words = written(asked.groupBy("slice").applyInArrow(_words_answered, PACKED), "lm-words")
    learned = words.filter("block IS NULL")
    total = learned.select("counts").mapInArrow(_sizes, "n long, v long, n1 long, n2 long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n1", "n2"))).first()
    n, v = int(total["n"]), int(total["v"])
    discount = (total["n1"] + 0.5) / (total["n1"] + 2 * total["n2"] + 1)
    whole = not SHARE
    often = learned.select("grams", "sizes", "counts").mapInArrow(_often((SHARE or FREQUENT) * n), "word binary").collect()
    frequent = sorted(bytes(r["word"]) for r in often)

    def grams(block: int, texts: pa.ChunkedArray, learn: np.ndarray) -> Iterator[pa.RecordBatch]:
        return _grams_asked(block, texts, learn, pa.array(frequent, pa.large_binary()), dealt, whole)

    asked = rows.select("block", "text", "learn").mapInArrow(_by_block(grams), ASKED_PAIRS)
    model = written(asked.groupBy("slice").applyInArrow(_answered, ANSWERED), "lm-slices")
    found = model.filter("block IS NULL").groupBy("state").agg(F.sum("arcs").alias("arcs"), F.sum("seen").alias("seen")).collect()  # a row for each frequent word at most
    of_state = np.zeros((2, len(frequent)))
    for r in found:
        of_state[:, r["state"]] = r["arcs"], r["seen"]
    totals = Totals(n, v, discount, frequent, of_state[0], of_state[1], dealt, whole)
    slices = words.unionByName(model, allowMissingColumns=True).filter("block IS NOT NULL").select("block", "grams", "sizes", "counts", "slice", "follow", "followers")
    scored = rows.groupBy("block").cogroup(slices.groupBy("block")).applyInArrow(lambda b, m: _score_block(b, m, totals), SCORED)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(n + ALPHA * (v + 1))))).alias("base_score"), "score",
    )


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
