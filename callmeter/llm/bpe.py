"""Byte-level BPE over Arrow batches with the tokenizers library.

The library runs the merges. Where no two white characters of a text are neighbours, cutting it before each of its
spaces and newlines cannot split a piece of the pattern; Arrow cuts such texts and numbers their distinct parts. Only
parts that are new to the worker are split by the pattern, many in one string, and only their distinct pieces go to the
library, again in one string: the cost of a call is paid once for thousands of pieces. The ids of a text are gathered
from those of its parts by numpy. Other texts go to the pattern whole.

Bytes are written as characters by the usual table of byte-level BPE (`BYTE_CHARS`). Decoding reverses it; a character
whose bytes lie in two tokens is whole again because bytes are joined before they are read as UTF-8.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, models, pre_tokenizers

#: Parts that a worker keeps; then it starts anew.
CACHE = 250_000
#: Bytes of texts that are looked up together; a longer text is looked up alone.
TOGETHER = 1 << 23


def _byte_chars() -> list[str]:
    """The character of each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in same)
    return [chr(x) for _, x in sorted([(b, b) for b in same] + [(b, 0x100 + k) for k, b in enumerate(rest)])]


BYTE_CHARS = _byte_chars()
#: No UTF-8 has this byte; between pieces it stands for a newline.
_BETWEEN = b"\xff"
_TO_CHARS = {b: ord(c) for b, c in enumerate(BYTE_CHARS)} | {0xFF: 0x0A}
_TO_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}
_WHITE = r"\x09-\x0D\x1C-\x20\x{85}\p{Z}"
#: Two white characters in a row (as the split pattern knows them, and some more), for Arrow.
_TWO_WHITE = f"[{_WHITE}][{_WHITE}]"
_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
#: Strings that are one piece; that are a piece and a mark; that can share a call of the pattern.
_ONE, _MARKED, _PLAIN = f"^ ?{_LATIN}+$", f"^ ?{_LATIN}+[.,;:!?]$", f"^ ?[^{_WHITE}]+$"


def _list(x: pa.Array) -> list:
    """As to_pylist(), for arrays without nulls, but faster."""
    return x.to_numpy(zero_copy_only=False).tolist()


def as_chars(data: bytes) -> str:
    return "".join(BYTE_CHARS[b] for b in data)


def as_bytes(token: str) -> bytes:
    return bytes(_TO_BYTES[c] for c in token)


class Encoder:
    """Texts to token ids (as little-endian bytes of `dtype`), and back."""

    def __init__(self, model: models.BPE, token_bytes: list[bytes], pattern: str):
        self.pattern = regex.compile(pattern)
        self.token_bytes = token_bytes
        self.token_chars = [as_chars(x) for x in token_bytes]
        self.dtype = np.dtype("<u2" if len(token_bytes) <= 1 << 16 else "<u4")
        self.token_size = np.array([len(x) for x in token_bytes], np.int64)
        self.merger = Tokenizer(model)
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")  # no byte is written as a newline
        self.parts: dict[str, bytes] = {}

    def _merge(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        out: list[bytes] = []
        for k in range(0, len(pieces), 20_000):
            some = pieces[k : k + 20_000]
            data = [x.encode("utf-8", "replace") for x in some]
            joined = _BETWEEN.join(data).decode("latin-1").translate(_TO_CHARS)
            ids = np.array(self.merger.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            # a piece ends with the token that brings the bytes to its length and those before it
            ends = np.searchsorted(np.cumsum(self.token_size[ids]), np.cumsum([len(x) for x in data]))
            ends = ((ends + 1) * self.dtype.itemsize).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _split(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct strings that are encoded each by itself."""
        strings = pa.array(parts, pa.large_string())
        one, marked, plain = (pc.match_substring_regex(strings, x) for x in (_ONE, _MARKED, _PLAIN))
        rest = pc.invert(pc.or_(one, marked))
        with_mark = _list(strings.filter(marked))
        # a newline between strings without white space at their end is a piece by itself
        pieces = self.pattern.findall("\n".join(_list(strings.filter(pc.and_(rest, plain)))))
        odd = [self.pattern.findall(x) for x in _list(strings.filter(pc.invert(plain)))]
        ids = dict.fromkeys(chain(_list(strings.filter(one)), (x[:-1] for x in with_mark), (x[-1] for x in with_mark), pieces, *odd))
        new = []
        for x in ids:
            if (found := self.parts.get(x)) is None:
                new.append(x)
            else:
                ids[x] = found
        ids.update(zip(new, self._merge(new), strict=True))
        ends = [k for k, x in enumerate(pieces) if x == "\n"]
        of_plain = (b"".join(map(ids.__getitem__, pieces[a:b])) for a, b in zip([0, *(k + 1 for k in ends)], [*ends, len(pieces)]))
        of_odd = (b"".join(map(ids.__getitem__, x)) for x in odd)
        out = []
        for x, is_one, is_marked, is_plain in zip(parts, _list(one), _list(marked), _list(plain), strict=True):
            out.append(ids[x] if is_one else ids[x[:-1]] + ids[x[-1]] if is_marked else next(of_plain) if is_plain else next(of_odd))
        return out

    def batches(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some texts in a row and how many each has, for all texts in their order. A null text has none.

        Tasks call forget() when they end: workers stay, and what they keep is missing elsewhere.
        """
        texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(texts):
            before = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + TOGETHER, side="right")))
            yield self._some(texts.slice(begin, end - begin))
            begin = end

    def forget(self) -> None:
        self.parts = {}

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(texts, _TWO_WHITE)
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(whole, "", texts), "\n", " \n"), " ")
        first = cut.offsets.to_numpy()
        of = cut.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        first = first - first[0]
        keys = [x if x[:1] == "\n" else " " + x for x in _list(of.dictionary)]
        code = of.indices.to_numpy().copy()
        # the first part of a text has no space before it; a text that is not cut is its first part
        heads = pc.if_else(whole, texts, pc.list_element(cut, 0)).dictionary_encode()
        code[first[:-1]] = heads.indices.to_numpy() + len(keys)
        keys += _list(heads.dictionary)
        have = list(map(self.parts.get, keys))
        new = [k for k, x in enumerate(have) if x is None]
        more = [keys[k] for k in new]
        found = self._split(more)
        if len(self.parts) + len(new) > CACHE:
            self.parts = {}
        self.parts.update((x, y) for x, y in zip(more, found, strict=True) if len(x) < 64)
        for k, x in zip(new, found, strict=True):
            have[k] = x
        wide = self.dtype.itemsize
        size = np.fromiter(map(len, have), np.int64, len(have)) // wide
        flat = np.frombuffer(b"".join(have), self.dtype)
        shift = np.cumsum(size) - size
        n = size[code]
        ends = np.cumsum(n)
        shift = shift[code] - (ends - n)
        out = np.empty(int(ends[-1]) if len(ends) else 0, self.dtype)
        for k in range(0, len(code), 1 << 19):
            last = min(len(code), k + (1 << 19)) - 1
            a, b = int(ends[k] - n[k]), int(ends[last])
            out[a:b] = flat[np.repeat(shift[k : last + 1], n[k : last + 1]) + np.arange(a, b)]
        return out, np.diff(np.concatenate([[0], ends])[first])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes."""
        out: list[bytes] = []
        for ids, n in self.batches(pa.array(texts, pa.large_string())):
            raw, ends = ids.tobytes(), (np.cumsum(n) * self.dtype.itemsize).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.dtype)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 (ids cut within a character) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, ids: np.ndarray) -> tuple[list[int], list[int]]:
        """First character of each token and the one after its last; tokens that share a character both cover it."""
        data = np.frombuffer(self.decode_bytes(ids), np.uint8)
        end = np.cumsum([len(self.token_bytes[i]) for i in ids.tolist()], dtype=np.int64)
        begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters that begin before each byte
        start = np.concatenate([[0], end[:-1]]) if len(end) else end
        inside = np.append((data & 0xC0) == 0x80, False)
        return (begun[start] - inside[start]).tolist(), begun[end].tolist()


def _parts_below(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    """Token as the merges of smaller ranks leave it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
        if best >= rank:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """Merges for the tokenizers library that act as ranks do: every pair of tokens that makes a token, by its rank.

    The pair that smaller ranks lead to comes first among those of one token.
    """
    out: list[tuple[str, str]] = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        pairs = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        usual = _parts_below(token, rank, ranks)
        pairs.sort(key=lambda p: list(p) != usual)
        out += [(as_chars(a), as_chars(b)) for a, b in pairs]
    return out


@lru_cache(maxsize=4)
def from_ranks(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """Encoder of a file of ranks; a piece that is a token is not merged, as with the tiktoken library."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    token_bytes = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        token_bytes[rank] = token
    vocab = {as_chars(t): r for t, r in ranks.items()}
    return Encoder(models.BPE(vocab, merges_of(ranks), ignore_merges=True), token_bytes, pattern)


@lru_cache(maxsize=4)
def from_tokenizer(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """Encoder of a byte-level tokenizer file; strings of special tokens in a text are ordinary text."""
    t = Tokenizer.from_file(path)
    token_bytes = [b""] * t.get_vocab_size(with_added_tokens=True)
    for token, i in t.get_vocab(with_added_tokens=False).items():
        token_bytes[i] = as_bytes(token) if all(c in _TO_BYTES for c in token) else token.encode()
    return Encoder(t.model, token_bytes, pattern)
