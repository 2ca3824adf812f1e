"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is its letters' vectors, permuted (rolled) by their place and
bound (multiplied). A text is the bundle (sum) of its trigrams, and so is a language, over all texts that carry its
name. A text has the language whose prototype is nearest by cosine, after the part that all prototypes share, which
says nothing about the language, is taken out of them.

Letters' vectors follow from their code points, so tasks agree on them without exchange. Sums are of integers: the
prototypes do not depend on the order of rows. They are summed in the tasks and then by SQL: a task sends one vector a
language, and the driver holds one a language.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.llm.common import columns, free, mapped, remainder

DIM = 1024
#: How sharply the score prefers the nearest prototype.
SHARPNESS = 25.0
#: Trigram vectors that a worker keeps, and the texts' trigrams that are bundled at a time.
KEPT = 16_384
UNKNOWN = "und"
#: Characters from which on a text that is near no prototype has no learned language.
LONG = 200


class Profiles(NamedTuple):
    langs: list[str]
    vectors: np.ndarray  # of each language, of length 1


class Bundler:
    """Texts to hypervectors."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(0x110000, bool)
        self.asked = np.zeros(0x110000, bool)
        self._forget()

    def _forget(self) -> None:
        self.row: dict[int, int] = {}
        self.vectors = np.empty((KEPT, self.dim), np.int8)

    def letter(self, c: int) -> np.ndarray:
        """Word boundaries are letter 0."""
        if c not in self.letters:
            if len(self.letters) > 4 * KEPT:
                self.letters = {}
            seed = int.from_bytes(hashlib.sha256(b"letter %d" % c).digest()[:8], "little")
            bits = np.random.default_rng(seed).integers(0, 2, self.dim, np.int8)
            self.letters[c] = (2 * bits - 1).astype(np.int8)
        return self.letters[c]

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of a text's words (three code points of 21 bits) and their counts; none without a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        new = points[~self.asked[points]]
        for c in np.unique(new).tolist():
            self.is_letter[c] = unicodedata.category(chr(c))[0] == "L"
            self.asked[c] = True
        letters = np.where(self.is_letter[points], points, 0)
        padded = np.concatenate([[0], letters, [0]]).astype(np.int64)
        padded = padded[np.append(True, (padded[1:] != 0) | (padded[:-1] != 0))]  # one boundary between words
        if len(padded) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.unique(padded[:-2] << 42 | padded[1:-1] << 21 | padded[2:], return_counts=True)

    def _vector(self, trigram: int) -> np.ndarray:
        a, b, c = trigram >> 42, trigram >> 21 & 0x1FFFFF, trigram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def _rows(self, trigrams: np.ndarray) -> np.ndarray:
        for t in [t for t in trigrams.tolist() if t not in self.row]:
            self.vectors[len(self.row)] = self._vector(t)
            self.row[t] = len(self.row)
        return self.vectors[[self.row[t] for t in trigrams.tolist()]]

    def bundles(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A vector for each text, from its trigrams."""
        out = np.zeros((len(grams), self.dim), np.float32)
        known = np.unique(np.concatenate([np.zeros(0, np.int64), *(g for g, _ in grams)]))
        for k in range(0, len(known), KEPT // 4):
            part = known[k : k + KEPT // 4]
            if len(self.row) + len(part) > KEPT:
                self._forget()
            counts = np.zeros((len(grams), len(part)), np.float32)
            for i, (g, n) in enumerate(grams):
                lo, hi = np.searchsorted(g, [part[0], part[-1] + 1])
                counts[i, np.searchsorted(part, g[lo:hi])] = n[lo:hi]
            out += counts @ self._rows(part).astype(np.float32)
        return out


def train(labelled: DataFrame, dim: int = DIM) -> Profiles:
    """Prototypes of the languages of lang, text, over all rows with both. The driver gets one vector a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dim)
        counts: dict[str, dict[int, int]] = {}
        sums: dict[str, np.ndarray] = {}

        def bundle(lang: str) -> None:
            codes = np.array(sorted(counts[lang]), np.int64)
            n = np.array([counts[lang][c] for c in codes.tolist()], np.int64)
            total = sums.setdefault(lang, np.zeros(dim, np.int64))
            for k in range(0, len(codes), KEPT // 4):
                part = codes[k : k + KEPT // 4]
                total += n[k : k + KEPT // 4] @ np.stack([bundler._vector(t) for t in part.tolist()]).astype(np.int64)
            counts[lang] = {}

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = counts.setdefault(lang, {})
                for t, k in zip(*(x.tolist() for x in bundler.trigrams(text)), strict=True):
                    own[t] = own.get(t, 0) + k
                if len(own) > 8 * KEPT:
                    bundle(lang)
        for lang in list(counts):
            bundle(lang)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))})

    rows = labelled.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "v"))
    sums = parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas()
    langs = sorted(sums["lang"].unique())
    vectors = np.zeros((len(langs), dim))
    if langs:
        vectors[sums["lang"].map({x: k for k, x in enumerate(langs)}), sums["i"]] = sums["v"]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    langs, vectors = [x for x, n in zip(langs, length[:, 0], strict=True) if n], vectors[length[:, 0] > 0] / length[length[:, 0] > 0]
    if len(langs) > 1:
        vectors = vectors - vectors.mean(axis=0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Profiles(langs, vectors)


RESULTS = {"lang_pred": "string", "score": "double", "cosine": "double"}


def predict(docs: DataFrame, profiles: Profiles, names: list[str] | None = None) -> DataFrame:
    """All columns of docs with lang_pred, score (0 to 1) and cosine (of the prototype), or with these under other names.

    A null text or one without a letter is `und` with score 0, as is every text if no language was learned. Of equally
    near languages the first by name is taken. Whole texts are read, of any length; rows are independent. A column of
    docs that has the name of a result is replaced by it.
    """
    dim = profiles.vectors.shape[1]
    vectors = profiles.vectors.astype(np.float32)
    langs = profiles.langs

    def run(texts: Iterator[list]) -> Iterator[list]:
        bundler = Bundler(dim)
        for some in texts:
            grams = [bundler.trigrams(x or "") for x in some]
            bundle = bundler.bundles(grams)
            cos = bundle @ vectors.T / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-12)
            pred, score, near = [UNKNOWN] * len(grams), np.zeros(len(grams)), np.zeros(len(grams))
            if langs:
                e = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)).astype(np.float64))
                best = cos.argmax(axis=1)
                for i, (g, _) in enumerate(grams):
                    if len(g):
                        pred[i], score[i], near[i] = langs[best[i]], 1 / e[i].sum(), cos[i, best[i]]
            yield [pred, score, near]

    return mapped(docs, run, dict(zip(names or RESULTS, RESULTS.values(), strict=True)), 256)


def has_language(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows of docs, with all columns, whose text has a learned language.

    Rejected are null texts and those without a letter, and texts of `LONG` characters and more that are no nearer to any
    prototype than unrelated texts are: the cosine of two random vectors has a standard deviation of 1 / sqrt(dim), and
    texts below three of them go. Shorter texts say too little and stay. Nothing is rejected by which language it has.
    """
    names = free(docs, *RESULTS)
    least = 3 / profiles.vectors.shape[1] ** 0.5
    rows = predict(docs, profiles, names).filter((F.col(names[0]) != UNKNOWN) & ((F.char_length("text") < LONG) | (F.col(names[2]) >= least)))
    return rows.select(*columns(docs))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = train(docs.filter(remainder("doc_id", 5) != 0))
    rows = docs.select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    return predict(rows, profiles).select("doc_id", "held_out", "lang_pred", "score", "cosine")
