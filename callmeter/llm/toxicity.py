"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word is given to the network as an embedding of itself and the mean embedding of its character trigrams, so a word
that was never seen still has its parts. Runs of more than `LONGEST` characters (scripts without spaces, joined words)
are cut into overlapping pieces that are words of their own, so that every trigram counts. Windows of `WINDOW` words, half overlapping, cover the whole text; the text is
as toxic as its worst window. Training tells the network only which texts are toxic: the gradient flows through the
window that is worst at the time. Embeddings start from how much more often toxic texts have a word or a trigram.

Training takes at most `SAMPLE` labelled texts of either class (those with the smallest hash of their id), and no more
than `SAMPLE_CHARS` characters, on the driver; the score is set right for the classes' shares among all labelled rows. Scoring runs in the scan, text by text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.llm.common import mapped, remainder

#: Labelled texts of either class that training takes at most, and characters of all of them.
SAMPLE, SAMPLE_CHARS = 1500, 50_000_000
WINDOW, STEP = 32, 16
#: Characters of a word; pieces of a longer run share two, so each of its trigrams is in one.
LONGEST = 40
BUCKETS, EMBED, HIDDEN, ATTEND = 1 << 15, 4, 8, 8
#: Small samples are gone through more often, until so many steps are made.
EPOCHS, BATCH, RATE, STEPS = 3, 64, 0.01, 140
#: Share of the words of a training step whose own embedding is left out, so that the network also learns from their parts.
UNHEARD = 0.6
#: Words that a worker knows at a time, and windows that are scored together.
KNOWN, TOGETHER = 200_000, 4096
_WORD = re.compile(r"\w+")

Params = dict[str, np.ndarray]


def words_of(text: str | None) -> list[str]:
    runs = _WORD.findall((text or "").lower())
    return [w[k : k + LONGEST] for w in runs for k in ((0,) if len(w) <= LONGEST else range(0, len(w) - 2, LONGEST - 2))]


def _bucket(data: str) -> int:
    return zlib.crc32(data.encode("utf-8", "replace")) % BUCKETS


def trigram_buckets(word: str) -> list[int]:
    edged = f"^{word}$"
    return [_bucket("c" + edged[k : k + 3]) for k in range(len(edged) - 2)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows_of(n: int) -> np.ndarray:
    """First words of the windows of a text of n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    return np.unique(np.append(np.arange(0, n - WINDOW, STEP), n - WINDOW))


def _direction(p: Params, side: str, inputs: np.ndarray, mask: np.ndarray, keep: bool):
    """States of a gated recurrent unit. inputs: windows x words x 3 HIDDEN (reset, update, new); mask: windows x words."""
    u, h = p["u" + side], np.zeros((len(inputs), HIDDEN), inputs.dtype)
    out = np.empty((*mask.shape, HIDDEN), inputs.dtype)
    saved = {}
    order = range(mask.shape[1]) if side == "f" else range(mask.shape[1] - 1, -1, -1)
    for t in order:
        past = h @ u
        gates = _sigmoid(inputs[:, t, : 2 * HIDDEN] + past[:, : 2 * HIDDEN])
        reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(inputs[:, t, 2 * HIDDEN :] + reset * past[:, 2 * HIDDEN :])
        m = mask[:, t : t + 1]
        if keep:
            saved[t] = (h, reset, update, new, past[:, 2 * HIDDEN :])
        h = np.where(m, new + update * (h - new), h)
        out[:, t] = h
    return out, saved


def forward(p: Params, x: np.ndarray, mask: np.ndarray, keep: bool = False, projected: dict[str, np.ndarray] | None = None):
    """Logit of each window. x: its words' vectors, or (with projected) their rows in projected."""
    sides = []
    for side in "fb":
        inputs = projected[side][x] if projected else x @ p["w" + side] + p["b" + side]
        sides.append(_direction(p, side, inputs, mask, keep))
    states = np.concatenate([sides[0][0], sides[1][0]], axis=2)
    hidden = np.tanh(states @ p["a"])
    weight = np.where(mask, hidden @ p["v"], -np.inf)
    weight = np.exp(weight - weight.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    pooled = (weight[:, None, :] @ states)[:, 0]
    logit = pooled @ p["o"] + p["c"]
    return (logit, (x, mask, sides[0][1], sides[1][1], states, hidden, weight, pooled)) if keep else logit


def backward(p: Params, saved, d_logit: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the parameters and of the words' vectors."""
    x, mask, save_f, save_b, states, hidden, weight, pooled = saved
    g = {"o": pooled.T @ d_logit, "c": np.array(d_logit.sum())}
    d_pool = d_logit[:, None] * p["o"]
    d_weight = np.einsum("wth,wh->wt", states, d_pool)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
    g["v"] = np.einsum("wta,wt->a", hidden, d_score)
    d_hidden = d_score[:, :, None] * p["v"] * (1 - hidden**2)
    g["a"] = np.einsum("wth,wta->ha", states, d_hidden)
    d_states = weight[:, :, None] * d_pool[:, None, :] + d_hidden @ p["a"].T
    d_x = np.zeros_like(x)
    for side, save, d_out in (("f", save_f, d_states[:, :, :HIDDEN]), ("b", save_b, d_states[:, :, HIDDEN:])):
        u, d_u = p["u" + side], np.zeros_like(p["u" + side])
        d_in = np.zeros((*mask.shape, 3 * HIDDEN))
        carry = np.zeros((len(x), HIDDEN))
        order = range(mask.shape[1] - 1, -1, -1) if side == "f" else range(mask.shape[1])
        for t in order:
            h, reset, update, new, past = save[t]
            d_h, m = d_out[:, t] + carry, mask[:, t : t + 1]
            d_new_h = np.where(m, d_h, 0)
            d_update = d_new_h * (h - new) * update * (1 - update)
            d_new = d_new_h * (1 - update) * (1 - new**2)
            d_reset = d_new * past * reset * (1 - reset)
            d_past = np.concatenate([d_reset, d_update, d_new * reset], axis=1)
            d_in[:, t] = np.concatenate([d_reset, d_update, d_new], axis=1)
            d_u += h.T @ d_past
            carry = np.where(m, d_new_h * update, d_h) + d_past @ u.T
        g["u" + side] = d_u
        g["w" + side] = np.einsum("wti,wtj->ij", x, d_in)
        g["b" + side] = d_in.sum(axis=(0, 1))
        d_x += d_in @ p["w" + side].T
    return g, d_x


class Words:
    """Numbers of words, and for each its bucket and those of its trigrams."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.bucket: list[int] = [0]
        self.parts: list[list[int]] = [[]]

    def numbers(self, words: list[str]) -> np.ndarray:
        number = self.number
        for w in words:
            if w not in number:
                number[w] = len(number)
                self.bucket.append(_bucket("w" + w))
                self.parts.append(trigram_buckets(w))
        return np.array([number[w] for w in words], np.int64)

    def vectors(self, p: Params, first: int = 0) -> np.ndarray:
        """Of all words from number `first` on; word 0 (no word) is 0."""
        size = np.array([len(x) for x in self.parts[first:]], np.int64)
        flat = np.array([b for x in self.parts[first:] for b in x], np.int64)
        chars = np.zeros((len(size), EMBED))
        if len(flat):
            np.add.at(chars, np.repeat(np.arange(len(size)), size), p["chars"][flat])
        out = np.concatenate([p["words"][self.bucket[first:]], chars / np.maximum(size, 1)[:, None]], axis=1)
        if not first:
            out[0] = 0
        return out


def _laid(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts: word numbers (0 beyond the end), mask, and the text of each."""
    starts = [windows_of(len(n)) for n in numbers]
    text = np.repeat(np.arange(len(numbers)), [len(s) for s in starts])
    size = np.array([len(n) for n in numbers], np.int64)
    base = np.cumsum(size) - size
    within = (np.concatenate(starts) if starts else np.zeros(0, np.int64))[:, None] + np.arange(WINDOW)
    mask = within < size[text][:, None]
    flat = np.concatenate([*numbers, np.zeros(1, np.int64)])
    return np.where(mask, flat[np.minimum(within + base[text][:, None], len(flat) - 1)], 0), mask, text


class Model(NamedTuple):
    params: Params
    shift: float  # logit of the prior; what an empty text scores, and the correction for the sample's shares
    correction: float


def _log_odds(texts: list[set[int]], labels: np.ndarray) -> np.ndarray:
    counts = np.zeros((2, BUCKETS))
    for x, y in zip(texts, labels.tolist(), strict=True):
        counts[y, list(x)] += 1
    of = np.bincount(labels, minlength=2)[:, None]
    rate = np.log((counts + 0.5) / (of + 1))
    seen = counts.sum(axis=0)
    return (rate[1] - rate[0]) * seen / (seen + 2)


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Params:
    y, rng, lexicon = np.array(labels, np.int64), np.random.default_rng(seed), Words()
    numbers = [lexicon.numbers(words_of(t)) for t in texts]
    p: Params = {k: rng.normal(0, 0.1, (BUCKETS, EMBED)) for k in ("words", "chars")}
    p["words"][:, 0] = _log_odds([{lexicon.bucket[i] for i in n.tolist()} for n in numbers], y)
    p["chars"][:, 0] = _log_odds([{b for i in set(n.tolist()) for b in lexicon.parts[i]} for n in numbers], y)
    for side in "fb":
        p |= {"w" + side: rng.normal(0, 0.3, (2 * EMBED, 3 * HIDDEN)), "u" + side: rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), "b" + side: np.zeros(3 * HIDDEN)}
    p |= {"a": rng.normal(0, 0.3, (2 * HIDDEN, ATTEND)), "v": rng.normal(0, 0.3, ATTEND), "o": rng.normal(0, 0.3, 2 * HIDDEN), "c": np.array(0.0)}
    mean, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    usable = np.array([i for i, n in enumerate(numbers) if len(n)], np.int64)
    batches = max(1, -(-len(usable) // BATCH))
    for _ in range(max(epochs, -(-STEPS // batches))):
        rng.shuffle(usable)
        for k in range(0, len(usable), BATCH):
            own = usable[k : k + BATCH]
            rows, mask, text = _laid([numbers[i] for i in own])
            used, rows = np.unique(rows, return_inverse=True)
            rows = rows.reshape(mask.shape)
            vectors = _some_vectors(p, lexicon, used)
            heard = rng.random(len(used)) >= UNHEARD
            vectors[~heard, :EMBED] = 0
            logits = forward(p, rows, mask, projected={s: vectors @ p["w" + s] + p["b" + s] for s in "fb"})
            order = np.lexsort((logits, text))
            worst = order[np.append(text[order][1:] != text[order][:-1], True)]
            logit, saved = forward(p, vectors[rows[worst]], mask[worst], keep=True)
            g, d_x = backward(p, saved, (_sigmoid(logit) - y[own]) / len(own))
            d_x = d_x * mask[worst][:, :, None]
            d_x[:, :, :EMBED] *= heard[rows[worst]][:, :, None]
            g |= _embedding_gradients(p, lexicon, used, rows[worst], d_x)
            step += 1
            for name, d in g.items():
                mean[name] += 0.1 * (d - mean[name])
                square[name] += 0.01 * (d * d - square[name])
                p[name] = p[name] - RATE * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
    return p


def _some_vectors(p: Params, lexicon: Words, used: np.ndarray) -> np.ndarray:
    some = Words()
    some.bucket, some.parts = [lexicon.bucket[i] for i in used], [lexicon.parts[i] for i in used]
    out = some.vectors(p)
    out[0] = 0 if len(used) and used[0] == 0 else _one_vector(p, some.bucket[0], some.parts[0])
    return out


def _one_vector(p: Params, bucket: int, parts: list[int]) -> np.ndarray:
    return np.concatenate([p["words"][bucket], p["chars"][parts].sum(axis=0) / max(len(parts), 1)])


def _embedding_gradients(p: Params, lexicon: Words, used: np.ndarray, rows: np.ndarray, d_x: np.ndarray) -> Params:
    each = np.zeros((len(used), 2 * EMBED))
    np.add.at(each, rows.ravel(), d_x.reshape(-1, 2 * EMBED))
    out = {"words": np.zeros_like(p["words"]), "chars": np.zeros_like(p["chars"])}
    for i, d in zip(used.tolist(), each, strict=True):
        if i and d.any():
            out["words"][lexicon.bucket[i]] += d[:EMBED]
            np.add.at(out["chars"], lexicon.parts[i], d[EMBED:] / max(len(lexicon.parts[i]), 1))
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From doc_id, text of docs and doc_id, toxic (0 or 1; other rows are ignored) of labels.

    The sample is chosen by ids; the texts of the chosen come by a broadcast of those ids, so no text is shuffled. Of
    rows with one id the first by text counts. Without both classes every text scores the prior.
    """
    rows = docs.select("doc_id").distinct().join(labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "doc_id")
    of_class = [rows.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    ids = of_class[0].unionByName(of_class[1]).withColumn("order", F.xxhash64("doc_id"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "order").agg(F.char_length(F.min("text")).alias("n")).collect()
    chosen, chars = [], 0
    for r in sorted(sizes, key=lambda r: (r["order"], r["doc_id"])):
        if chars + r["n"] <= SAMPLE_CHARS:
            chosen.append((r["doc_id"], r["toxic"]))
            chars += r["n"]
    taken = F.broadcast(docs.sparkSession.createDataFrame(chosen, docs.select("doc_id").schema.add("toxic", "integer")))
    few = sorted(texts.join(taken, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect(), key=lambda r: r["doc_id"])
    shares = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    zero, one = shares.get(0, 0), shares.get(1, 0)
    prior = float(np.log((one + 0.5) / (zero + 0.5)))
    if not zero or not one:
        return Model({}, prior, 0.0)
    labels = [r["toxic"] for r in few]
    share = float(np.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 0.5)))
    return Model({k: v.astype(np.float32) for k, v in fit([r["text"] for r in few], labels).items()}, prior, prior - share)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.words = Words()
        self.rows = {s: np.zeros((0, 3 * HIDDEN), np.float32) for s in "fb"}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logits = np.full(len(texts), self.model.shift)
        if not self.model.params:
            return _sigmoid(logits)
        p = self.model.params
        if len(self.words.bucket) > KNOWN:
            self._forget()
        numbers = [self.words.numbers(words_of(t)) for t in texts]
        first = len(self.rows["f"])
        new = self.words.vectors(p, first).astype(np.float32)
        self.rows = {s: np.concatenate([self.rows[s], new @ p["w" + s] + p["b" + s]]) for s in "fb"}
        rows, mask, text = _laid(numbers)
        worst = np.full(len(texts), -np.inf)
        for k in range(0, len(rows), TOGETHER):
            z = forward(p, rows[k : k + TOGETHER], mask[k : k + TOGETHER], projected=self.rows)
            np.maximum.at(worst, text[k : k + TOGETHER], z)
        some = np.isfinite(worst)
        logits[some] = worst[some] + self.model.correction
        return _sigmoid(logits)


def predict(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of docs with score (0 to 1). Texts that are null, empty or without a word score the prior.

    Texts are read whole, row by row; a column of docs called as the result is replaced by it.
    """

    def run(texts: Iterator[list]) -> Iterator[list]:
        scorer = Scorer(model)
        for some in texts:
            yield [scorer.scores(some)]

    return mapped(docs, run, {name: "double"}, 128)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(remainder("doc_id", 5) != 0)
    model = train(docs, labels)
    out = predict(docs.withColumn("held_out", remainder("doc_id", 5) == 0), model)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
