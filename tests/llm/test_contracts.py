"""Each registered query on the smallest tables; predictions and the pipeline against plain loops."""

import base64
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from callmeter.llm import lang_id, registry

DATA = "/root/testdata/sf0.001"
LONG, TEXT, REAL, FLAG, INT = "bigint", "string", "double", "boolean", "int"
COLUMNS = {
    "op1_language_id": (5, {"doc_id": LONG, "held_out": FLAG, "lang_pred": TEXT, "score": REAL}),
    "op2_pii": (0, {"doc_id": LONG, **{f"n_{k}": LONG for k in ("email", "ip", "card", "phone")}, "base_sha256": TEXT, "spans": TEXT}),
    "op3_lm_score": (10, {"doc_id": LONG, "held_out": FLAG, "n_tokens": LONG, "n_known": LONG, "train_tokens": LONG, "base_score": REAL, "score": REAL}),
    "op4_toxicity": (5, {"doc_id": LONG, "held_out": FLAG, "score": REAL, "predicted": INT}),
    "op5_jaccard_join": (0, {"doc_id": LONG, "class_id": LONG, "n_links": LONG}),
    "op6_token_files": (0, {"doc_id": LONG, "start": LONG, "n_tokens": LONG, "ids_crc32": LONG}),
    "op7_exact_dedup": (0, {"doc_id": LONG, "keep_id": LONG, "group_size": LONG, "kept": FLAG, "text_sha256": TEXT}),
    "op8_bpe_codec": (0, {"doc_id": LONG, "n_tokens": LONG, "ids_sha256": TEXT, "decoded_sha256": TEXT}),
    "op13_line_dedup": (0, {"doc_id": LONG, "n_lines": LONG, "n_dropped": LONG, "kept_sha256": TEXT}),
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_a_row_a_document(spark, name):
    """Columns, their kinds, every document once, and which rows are held out."""
    mod, kinds = COLUMNS[name]
    got = registry.QUERIES[name](spark, DATA)
    assert {c: k for c, k in got.dtypes if c in kinds} == kinds
    rows = got.collect()
    ids = [r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    if mod:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == 0) for r in rows)
    if "score" in kinds and name != "op3_lm_score":
        assert all(0 <= r["score"] <= 1 for r in rows)
    if "predicted" in kinds:
        assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


@pytest.mark.parametrize("name,columns", [("op9_decontaminate", {"doc_id", "item_id"}), ("op10_licenses", {"doc_id", "families"})])
def test_a_row_a_finding(spark, name, columns):
    got = registry.QUERIES[name](spark, DATA)
    assert columns <= set(got.columns) and all(r["doc_id"] is not None for r in got.collect())


class Plain:
    """Language profiles by loops over trigrams."""

    def __init__(self, rows, dim=lang_id.DIM):
        self.bundler = lang_id.Bundler(dim)
        sums = {}
        for lang, text in rows:
            if lang is not None and text is not None:
                sums[lang] = sums.get(lang, np.zeros(dim, np.int64)) + self.vector(text)
        self.langs = sorted(k for k, v in sums.items() if v.any())
        ones = np.stack([sums[k] / math.sqrt(float(sums[k] @ sums[k])) for k in self.langs])
        ones = ones - ones.mean(axis=0)
        self.prototypes = ones / np.sqrt((ones**2).sum(axis=1, keepdims=True))

    def vector(self, text):
        letters = "".join(c if unicodedata.category(c)[0] == "L" else "\0" for c in text.lower())
        padded = re.sub("\0+", "\0", f"\0{letters}\0")
        out = np.zeros(self.bundler.dim, np.int64)
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            out += np.roll(self.bundler.letter(ord(a)), 2) * np.roll(self.bundler.letter(ord(b)), 1) * self.bundler.letter(ord(c)).astype(np.int64)
        return out

    def predict(self, text):
        """Language, score and cosine; None where there is no letter."""
        v = self.vector(text or "")
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            return None
        cos = self.prototypes @ v / math.sqrt(float(v @ v))
        best = int(cos.argmax())
        return self.langs[best], 1 / sum(math.exp(lang_id.SHARPNESS * (c - cos[best])) for c in cos), cos[best]


def test_predictions_are_those_of_plain_sums(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    plain = Plain([(r["lang"], r["text"]) for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 5])
    got = {r["doc_id"]: r for r in lang_id.op1_language_id(spark, DATA).collect()}
    for r in docs:
        want, own = plain.predict(r["text"]), got[r["doc_id"]]
        if want is None:
            assert (own["lang_pred"], own["score"]) == ("und", 0)
        else:
            assert own["lang_pred"] == want[0] and own["score"] == pytest.approx(want[1], abs=1e-4) and own["cosine"] == pytest.approx(want[2], abs=1e-4)


def edits_within(pattern, text):
    """The fewest edits between the pattern and a part of the text."""
    row = np.zeros(len(text) + 1, np.int64)
    ramp, points = np.arange(len(text) + 1), np.array([ord(c) for c in text])
    for i, c in enumerate(pattern, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (points != ord(c))]))
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def brute_pipeline(docs, bench):
    plain = Plain([(lang, t) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 5])
    docs = [(i, t) for i, t, _ in docs]
    found = {i: plain.predict(t) for i, t in docs}
    docs = [(i, t) for i, t in docs if found[i] and (len(t) < 200 or found[i][2] >= 3 / math.sqrt(lang_id.DIM))]
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i, t))
    docs = [(i, t) for _, i, t in map(min, groups.values())]
    sets = [({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set()) for _, t in docs]
    root = list(range(len(docs)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    docs = [docs[k] for k in range(len(docs)) if docs[k][0] == min(docs[j][0] for j in range(len(docs)) if find(j) == find(k))]
    normal = lambda t: " ".join(t.lower().split())
    windows = {normal(t)[a : a + 80] for t in bench for a in {*range(0, max(0, len(normal(t)) - 80) + 1, 40), max(0, len(normal(t)) - 80)}}
    docs = [(i, t) for i, t in docs if not any(edits_within(w, normal(t)) <= 8 for w in windows)]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return sorted((i, len(enc.encode(t, disallowed_special=()))) for i, t in docs)


def test_pipeline_is_the_plain_one(spark, tmp_path):
    r = random.Random(11)
    source = [x["text"] for x in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect() if len(x["text"]) > 120]
    some = lambda n: "".join(r.choice("aeiounrstl ") for _ in range(n)).strip()
    bench = [some(170), some(100)]
    rows = []
    for _ in range(300):
        t = r.choice(source)
        a = r.randrange(max(1, len(t) - 400))
        rows.append(t[a : a + 400])
    for k in range(0, 300, 6):
        words = rows[k].split(" ")
        p = list(bench[k // 6 % 2])
        for _ in range(k // 20):
            p[r.randrange(len(p))] = r.choice("xyz")
        rows[k + 1] = [rows[k].replace(" ", "\n "), " ".join(words[:-1] + ["other"]), rows[k] + "  ", "12 34 -", rows[k][:100] + "".join(p) + rows[k][100:], " ".join(chr(0x4E00 + r.randrange(9000)) * 3 for _ in range(80))][k // 6 % 6]
    docs = [(i, t, r.choice(["en", "de", None])) for i, t in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "length(text) AS n_chars").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((x["doc_id"], x["n_tokens"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute_pipeline(docs, bench)
    assert got == want and 100 < len(want) < 290


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
