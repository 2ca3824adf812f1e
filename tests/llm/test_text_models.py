"""Language ID, language-model scores, toxicity and licences."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from callmeter.llm import lang_id, licenses, lm_score, toxicity

WORDS = {"en": "the of and that with from have this which would".split(), "de": "der die und nicht auch einer werden schon über wurde".split()}


def prose(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def test_language_id(spark, docs):
    rows = [(lang, prose(lang, 40, i)) for i, lang in enumerate(["en", "de"] * 20)] + [(None, "x"), ("en", None)]
    profiles = lang_id.train(spark.createDataFrame(rows, "lang string, text string"))
    new = spark.createDataFrame([(i, prose(lang, 12, 99 + i), lang) for i, lang in enumerate(["en", "de"] * 5)], "doc_id long, text string, want string")
    assert all(r["lang_pred"] == r["want"] and 0 <= r["score"] <= 1 for r in lang_id.predict(new, profiles).collect())
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in lang_id.predict(docs, profiles).collect() if not (r["text"] or "").strip()}
    assert got == {(3, "und", 0.0), (4, "und", 0.0)}
    none = lang_id.train(spark.createDataFrame([], "lang string, text string"))
    assert {r["lang_pred"] for r in lang_id.predict(docs, none).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_letters():
    b = lang_id.Bundler(64)
    grams = b.trigrams("Ab, a")
    want = np.zeros(64)
    for x, y, z in [(0, 97, 98), (97, 98, 0), (98, 0, 97), (0, 97, 0)]:
        want += np.roll(b.letter(x), 2).astype(int) * np.roll(b.letter(y), 1) * b.letter(z)
    assert (b.bundles([grams])[0] == want).all()


def brute_scores(rows, share):
    words = [(d, (t or "").encode().lower().split(), zlib.crc32(str(d).encode()) % 10 != 0 if d is not None else False) for d, t in rows]
    count, follow, pair, after = Counter(), defaultdict(Counter), defaultdict(Counter), Counter()
    for _, w, learn in words:
        if learn:
            count.update([*w, None])
            for token in [*(x + b" " for x in set(w)), b"\xff"]:
                laid = b"\xfe" * 4 + token
                for k in range(4, len(laid)):
                    for n in range(5):
                        follow[laid[k - n : k]][laid[k]] += 1
    total, types = sum(count.values()), len(count)
    frequent = {x for x, c in count.items() if x is not None and c >= share * total}

    def states(w):
        h = None
        for x in [*w, None]:
            yield h, x
            h = x if x in frequent else h

    for _, w, learn in words:
        for h, x in states(w) if learn else ():
            after[h] += 1
            if x is None or x in frequent:
                pair[h][x] += 1
    n1, n2 = (sum(c == k for c in count.values()) for k in (1, 2))
    d, m, d2 = (n1 + 0.5) / (n1 + 2 * n2 + 1), lm_score.M, lm_score.D2

    def p(context, byte):
        low = p(context[1:], byte) if context else 1 / 255
        own = follow.get(context, Counter())
        return (own[byte] + m * low) / (sum(own.values()) + m)

    out = []
    for doc, w, learn in words:
        base = score = 0.0
        for h, x in states(w):
            base += math.log10((count[x] + 0.1) / (total + 0.1 * (types + 1)))
            laid = b"\xfe" * 4 + (b"\xff" if x is None else x + b" ")
            spelled = math.prod(p(laid[k - 4 : k], laid[k]) for k in range(4, len(laid)))
            read = max(count[x] - d, 0) / total + d * types / total * spelled
            if h is not None:
                own = pair[h]
                read = max(own[x] - d2, 0) / after[h] + (after[h] - sum(own.values()) + d2 * len(own)) / after[h] * read
            score += math.log10(read)
        out.append((doc, not learn, len(w) + 1, sum(count[x] > 0 for x in [*w, None]), total, base, score))
    return out


@pytest.mark.parametrize("share, block", [(1e-5, 8192), (0.04, 2)])
def test_lm_scores_against_brute_force(spark, docs, tmp_path, monkeypatch, share, block):
    monkeypatch.setattr(lm_score, "SHARE", share)
    monkeypatch.setattr(lm_score, "BLOCK_ROWS", block)
    more = spark.createDataFrame([(100 + i, prose("en" if i % 2 else "de", 15, i) + f" x{i % 7}") for i in range(30)], "doc_id long, text string")
    own = docs.filter("doc_id IS NULL OR doc_id <> 5").unionByName(more, allowMissingColumns=True)
    if share < 1e-3:  # also a frame that is no scan
        own.repartition(3).write.parquet(str(tmp_path / "d"))
        own = spark.read.parquet(str(tmp_path / "d"))
    key = lambda r: (str(r[0]), r[5])
    got, want = sorted(map(tuple, lm_score.score(own).collect()), key=key), sorted(brute_scores([(r["doc_id"], r["text"]) for r in own.collect()], share), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]])


def brute_whole(rows, share):
    """Scores where all words are states: a rare one's failure arc leads to the state of the last frequent word, whose own leads to the root."""
    words = [(d, (t or "").encode().lower().split(), zlib.crc32(str(d).encode()) % 10 != 0 if d is not None else False) for d, t in rows]
    count, follow, pair, rare_pair = Counter(), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for w in (w for _, w, learn in words if learn):
        count.update([*w, None])
        for token in [*(x + b" " for x in set(w)), b"\xff"]:
            laid = b"\xfe" * 4 + token
            for k in range(4, len(laid)):
                for n in range(5):
                    follow[laid[k - n : k]][laid[k]] += 1
    total, types = sum(count.values()), len(count)
    frequent = {x for x, c in count.items() if x is not None and c >= share * total}

    def states(w):
        h = before = None
        for x in [*w, None]:
            yield h, before if before not in frequent else None, x
            h, before = x if x in frequent else h, x

    for w in (w for _, w, learn in words if learn):
        for h, rare, x in states(w):
            pair[h][x] += 1
            rare_pair[rare][x] += 1
    n1, n2 = (sum(c == k for c in count.values()) for k in (1, 2))
    d, m = (n1 + 0.5) / (n1 + 2 * n2 + 1), lm_score.M

    def p(context, byte):
        low = p(context[1:], byte) if context else 1 / 255
        own = follow.get(context, Counter())
        return (own[byte] + m * low) / (sum(own.values()) + m)

    def discounted(own, x, low):
        return (max(own[x] - lm_score.D2, 0) + lm_score.D2 * len(own) * low) / sum(own.values())

    out = defaultdict(list)
    for doc, w, _ in words:
        score = 0.0
        for h, rare, x in states(w):
            laid = b"\xfe" * 4 + (b"\xff" if x is None else x + b" ")
            read = max(count[x] - d, 0) / total + d * types / total * math.prod(p(laid[k - 4 : k], laid[k]) for k in range(4, len(laid)))
            read = discounted(pair[h], x, read) if h is not None else read
            score += math.log10(discounted(rare_pair[rare], x, read) if rare is not None and count[rare] else read)
        out[doc].append(score)
    return {doc: sorted(x) for doc, x in out.items()}


@pytest.mark.parametrize("block, slices", [(8192, 512), (4, 3)])
def test_lm_rare_words_are_states(spark, docs, tmp_path, monkeypatch, block, slices):
    """Some words are rare, some unknown, some at a text's end; texts that occur twice score higher than by their frequent words."""
    for name, value in (("FREQUENT", 0.02), ("BLOCK_ROWS", block), ("SLICES", slices)):
        monkeypatch.setattr(lm_score, name, value)
    r = random.Random(3)
    own = [(100 + i, prose("en" if i % 2 else "de", 12, i) + f" x{i % 7} " + " ".join(f"y{r.randrange(30)}" for _ in range(6)) + f" z{i}") for i in range(40)]
    twice = [(200 + i, " ".join(f"q{i}{r.choice('abcdef')} the" if k % 3 else f"q{i}{k}" for k in range(20))) for i in range(6)]
    rows = own + twice + [(d + 100, t) for d, t in twice]
    docs.filter("doc_id IS NULL OR doc_id NOT IN (5, 6)").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).repartition(2).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    want, got = brute_whole([(r["doc_id"], r["text"]) for r in read.collect()], 0.02), defaultdict(list)
    for row in lm_score.score(read).collect():
        got[row["doc_id"]].append(row["score"])
    assert {d: pytest.approx(x) for d, x in want.items()} == {d: sorted(x) for d, x in got.items()}
    monkeypatch.setattr(lm_score, "SHARE", 0.02)
    cut = {r["doc_id"]: r["score"] for r in lm_score.score(read).collect()}
    assert all(got[d][0] > cut[d] + 3 for d, _ in twice)


def test_model_rows_are_joined_by_block():
    pair = lambda h, x: lm_score.PAIR + h.to_bytes(4, "big") + x.to_bytes(4, "big")
    rows = [(7, b"wa", 3, True), (2, b"wa", 3, False), (7, b"\x01a", 0, True), (2, pair(300, 1), 5, True), (7, pair(300, 1), 5, False), (7, pair(300, 2), 4, True), (7, pair(0, 2), 0, True)]
    names = ["block", "gram", "count", "first"]
    batches = [pa.RecordBatch.from_pydict({n: pa.array(c, pa.binary() if n == "gram" else None) for n, c in zip(names, zip(*part))}) for part in (rows[:3], rows[3:])]
    got, states = [], []
    for r in (r for b in lm_score._packed(iter([*batches, batches[0].slice(0, 0)])) for r in b.to_pylist()):
        if r["block"] is None:
            states.append((r["state"], r["arcs"], r["seen"]))
            continue
        sizes, counts = np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["counts"], np.int64)
        ends = np.cumsum(sizes)
        got += [(r["block"], r["grams"][e - n : e], int(c)) for e, n, c in zip(ends, sizes, counts, strict=True)]
    assert sorted(got) == sorted(r[:3] for r in rows) and states == [(300, 2, 9)]
    assert list(lm_score._packed(iter([]))) == []


def test_lm_score_tells_order_and_handles_no_rows(spark, docs):
    rows = [(i, " ".join(["one two three four five six seven eight"] * 3) if i % 3 else prose("en", 24, i)) for i in range(60)]
    rows += [(1000, "one two three four five six seven eight"), (1001, "eight three one six two seven five four")]
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000]["base_score"] == pytest.approx(got[1001]["base_score"]) and got[1000]["score"] > got[1001]["score"] + 3
    assert lm_score.score(docs.filter("doc_id < 0")).count() == 0
    held = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    nothing = lm_score.score(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in nothing} == {(3, 0, 0)}


def test_lm_blocks_and_slices_send_one_row_for_each_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_ROWS", 32)
    spark.createDataFrame([(i, prose("en", 300, i)) for i in range(64)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    written, sent = lm_score.written, {}

    def count(df, name):
        out = written(df, name)
        sent[name] = out.filter("block IS NOT NULL").count()
        return out

    monkeypatch.setattr(lm_score, "written", count)
    one = {r["doc_id"]: r for r in lm_score.score(spark.read.parquet(str(tmp_path / "d"))).collect()}
    monkeypatch.setattr(lm_score, "SLICES", 4)
    few = {r["doc_id"]: r for r in lm_score.score(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert sent == {"lm-words": 8, "lm-slices": 8}  # two blocks, four slices
    assert {d: r[:5] for d, r in one.items()} == {d: r[:5] for d, r in few.items()} and len(one) == 64
    assert [one[d][5:] for d in one] == [pytest.approx(few[d][5:]) for d in one]


def test_lm_tokens_are_those_of_split(monkeypatch):
    texts = [None, "", " \t\n\r\x0b\x0c ", "Ab aB  x\n", "\x1c\u0085\xa0É ab", "x " * 50, " y", "ÀZ"]
    for size in (1 << 24, 8):
        monkeypatch.setattr(lm_score, "CHUNK", size)
        got = lm_score.read(pa.chunked_array([texts[:3], texts[3:]], pa.string()))
        words, ends = got.words.to_pylist(), np.cumsum(got.n)
        want = [(t or "").encode().lower().split() for t in texts]
        assert len(set(words)) == len(words) and [[words[k] for k in got.code[e - n : e]] for e, n in zip(ends, got.n)] == want


def test_lanes_do_not_change_scores():
    words = [[b"abc", b"de"] * 900, [b"x"], []]
    laid = lm_score.lay(words)
    orders = {n: (g, c) for n, g, c in lm_score.shorter(*lm_score.long_grams(laid, np.array([True] * 3)))}
    a = lm_score.Automaton(orders, 1804, int(laid.size.sum()))
    whole, lane = a.log_probs(laid), lm_score.LANE
    try:
        lm_score.LANE = 7
        assert np.allclose(a.log_probs(laid), whole)
    finally:
        lm_score.LANE = lane


def test_gradients():
    r = np.random.default_rng(1)
    p = {s + k: r.normal(size=v) for s in "fb" for k, v in {}.items()}
    for side in "fb":
        p |= {"w" + side: r.normal(size=(8, 24)), "u" + side: r.normal(size=(8, 24)), "b" + side: r.normal(size=24)}
    p |= {"a": r.normal(size=(16, 8)), "v": r.normal(size=8), "o": r.normal(size=16), "c": np.array(0.3)}
    x, mask = r.normal(size=(3, 5, 8)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    weight = np.array([0.5, -1.0, 2.0])
    _, saved = toxicity.forward(p, x, mask, keep=True)
    g, d_x = toxicity.backward(p, saved, weight)
    loss = lambda: float((toxicity.forward(p, x, mask) * weight).sum())
    for name in g:
        at = tuple(r.integers(0, s) for s in p[name].shape)
        e = np.zeros_like(p[name])
        e[at] = 1e-5
        p[name] = p[name] + e
        up = loss()
        p[name] = p[name] - 2 * e
        down = loss()
        p[name] = p[name] + e
        assert (up - down) / 2e-5 == pytest.approx(float(g[name][at]), rel=1e-4, abs=1e-7), name
    x[1, 2, 3] += 1e-5
    up = loss()
    x[1, 2, 3] -= 2e-5
    assert (up - loss()) / 2e-5 == pytest.approx(d_x[1, 2, 3], rel=1e-4)


def test_toxicity(spark, docs):
    r = random.Random(3)
    texts = [(i, prose("en", 30 + 60 * (i % 3), i) + (f" {r.choice(['idiot', 'idiotic', 'moron'])} " if i % 2 else " ") + prose("en", 20, -i), i % 2) for i in range(120)]
    train = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.train(train.select("doc_id", "text"), train.select("doc_id", "toxic"), sample=50)
    far = prose("en", 3000, 5) + " idiots " + prose("en", 10, 6)
    new = spark.createDataFrame([(1, far), (2, prose("en", 3000, 7)), (3, None), (4, "")], "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in toxicity.predict(new, model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] and 0 <= got[3] <= 1
    assert toxicity.predict(docs, model).count() == docs.count()
    nothing = toxicity.train(train.select("doc_id", "text"), train.select("doc_id", "toxic").filter("toxic = 1"))
    assert len({x["score"] for x in toxicity.predict(new, nothing).collect()}) == 1


def test_licenses(spark, docs):
    model = licenses.fit([prose("en", 12, i) for i in range(200)])
    texts = ["some prose of that\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "the license of that which", None, "", prose("en", 50, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["start"], x["end"], x["family"]) for x in r["licenses"] if x["confirmed"]] for r in licenses.scan(df, model).collect()}
    assert got == {0: [(19, 50, "MIT")], 1: [(0, 47, "Apache-2.0")], 2: [(0, 28, "CC-BY-NC")], 3: [], 4: [], 5: [], 6: []}
    assert licenses.scan(docs, model).count() == docs.count()
    x = licenses._features(["released under the mit license"], model.vocabulary)
    prob = licenses._softmax((x @ model.weights + model.bias) / model.temperature)[0]
    native = licenses.scan(spark.createDataFrame([(1, "released under the mit license")], "doc_id long, text string"), model).first()["licenses"][0]["probability"]
    assert native == pytest.approx(prob.max())


def test_short_forms_and_titles(spark):
    model = licenses.fit([prose("en", 12, i) for i in range(200)])
    lines = {
        "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "SPDX-License-Identifier: CC-BY-SA-4.0": "CC-BY-SA",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "GPL", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": "AGPL", "The MIT License (MIT)": "MIT",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,": "ISC",
        'The software is provided "as is", without warranty of any kind, express or implied': "MIT", "This is free and unencumbered software released into the public domain.": "Unlicense",
        "SPDX-License-Identifier: Own-1.0": None, "the license of this software": None,
    }
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: [x["family"] for x in r["licenses"] if x["confirmed"]] for r in licenses.scan(df, model).collect()}
    assert [got[i] for i in range(len(lines))] == [[x] if x else [] for x in lines.values()]


def test_licence_rows_against_brute_force(spark, docs):
    r = random.Random(6)
    model = licenses.fit([prose("en", 12, i) for i in range(200)])
    own = [g for g, w in zip(model.vocabulary, model.weights) if np.abs(w).any()]
    templates = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]

    def line():
        words = [w for w in r.choice(templates)[1].split() if r.random() > 0.15]
        return r.choice([prose("en", 6, r.randrange(999)), " ".join(words), f"{prose('en', 2, r.randrange(999))} {' '.join(words)}", " ".join(words[: len(words) // 2]), ""])

    rows = [(i, "\n\n".join(line() for _ in range(r.randrange(6)))) for i in range(80)]

    def brute(text):
        out, at = [], 0
        for x in text.split("\n"):
            grams = set(licenses.bigrams(x)) & set(own)
            if grams:
                z = (model.bias + sum(model.weights[model.vocabulary.index(g)] for g in grams)) / model.temperature
                p = licenses._softmax(z[None])[0]
                family = model.families[int(p.argmax())]
                if family != licenses.UNKNOWN and p.max() >= licenses.CERTAIN:
                    sure = any(f == family and len(set(licenses.bigrams(t)) & grams) >= licenses.needed(t, own) for f, t in templates if set(licenses.bigrams(t)) & set(own))
                    out.append((at, at + len(x), family, pytest.approx(p.max()), sure))
            at += len(x) + 1
        return out

    got = {x["doc_id"]: [tuple(y) for y in x["licenses"]] for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert sum(map(len, got.values())) > 50
    assert licenses.scan(docs.filter("doc_id < 0"), model).count() == 0


def test_frequent_notices_stay_features(spark):
    footers = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0."]
    plain = [prose("en", 12, i) for i in range(300)]
    want = {g for f in footers for g in licenses.bigrams(f)}
    for lines in (plain + footers * 150, plain[:100] + footers, plain + [f"{footers[k % 2]} Copy {k}" for k in range(150)]):
        assert want <= set(licenses.fit(lines).vocabulary)
    rows = [(i, prose("en", 12, i) + "\n" + prose("en", 9, -i) + "\n" + footers[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [x["family"] for x in r["licenses"] if x["confirmed"]] for r in licenses.scan(df, licenses.train(df)).collect()}
    assert got == {i: [["MIT", "CC-BY-NC"][i % 2]] for i in range(60)}


def test_wrapped_and_short_notices(spark):
    model = licenses.fit([prose("en", 12, i) for i in range(200)])
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU {}General Public License as published by\n * the Free Software Foundation.\n"
    planted = ["This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    mit, cc = "# Released\n# under the MIT\n# License.", "# This work is licensed under a Creative\n# Commons Attribution\n# 4.0 International License"
    texts = [gpl.format(""), gpl.format("Lesser "), gpl.format("Affero "), *planted, "\n".join(planted), f"{mit}\n{cc}", "dnl Released under\ndnl the MIT\ndnl License", "Released under\n *\nthe MIT\n//\nLicense", f"of that\nwhich\n\n{mit}\n\nthis"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [x for x in r["licenses"] if x["confirmed"]] for r in licenses.scan(df, model).collect()}
    one = [["GPL"], ["LGPL"], ["AGPL"], ["GPL"], ["Proprietary"], ["CC-BY-NC"], ["MIT"], ["Apache-2.0"]]
    want = [*one, [x for y in one[3:] for x in y], ["CC-BY", "MIT"], ["MIT"], [], ["MIT"]]
    assert [[x["family"] for x in got[i]] if i != 9 else sorted(x["family"] for x in got[i]) for i in range(len(texts))] == want
    assert (got[0][0]["start"], got[0][0]["end"]) == (0, texts[0].index("\n * the Free"))
    assert texts[12][got[12][0]["start"] : got[12][0]["end"]] == mit


def test_toxicity_reads_long_runs_whole():
    run = "".join(chr(0x4E00 + i) for i in range(203))
    pieces = toxicity.words_of(f"a {run} b")
    assert {run[k : k + 3] for k in range(201)} == {p[k : k + 3] for p in pieces[1:-1] for k in range(len(p) - 2)}
    assert max(map(len, pieces)) == 40 and toxicity.words_of("x" * 40) == ["x" * 40]
    texts = [prose("en", 20, i) + (" idiot" if i % 2 else "") for i in range(120)]
    model = toxicity.Model(toxicity.fit(texts, [i % 2 for i in range(120)]), 0.0, 0.0)
    far, clean = toxicity.Scorer(model).scores(["of" * 60 + "idiotidiotidiotidiotidiotidiot", "of" * 60 + "whichwhichwhichwhichwhich"])
    assert far > clean
