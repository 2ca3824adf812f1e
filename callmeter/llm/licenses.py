"""Licence notices: a trained paragraph classifier, in DataFrame functions alone.

A paragraph is a run of lines between lines without a letter or digit, so comment marks alone end one. Its features are
its word bigrams, also those over the end of a line; the weights of a multinomial logistic regression over licence
families are sparse: only bigrams of the known notices have any. Lines without such a bigram have the unknown class for
certain, which is why they are not scored. Each other line is scored by itself, for adjacent notices of one line. Those
of a paragraph that confirm no family so are scored together where at most one line lies between them; when a family is
confirmed, what is left without the bigrams of its templates is scored again, for wrapped notices of several families.

The probabilities are calibrated by a temperature fitted on held-out lines, and a family is confirmed when the lines
hold enough of a template of it.

Training is small and happens on the driver: variations of the templates, and lines of at most `SAMPLE_DOCS` documents
as the unknown class. Scoring happens row by row in the scan: nothing is exploded or shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Usual notices of licence families.
TEMPLATES = {
    "AGPL": [
        "licensed under the gnu affero general public license version 3", "you can redistribute it and or modify it under the terms of the gnu affero general public license",
        "gnu affero general public license version 3 19 november 2007", "spdx license identifier agpl 3 0",
    ],
    "Apache-2.0": [
        "licensed under the apache license version 2 0", "you may not use this file except in compliance with the license", "apache license version 2 0 january 2004",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "spdx license identifier apache 2 0",
    ],
    "BSD": [
        "released under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted",
        "any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "spdx license identifier bsd 2 clause", "spdx license identifier bsd 3 clause",
    ],
    "CC-BY": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "spdx license identifier cc by 4 0"],
    "CC-BY-NC": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 license", "spdx license identifier cc by nc 4 0"],
    "CC-BY-SA": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 license", "spdx license identifier cc by sa 4 0"],
    "CC0": ["released under cc0 1 0 universal", "to the extent possible under law the author has waived all copyright", "spdx license identifier cc0 1 0"],
    "GPL": [
        "this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license",
        "gnu general public license version 3 29 june 2007", "gnu general public license version 2 june 1991", "spdx license identifier gpl 2 0", "spdx license identifier gpl 3 0",
    ],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "spdx license identifier isc"],
    "LGPL": [
        "licensed under the gnu lesser general public license version 2 1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "gnu lesser general public license version 3 29 june 2007", "spdx license identifier lgpl 2 1", "spdx license identifier lgpl 3 0",
    ],
    "MIT": [
        "released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "the software is provided as is without warranty of any kind express or implied", "the mit license mit", "spdx license identifier mit",
    ],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "Proprietary": ["all rights reserved", "no part of this work may be reproduced without permission"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "spdx license identifier unlicense"],
}
#: Templates that begin so differ in their last words only and are confirmed as a whole.
WHOLE = "spdx license identifier"
#: Documents whose lines stand for the unknown class in training: those with the smallest crc32 of the id.
SAMPLE_DOCS = 200
#: Distinct lines of those documents that training takes: those with the smallest crc32.
SAMPLE_LINES = 5000
#: Words of those lines that stand around notices in training, at most.
FILLER_WORDS = 20_000
#: Share of a template's bigrams that confirms its family; probability that a family needs.
CONFIRM, CERTAIN = 0.6, 0.5
#: A bigram in two of the unknown lines and in this share of them is no feature.
COMMON = 0.005
#: A line with this share of a template's bigrams may be a notice and is no unknown line.
RESEMBLES = 0.5
#: Words that mark a line as a comment.
_MARK = r"(?i)^[^\p{L}\p{N}]*(?:rem|dnl)(?![\p{L}\p{N}])"
_SPLIT = r"[^\p{L}\p{N}]+"


class Model(NamedTuple):
    families: list[str]  # the last is UNKNOWN
    vocabulary: list[str]  # bigrams
    weights: np.ndarray  # bigram x family
    bias: np.ndarray
    temperature: float


def bigrams(line: str) -> list[str]:
    words = [w for w in re.split(r"[\W_]+", line.lower()) if w]
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def needed(template: str, vocabulary: list[str]) -> float:
    """How many of a template's bigrams (those that are features) confirm its family."""
    return len(set(bigrams(template)) & set(vocabulary)) * (1.0 if template.startswith(WHOLE) else CONFIRM)


def resembles(line: str) -> bool:
    own = set(bigrams(line))
    return any(len(own & t) >= RESEMBLES * len(t) for t in (set(bigrams(t)) for ts in TEMPLATES.values() for t in ts))


def _features(lines: list[str], vocabulary: list[str]) -> np.ndarray:
    place = {g: i for i, g in enumerate(vocabulary)}
    out = np.zeros((len(lines), len(vocabulary)))
    for i, x in enumerate(lines):
        for g in set(bigrams(x)) & place.keys():
            out[i, place[g]] = 1
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(unknown_lines: list[str], seed: int = 7) -> Model:
    """Logistic regression on variations of the templates and on lines of the unknown class.

    The lines are raw ones of the corpus. Those that may be notices are left out and a repeated line counts once, so that
    how often a notice occurs does not decide whether its bigrams are features.
    """
    families = [*sorted(TEMPLATES), UNKNOWN]
    unknown_lines = [x for x in dict.fromkeys(unknown_lines) if not resembles(x)]
    common = Counter(g for x in unknown_lines for g in set(bigrams(x)))
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in bigrams(t) if common[g] < max(2, COMMON * len(unknown_lines))})
    rng = np.random.default_rng(seed)
    plain = [x for x in unknown_lines if len(set(bigrams(x)) & set(vocabulary)) < 2]
    filler = np.array((" ".join(plain).split() or ["of", "the"])[:FILLER_WORDS], dtype=object)
    lines, labels = [], []
    for k, family in enumerate(families[:-1]):
        for t in TEMPLATES[family]:
            for _ in range(40):
                words = [w for w in t.split() if rng.random() > 0.05]
                around = [str(rng.choice(filler)) for _ in range(int(rng.integers(0, 6)))]
                cut = int(rng.integers(0, len(around) + 1))
                lines.append(" ".join([*around[:cut], *words, *around[cut:]]))
                labels.append(k)
    for g in rng.choice(np.array(vocabulary, dtype=object), 600):  # a stray bigram in other prose
        lines.append(" ".join([str(rng.choice(filler)), g, str(rng.choice(filler))]))
        labels.append(len(families) - 1)
    lines += plain
    labels += [len(families) - 1] * len(plain)
    x, y = _features(lines, vocabulary), np.eye(len(families))[labels]
    held = rng.random(len(lines)) < 0.25
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    for _ in range(400):
        grad = _softmax(x[~held] @ w + b) - y[~held]
        w -= 2.0 * (x[~held].T @ grad / (~held).sum() + 1e-4 * w)
        b -= 2.0 * grad.mean(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - 2e-4, 0)  # keeps the weights sparse
    logits = x[held] @ w + b
    grid = np.geomspace(0.25, 4, 33)
    loss = [-(np.log(_softmax(logits / t) + 1e-12) * y[held]).sum() for t in grid]
    return Model(families, vocabulary, w, b, float(grid[int(np.argmin(loss))]))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    rows = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL")
    ids = rows.select("doc_id", F.crc32(F.col("doc_id").cast("string")).alias("c")).orderBy("c", "doc_id").limit(sample_docs)
    few = rows.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").orderBy("doc_id", "text").collect()
    lines = {x for r in few for x in r["text"].split("\n") if x.strip()}
    return fit(sorted(lines, key=lambda x: (zlib.crc32(x.encode("utf-8", "replace")), x))[:SAMPLE_LINES])


def _grams(line: Column) -> Column:
    words = F.filter(F.split(F.lower(line), _SPLIT), lambda w: w != "")
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))


def _anchor(grams: list[str]) -> str:
    """A pattern for the texts that hold one of the bigrams, its alternatives grouped by first letter and first word."""
    tree: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for a, b in (g.split() for g in grams):
        tree[a[0]][a[1:]].append(b)
    words = [x + "(?:" + "|".join(f"{rest}{_SPLIT}(?:{'|'.join(sorted(nexts))})" for rest, nexts in sorted(own.items())) + ")" for x, own in sorted(tree.items())]
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(words) + ")"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, licenses (array of start, end, family, probability, confirmed, by start) for each row of docs.

    Repeated rows, null ids and other columns change nothing; no rows give no rows.

    start, end: code points of the lines in the text, of a wrapped notice from its first to its last line with a bigram
    of the vocabulary. Lines of the unknown class, or of a family below `CERTAIN`, are left out; unconfirmed ones keep
    their family and say so. Null and empty texts have no lines.
    """
    pick = np.flatnonzero(np.abs(model.weights).sum(axis=1))
    own = [model.vocabulary[i] for i in pick]
    vocabulary, names = F.lit(own), F.lit(model.families)
    weights = F.lit([[float(v) for v in row] for row in model.weights[pick] / model.temperature])
    bias = F.lit([float(v) for v in model.bias / model.temperature])
    sides = [(f, sorted(set(bigrams(t)) & set(own)), needed(t, own)) for f, ts in sorted(TEMPLATES.items()) for t in ts]
    templates = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(g).alias("grams"), F.lit(n).alias("needed")) for f, g, n in sides if g])
    anchor = _anchor(own)
    split = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, _MARK, ""))
    rows = docs.select("doc_id", "text", F.lower("text").rlike(anchor).alias("some"))
    rows = rows.select("doc_id", F.when(F.col("some"), F.col("text")).alias("text"), F.when(F.col("some"), split).alias("all"))
    ends = [F.transform("all", lambda x: F.regexp_extract(x, p, 1)) for p in (r"([\p{L}\p{N}]+)", r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$")]
    rows = rows.select("*", ends[0].alias("first"), ends[1].alias("last"))

    def near(words: str, i: Column) -> Column:
        return F.coalesce(F.get(F.col(words), i), F.lit(""))

    wide = F.transform("all", lambda x, i: F.struct(i.alias("i"), x.alias("line"), F.concat_ws(" ", F.when(near("first", i) != "", near("last", i - 1)), x, F.when(near("first", i) != "", near("first", i + 1))).alias("wide")))
    wide = F.filter(wide, lambda x: F.lower(x["wide"]).rlike(anchor))
    rows = rows.select("doc_id", "text", "last", wide.alias("wide"))
    grams = F.transform("wide", lambda x: F.struct(x["i"].alias("i"), F.array_intersect(_grams(x["line"]), vocabulary).alias("grams"), F.array_intersect(_grams(x["wide"]), vocabulary).alias("wide")))
    rows = rows.select("doc_id", "text", "last", F.filter(grams, lambda x: F.size(x["wide"]) > 0).alias("lines"))

    def logits(grams: Column) -> Column:
        return F.aggregate(grams, bias, lambda acc, g: F.zip_with(acc, F.element_at(weights, F.array_position(vocabulary, g).cast("int")), lambda a, w: a + w))

    def decide(grams: Column) -> Column:
        """family, probability, confirmed."""

        def of(z: Column) -> Column:
            top = F.array_max(z)
            family = F.element_at(names, F.array_position(z, top).cast("int"))
            prob = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
            held = F.exists(templates, lambda t: (t["family"] == family) & (F.size(F.array_intersect(t["grams"], grams)) >= t["needed"]))
            return F.struct(family.alias("family"), prob.alias("probability"), held.alias("confirmed"))

        return _let(logits(grams), of)

    def counts(d: Column) -> Column:
        return (d["family"] != UNKNOWN) & (d["probability"] >= CERTAIN)

    lines = F.transform("lines", lambda x: F.struct(x["i"].alias("i"), x["wide"].alias("wide"), F.when(F.size(x["grams"]) > 0, decide(x["grams"])).alias("d")))
    rows = rows.select("doc_id", "text", "last", lines.alias("lines"))
    found, run = "array<struct<family:string,probability:double,confirmed:boolean>>", "struct<a:int,b:int,grams:array<string>>"
    sure = F.filter("lines", lambda x: F.coalesce(counts(x["d"]) & x["d"]["confirmed"], F.lit(False)))
    rest = F.filter("lines", lambda x: ~F.coalesce(counts(x["d"]) & x["d"]["confirmed"], F.lit(False)))
    rows = rows.select("doc_id", "text", "last", F.transform(sure, lambda x: F.struct(x["i"].alias("a"), x["i"].alias("b"), F.array(x["d"]).cast(found).alias("found"))).alias("sure"), rest.alias("rest"))
    # a run begins where the line before it that has a bigram is further off, or a line without a word lies between
    begins = F.filter(F.transform("rest", lambda x, k: F.when((k == 0) | (x["i"] - F.get("rest", k - 1)["i"] > 2) | (F.get("last", x["i"] - 1) == ""), k)), lambda k: k.isNotNull())
    rows = rows.select("*", begins.alias("begins"))
    runs = F.transform("begins", lambda k, n: F.slice("rest", k + 1, F.coalesce(F.get("begins", n + 1), F.size("rest")) - k))
    runs = F.transform(runs, lambda r: F.struct(r[0]["i"].alias("a"), F.element_at(r, -1)["i"].alias("b"), F.array_distinct(F.flatten(F.transform(r, lambda x: x["wide"]))).alias("grams")).cast(run))
    rows = rows.select("doc_id", "text", "sure", runs.alias("runs"))
    of_family = F.create_map(*[x for f in sorted(TEMPLATES) for x in (F.lit(f), F.lit(sorted({g for t in TEMPLATES[f] for g in bigrams(t)})))])

    def take(acc: Column, _: Column) -> Column:
        def with_(d: Column) -> Column:
            left = F.when(counts(d) & d["confirmed"], F.array_except(acc["grams"], of_family[d["family"]])).otherwise(F.lit([]).cast("array<string>"))
            return F.struct(left.alias("grams"), F.when(counts(d), F.concat(acc["found"], F.array(d).cast(found))).otherwise(acc["found"]).alias("found"))

        return F.when(F.size(acc["grams"]) == 0, acc).otherwise(_let(decide(acc["grams"]), with_))

    def taken(x: Column) -> Column:
        start = F.struct(x["grams"].alias("grams"), F.lit([]).cast(found).alias("found"))
        every = F.aggregate(F.sequence(F.lit(1), F.lit(len(TEMPLATES))), start, take, lambda acc: acc["found"])
        # what is left of a confirmed run confirms a family or says nothing
        return F.filter(every, lambda d, k: (k == 0) | d["confirmed"])

    wrapped = F.transform("runs", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), taken(x).alias("found")))
    rows = rows.select("doc_id", "text", F.filter(F.concat("sure", wrapped), lambda x: F.size(x["found"]) > 0).alias("hits"))
    rows = rows.select("doc_id", "hits", F.when(F.size("hits") > 0, F.split("text", "\n", -1)).alias("all"))

    def place(x: Column) -> Column:
        start = F.char_length(F.array_join(F.slice("all", F.lit(1), x["a"]), "\n")) + F.when(x["a"] > 0, 1).otherwise(0)
        n = F.char_length(F.array_join(F.slice("all", x["a"] + 1, x["b"] - x["a"] + 1), "\n"))
        return F.transform(x["found"], lambda d: F.struct(start.alias("start"), (start + n).alias("end"), d["family"].alias("family"), d["probability"].alias("probability"), d["confirmed"].alias("confirmed")))

    empty = F.lit([]).cast("array<struct<start:int,end:int,family:string,probability:double,confirmed:boolean>>")
    return rows.select("doc_id", F.coalesce(F.array_sort(F.flatten(F.transform("hits", place))), empty).alias("licenses"))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """doc_id, families (confirmed, sorted, comma-joined), n_lines (confirmed; a wrapped notice is one), n_unconfirmed, probability (the highest)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs))
    sure = F.filter("licenses", lambda x: x["confirmed"])
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size(sure).cast("long").alias("n_lines"), (F.size("licenses") - F.size(sure)).cast("long").alias("n_unconfirmed"),
        F.coalesce(F.array_max(F.transform(sure, lambda x: x["probability"])), F.lit(0.0)).alias("probability"),
    )
