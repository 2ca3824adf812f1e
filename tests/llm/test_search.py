"""Personal data, near duplicates, benchmark passages, the pipeline."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from callmeter.llm import decontaminate, exact_dedup, jaccard_join, pii

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 12 <= len(digits) <= 19 and luhn(digits) or kind == 3 and 9 <= len(digits) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


PARTS = ["a", "b.", "@", "x-y", "1", "22", "255", "256", "0", ".", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "com", "@@", "+1 555 123 4567", "10.0.0.1", "é", "\n"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_disclosing_terms(spark, docs):
    r = random.Random(1)
    filler = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    rows = [(i, " ".join(r.sample(filler, 8)) + f" Quillon boss@corp.example {' '.join(r.sample(filler, 8))}") for i in range(6)]
    rows += [(10 + i, " ".join(r.sample(filler, 30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in pii.find(df, with_text=True).collect()}
    assert all(got[i]["n_email"] == 1 and got[i]["n_term"] == 1 and "term:" in got[i]["spans"] for i in range(6))
    assert "Quillon" not in got[0]["text"] and "[EMAIL]" in got[0]["text"]
    assert all(got[10 + i]["spans"] == "" and got[10 + i]["text"] == dict(rows)[10 + i] for i in range(60))
    limit = pii.TERMS
    try:
        pii.TERMS = 0  # the other way: terms are joined to the documents
        assert {x["doc_id"]: x["spans"] for x in pii.find(df).collect()} == {k: v["spans"] for k, v in got.items()}
    finally:
        pii.TERMS = limit
    assert pii.find(docs).count() == docs.count()


def near_copies(n, seed):
    r = random.Random(seed)
    words = [f"v{r.randrange(5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(words)
        w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def brute_classes(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    rep = {}
    for d in sorted(sets):
        if sets[d]:
            rep.setdefault(sets[d], d)
    top, links = {d: d for d in rep.values()}, {d: 0 for d in rep.values()}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    own = list(rep.items())
    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[x] += 1
                links[y] += 1
                u, v = root(x), root(y)
                top[max(u, v)] = min(u, v)
    return {d: (root(rep[s]), rep[s], links[rep[s]]) if s else (d, d, 0) for d, s in sets.items()}


def test_jaccard_join(spark, docs):
    texts = [x for s in range(4) for x in near_copies(12, s)] + near_copies(90, 9) + ["short one", "short one", "other", "", None]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    small, block = jaccard_join.SMALL, jaccard_join.BLOCK
    try:
        jaccard_join.SMALL, jaccard_join.BLOCK = 8, 10  # splits buckets, and lays large ones out in blocks
        got = {r["doc_id"]: (r["class_id"], r["rep_id"], r["n_links"]) for r in jaccard_join.near_duplicates(df).collect()}
    finally:
        jaccard_join.SMALL, jaccard_join.BLOCK = small, block
    assert got == brute_classes(rows)
    assert jaccard_join.near_duplicates(docs).count() == docs.count()
    assert jaccard_join.near_duplicates(docs.filter("doc_id < 0")).count() == 0
    assert sorted((r["doc_id"] or 0) for r in jaccard_join.keep_representatives(docs).collect()) == [1, 3, 4, 5, 7, 8]
    repeated = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (2, texts[1]), (3, texts[1] + " x"), (3, texts[20])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join.near_duplicates(repeated).collect())
    assert got == [(1, 1, 2, 2), (1, 1, 2, 2), (2, 1, 2, 1), (3, 1, 2, 1), (3, 3, 0, 1)]


def banded(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages(spark, docs, monkeypatch):
    r = random.Random(2)
    letters = "abcdefghijklmnop "
    make = lambda n: "".join(r.choice(letters) for _ in range(n)).strip() or "a"
    prompt = make(100)  # of three items
    bench = [make(90 + 20 * i) for i in range(5)] + [prompt + " " + make(40 * i) for i in range(3)] + ["tiny", None, ""]
    texts = []
    for i in range(40):
        b = list(decontaminate.normal(bench[i % 8]))
        for _ in range(i // 2):
            p = r.randrange(len(b))
            b[p : p + r.randrange(2)] = r.choice(["", "x", "qq"])
        texts.append(make(50) + " " + "".join(b) + " " + make(50))
    index = decontaminate.Index(bench)
    found = lambda: {(h.doc, item) for h in index.search([decontaminate.normal(t) for t in texts]) for item in index.items[h.window]}
    got = found()
    want = {
        (d, item) for d, t in enumerate(texts) for w in range(len(index.windows)) for item in index.items[w]
        if w not in index.short and banded("".join(map(chr, index.windows[w])), decontaminate.normal(t)) <= index.edits[w]
    }
    assert got == want
    for name, value in (("POSTINGS", 50), ("BANDS", 3)):  # q-grams and bands in many parts
        monkeypatch.setattr(decontaminate, name, value)
    assert found() == want
    a = spark.createDataFrame(list(enumerate(texts)) + [(100, None), (101, ""), (102, "a tiny thing")], "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    rows = {(x["doc_id"], x["item_id"]) for x in decontaminate.passages(a, b).collect()}
    assert rows == want | {(102, 8)}
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.passages(a, b, block_chars=300).collect()} == rows
    assert decontaminate.passages(docs, b).count() == 0 and decontaminate.drop_leaks(docs, b).count() == docs.count()
    assert decontaminate.passages(a, b.filter("item_id < 0")).count() == 0


def test_pipeline(spark, tmp_path):
    r = random.Random(4)
    bench = " ".join(f"b{r.randrange(10**6)}" for _ in range(30))
    near = near_copies(3, 1)
    texts = ["clean text one here", "clean  text one here", "123 456", None, *near, "before " + bench + " after", "another clean text of some words"]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(x["doc_id"] for x in got.collect()) == [1, 4, 8]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert exact_dedup.keep_one(docs).count() == 8


@pytest.mark.parametrize("stored", [False, True])
def test_stages_decide_for_rows_not_ids(spark, tmp_path, stored):
    r = random.Random(8)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
    bench, a, b, c, d = (text() for _ in range(5))
    near = a + " more"
    rows = [(None, a), (None, b), (None, f"x {bench} y"), (1, c), (1, d), (1, f"z {bench}"), (2, c + "  "), (0, a + " "), (3, near), (3, text())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if stored:
        df.write.parquet(str(tmp_path / "d"))
        df = spark.read.parquet(str(tmp_path / "d"))
    left = lambda x: sorted((y["doc_id"] or 0, y["text"]) for y in x.collect())
    want = lambda drop: sorted((i or 0, t) for k, (i, t) in enumerate(rows) if k not in drop)
    assert left(exact_dedup.keep_one(df)) == want({0, 3})
    assert left(decontaminate.drop_leaks(df, spark.createDataFrame([(0, bench)], "item_id long, text string"))) == want({2, 5})
    assert left(jaccard_join.keep_representatives(df)) == want({0, 2, 6, 8})


def test_columns_named_as_results_do_no_harm(spark):
    """Columns called as results or helpers, and texts of a script that no language has been learned of."""
    from callmeter.llm import lang_id

    text = "the house of the man with the dog that was in the garden and which they have from this " * 4
    strange = "".join(chr(0x3B1 + i * 7 % 25) + " " * (i % 5 == 4) for i in range(400))
    rows = [(1, text, "en"), (2, text + "more", "en"), (3, strange, None), (4, "kurz", "de"), (5, None, None), (6, "123", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = ["score", "cosine", "lang_pred", "_row", "_file", "_at", "_number", "kept_id", "_leak", "row", "root", "rep", "bucket", "a.b"]
    df = df.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    profiles = lang_id.train(spark.createDataFrame([("en", text), ("de", "der hund ist in dem garten und das haus ist kurz " * 4)], "lang string, text string"))
    left = lambda x: sorted(r["doc_id"] for r in x.collect())
    bench = spark.createDataFrame([(0, strange)], "item_id long, text string")
    stages = [(lang_id.has_language(df, profiles), [1, 2, 4]), (exact_dedup.keep_one(df), [1, 2, 3, 4, 5, 6]), (jaccard_join.keep_representatives(df), [1, 3, 4, 5, 6]), (decontaminate.drop_leaks(df, bench), [1, 2, 4, 5, 6])]
    for got, want in stages:
        assert got.columns == df.columns and left(got) == want
    predicted = lang_id.predict(df, profiles)
    assert predicted.columns.count("score") == 1 and {r["score"] > 0.5 for r in predicted.filter("doc_id < 3").collect()} == {True}
