"""Personal data: patterns, and terms that disclose what is protected.

Protected entities are the matches of four patterns (mail and IP addresses, card and phone numbers) and opaque strings
(long runs of letters and digits mixed: keys, credentials). What reveals them is learned from the corpus: for each term
that occurs near an entity, disclosure is PMI(entity; term) / IC(entity), that is 1 + log P(entity | term) / -log
P(entity); 1 means that the term gives the entity away. It is estimated twice. For an entity by its value, terms count
from `GENERALISE` on; for a kind of entities, which says less of anyone, from `REMOVE` on, with a smoothed P. A pair
needs `SUPPORT` different contexts, so copies of one text prove nothing. Terms above `REMOVE` are removed, above
`GENERALISE` replaced by their class. An opaque string is a secret where a term that discloses opaque strings is near;
others, such as checksums in prose, stay.

Pairs come from the neighbourhoods of entities only and are summed by SQL; how many documents hold a term is counted
only for terms of pairs with enough support. Texts are not shuffled while the disclosing terms fit in `TERMS` (checked);
beyond, they are joined to the documents that hold them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmeter.llm.common import cut

KINDS = ("email", "ip", "card", "phone", "secret", "term")
SECRET, TERM = 4, 5
#: Words on either side of an entity whose co-occurrence counts.
WINDOW = 8
SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.97
#: Disclosing terms that may be sent to all tasks.
TERMS = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}(?![A-Za-z0-9])")
_WORD = regex.compile(r"\p{L}{3,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ has at most one match: from the first character of the run before it to the end of the domain after it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, place of the kind in KINDS, end: of the patterns' matches, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (x.lstrip("0") for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def opaque_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of at least 16 letters and digits, three of either at least, outside of the patterns' matches."""
    if not _DIGIT.search(text):
        return []
    out = []
    for m in _OPAQUE.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if 3 <= digits <= len(m[0]) - 3 and not any(a < m.end() and m.start() < b for a, _, b in base):
            out.append((m.start(), SECRET, m.end()))
    return out


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Whole words in lower case, WINDOW at most, that end before start and that begin after end."""
    wide = 24 * WINDOW
    a, b = max(0, start - wide), min(len(text), end + wide)
    before = [m for m in _WORD.finditer(text[a:start]) if m.start() or not a or not text[a - 1].isalpha()]
    after = [m for m in _WORD.finditer(text[end:b]) if m.end() < b - end or b == len(text) or not text[b].isalpha()]
    return [m[0].lower() for m in before[-WINDOW:]], [m[0].lower() for m in after[:WINDOW]]


def _neighbours(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, str, str, int]]:
    """kind, entity, term, and a number for the context: the words around the entity."""
    for start, kind, end in spans:
        before, after = _around(text, start, end)
        context = hashlib.blake2b(" ".join([*before, "", *after]).encode("utf-8", "replace"), digest_size=8).digest()
        for term in {*before, *after}:
            yield kind, f"{KINDS[kind]}:{text[start:end].lower()}", term, int.from_bytes(context, "little", signed=True)


def _terms_of() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), F.lit(1)))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """term, disclosure, secret: terms of the corpus that reveal an entity at `GENERALISE` or more, or a kind at `REMOVE`.

    The strongest entity counts; secret: whether the term reveals opaque strings as a kind. Null texts have no terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = 0
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                doc += 1
                if text and (spans := [*(base := base_spans(text)), *opaque_spans(text, base)]):
                    rows += [(*x, doc) for x in _neighbours(text, spans)]
            k, e, t, c, d = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_pydict({"kind": pa.array(k, pa.int32()), "entity": pa.array(e, pa.string()), "term": pa.array(t, pa.string()), "context": pa.array(c, pa.int64()), "doc": pa.array(d, pa.int64())})

    near = docs.select("text").mapInArrow(run, "kind int, entity string, term string, context long, doc long")
    near = cut(near.withColumn("doc", F.struct(F.spark_partition_id().alias("p"), "doc")))
    docs_total = docs.count()
    reveal = lambda p: F.lit(1.0) + F.log2(F.least(p, F.lit(1.0))) / -F.log2(F.least(F.col("of") / docs_total, F.lit(1 - 1e-12)))
    of_entity = lambda of_term: reveal(F.col("both") / of_term)
    of_kind = lambda of_term: reveal(F.col("both") / (of_term + 0.5))

    def pairs(key: str) -> DataFrame:
        both = near.groupBy(key, "term").agg(F.count_distinct("doc").alias("both"), F.count_distinct("context").alias("contexts")).filter(F.col("contexts") >= SUPPORT)
        return both.join(near.groupBy(key).agg(F.count_distinct("doc").alias("of")), key)

    # a term is in no fewer documents than it is near some entity in: what fails with that number fails with the true one
    least = near.groupBy("term").agg(F.count_distinct("doc").alias("near"))
    by_entity = pairs("entity").join(least, "term").filter(of_entity(F.col("near")) >= GENERALISE).select("term", F.lit(None).cast("int").alias("kind"), "both", "of")
    by_kind = pairs("kind").join(least, "term").filter(of_kind(F.col("near")) >= REMOVE).select("term", "kind", "both", "of")
    strong = cut(by_entity.unionByName(by_kind))
    candidates = strong.select("term").distinct()
    n = candidates.limit(TERMS + 1).count()
    if not n:
        return strong.select("term", F.lit(1.0).alias("disclosure"), F.lit(False).alias("secret"))
    words = docs.select(F.explode(_terms_of()).alias("term"))
    own = words.join(F.broadcast(candidates) if n <= TERMS else candidates, "term", "left_semi")
    scored = strong.join(own.groupBy("term").agg(F.count(F.lit(1)).alias("have")), "term")
    scored = scored.withColumn("disclosure", F.when(F.col("kind").isNull(), of_entity(F.col("have"))).otherwise(of_kind(F.col("have"))))
    scored = scored.filter(F.col("disclosure") >= F.when(F.col("kind").isNull(), GENERALISE).otherwise(REMOVE))
    return cut(scored.groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.coalesce(F.max(F.col("kind") == SECRET), F.lit(False)).alias("secret")))


_TOKENS = {k: f"[{k.upper()}]" for k in KINDS[:TERM]}


def _term_class(word: str) -> str:
    return "[NAME]" if word[:1].isupper() else "[TERM]"


def _merged_text(text: str, spans: list[tuple[int, int, int]], terms: dict[str, tuple[float, bool]]) -> str:
    out, at = [], 0
    for start, kind, end in spans:
        if start < at:
            continue
        out.append(text[at:start])
        if KINDS[kind] != "term":
            out.append(_TOKENS[KINDS[kind]])
        elif terms[text[start:end].lower()][0] < REMOVE:
            out.append(_term_class(text[start:end]))
        at = end
    return "".join([*out, text[at:]])


def find(docs: DataFrame, with_text: bool = False, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_term, base_sha256, spans for each row; with_text: also the sanitised text.

    A span is kind:start:end in code points, spans are sorted by start and then by kind. A null or empty text has none.
    Long texts are read whole. Rows are independent of each other but for the terms learned from all of them; repeated
    rows, null ids and other columns change nothing.
    """
    terms = disclosing_terms(docs) if terms is None else terms
    rows, known = docs.select("doc_id", "text"), {}
    if terms.limit(TERMS + 1).count() <= TERMS:
        known = {r["term"]: (r["disclosure"], r["secret"]) for r in terms.collect()}
        rows = rows.withColumn("terms", F.lit(None).cast("array<struct<term:string,disclosure:double,secret:boolean>>"))
    else:
        rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))
        words = rows.select("rid", F.explode(_terms_of()).alias("term"))
        own = words.join(terms, "term").groupBy("rid").agg(F.collect_list(F.struct("term", "disclosure", "secret")).alias("terms"))
        rows = rows.join(own, "rid", "left").drop("rid")

    def all_spans(text: str, base: list[tuple[int, int, int]], own: dict[str, tuple[float, bool]]) -> list[tuple[int, int, int]]:
        if not own:
            return base
        found = [(m.start(), TERM, m.end()) for m in _WORD.finditer(text) if m[0].lower() in own]
        if not found:
            return base
        found = [x for x in found if not any(a < x[2] and x[0] < b for a, _, b in base)]
        if any(own[text[a:b].lower()][1] for a, _, b in found):
            for a, k, b in opaque_spans(text, base):
                if any(own.get(w, (0, False))[1] for side in _around(text, a, b) for w in side):
                    found.append((a, k, b))
        return sorted([*base, *found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, every, clean = [], [], []
            for text, more in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                own = {x["term"]: (x["disclosure"], x["secret"]) for x in more} if more else known
                spans = all_spans(text, base, own)
                for k in range(len(KINDS)):
                    counts[k].append(sum(x[1] == k for x in spans))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest())
                every.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans))
                if with_text:
                    clean.append(_merged_text(text, spans, own))
            out = {"doc_id": batch.column("doc_id"), **{f"n_{k}": pa.array(n, pa.int64()) for k, n in zip(KINDS, counts, strict=True)}}
            out |= {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(every, pa.string())}
            yield pa.RecordBatch.from_pydict(out | ({"text": pa.array(clean, pa.string())} if with_text else {}))

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string" + ", text string" * with_text)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
