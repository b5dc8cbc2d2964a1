"""Personal data: patterns, and terms that reveal who is protected by them.

Base spans are e-mail addresses, IP addresses, card and phone numbers. The
information-theoretic part treats each value found as a protected entity. The
corpus gives the probability of an entity, p(e), and of it given a term near
it, p(e | t). A term discloses log(p(e | t) / p(e)) of the entity's own
information -log p(e). What is seen in few texts is moved towards p(e) by
PRIOR_TEXTS texts, so a single text can disclose, but by less. Where the share
reaches the threshold, all places of the term in all texts that hold the
entity are spans of kind `term`, except where they touch other spans.

Counting is by different texts, so that copies of one text are one witness.
Defined results: null and empty texts have no spans; repeated rows have the
same spans; empty tables give empty results; columns besides id and text are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hayrake.session import materialise, prepare

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words on each side of an entity that may reveal it.
NEAR_WORDS = 6
#: Share of an entity's information at which a term is disclosing, and the weight in texts of p(e) in the estimate of p(e | t).
DISCLOSURE = 0.9
PRIOR_TEXTS = 1.0
#: Texts with copies that are broadcast as hash and number; more are joined by a shuffle.
BROADCAST_COPIES = 2_000_000
#: Texts whose disclosing terms are broadcast.
BROADCAST_TEXTS = 200_000
#: Terms that a task counts before it hands the counts on.
HELD_TERMS = 200_000

LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+")
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", TERM: "[TERM]"}


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end (code points) by kind as listed, then start."""
    out = [("email", a, z) for a, z in emails(text)]
    if not re.search("[0-9]", text):
        return out
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def entities_of(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """The protected entity (hash) of each span."""
    value = lambda kind, said: said.lower() if kind == "email" else said if kind == "ip" else re.sub("[^0-9]", "", said)
    return [_hash(kind, value(kind, text[a:z])) for kind, a, z in spans]


def free_words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Lower-case word, start and end of the words outside all spans."""
    out, k, taken = [], 0, []
    for a, z in sorted((a, z) for _, a, z in spans):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(z, taken[-1][1])
        else:
            taken.append([a, z])
    for m in WORD.finditer(text):
        a, z = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or z <= taken[k][0]:
            out.append((m[0].lower(), a, z))
    return out


def context(text: str, spans: list[tuple[str, int, int]]) -> set[tuple[int, str]]:
    """Entity (hash) and lower-case term of the words near each span."""
    words = free_words(text, spans)
    starts = [a for _, a, _ in words]
    out = set()
    for entity, (_, a, z) in zip(entities_of(text, spans), spans):
        before, after = bisect_left(starts, a), bisect_left(starts, z)
        out.update((entity, t) for t, _, _ in [*words[max(0, before - NEAR_WORDS) : before], *words[after : after + NEAR_WORDS]])
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string())]))
_FOUND = "text_hash bigint, spans array<struct<kind: string, start: bigint, end: bigint>>, entities array<bigint>, near array<struct<entity: bigint, term: string>>, text string"


def _found(docs: DataFrame) -> DataFrame:
    """Base spans, their entities and the terms near them of each document, and the text of those that hold an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, entities, near, texts = [], [], [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                own = base_spans(text)
                spans.append([{"kind": k, "start": a, "end": z} for k, a, z in own])
                entities.append(list(dict.fromkeys(entities_of(text, own))))
                near.append([{"entity": e, "term": t} for e, t in context(text, own)] if own else [])
                texts.append(text if own else None)
            cols = [batch.column(1), pa.array(spans, _SPANS), pa.array(entities, pa.list_(pa.int64())), pa.array(near, _NEAR), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "text_hash", "spans", "entities", "near", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, {_FOUND}")


def _term_counts(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """term and texts (how many different texts have it) of all words of all documents.

    copied has text_hash and copies of the texts that several rows have; each of these rows counts as its share of the text.
    """

    def said(counts: dict[str, float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"term": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.float64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, float] = {}
        for batch in batches:
            for value, copies in zip(batch.column(0), batch.column(1).to_pylist()):
                for term in set(WORD.findall((value.as_py() or "").lower())):
                    counts[term] = counts.get(term, 0.0) + 1 / copies
            if len(counts) > HELD_TERMS:
                yield said(counts)
                counts = {}
        yield said(counts)

    copied = F.broadcast(copied) if copied.count() <= BROADCAST_COPIES else copied
    rows = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(copied, "text_hash", "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    return rows.mapInArrow(run, "term string, n double").groupBy("term").agg(F.round(F.sum("n")).cast("bigint").alias("texts"))


def disclosing(found: DataFrame, docs: DataFrame, disclosure: float = DISCLOSURE, prior_texts: float = PRIOR_TEXTS) -> DataFrame:
    """entity, term and disclosed (share of the entity's information) of the terms that reveal an entity."""
    copied = materialise(found.groupBy("text_hash").agg(F.count("*").alias("copies")).filter("copies > 1"), "copied")
    n = max(2, found.count() - (copied.agg(F.sum(F.col("copies") - 1)).first()[0] or 0))
    holding = found.filter(F.size("entities") > 0)
    entities = holding.select(F.explode("entities").alias("entity"), "text_hash").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    near = materialise(holding.select("text_hash", F.explode("near").alias("x")).select("text_hash", "x.entity", "x.term").distinct(), "near")
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_both")).join(entities, "entity")
    least = near.select("term", "text_hash").distinct().groupBy("term").agg(F.count("*").alias("least"))
    prior = F.col("n_entity") / F.lit(float(n))

    def share(texts: str) -> Column:
        given = (F.col("n_both") + prior_texts * prior) / (F.greatest(texts, "n_both") + prior_texts)
        return F.when(prior >= 1.0, F.lit(0.0)).otherwise((F.log(given) - F.log(prior)) / -F.log(prior))

    # A term is in as many texts at least as it is near any entity: pairs that fail even so need no count.
    pairs = materialise(pairs.join(least, "term").filter(share("least") >= disclosure).drop("least"), "pairs")
    counted = pairs.join(_term_counts(docs, copied), "term")
    return counted.select("entity", "term", share("texts").alias("disclosed")).filter(F.col("disclosed") >= disclosure)


def find(docs: DataFrame, disclosure: float = DISCLOSURE, prior_texts: float = PRIOR_TEXTS) -> DataFrame:
    """doc_id, text_hash and spans (array of kind, start, end) of every document: base spans and disclosing terms."""
    prepare(docs.sparkSession)
    found = materialise(_found(docs), "spans")
    shown = disclosing(found, docs, disclosure, prior_texts)
    holding = found.filter(F.size("entities") > 0)
    own = holding.select("text_hash", F.explode("entities").alias("entity")).distinct().join(shown, "entity").groupBy("text_hash").agg(F.collect_set("term").alias("terms"))
    own = materialise(own, "disclosing")
    own = F.broadcast(own) if own.count() <= BROADCAST_TEXTS else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            for k, (text, terms) in enumerate(zip(batch.column(3), batch.column(4))):
                wanted = frozenset(terms.as_py() or ())
                if wanted:
                    base = [(s["kind"], s["start"], s["end"]) for s in spans[k]]
                    spans[k] += [{"kind": TERM, "start": a, "end": z} for t, a, z in free_words(text.as_py(), base) if t in wanted]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS)], ["doc_id", "text_hash", "spans"])

    out = holding.join(own, "text_hash", "left").select("doc_id", "text_hash", "spans", "text", "terms")
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint, spans array<struct<kind: string, start: bigint, end: bigint>>"
    return found.filter(F.size("entities") == 0).select("doc_id", "text_hash", "spans").unionByName(out.mapInArrow(run, kind))


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, prior_texts: float = PRIOR_TEXTS, general: dict[str, str] | None = None) -> DataFrame:
    """docs with each span generalised: replaced by the name of its kind (or by what general says; '' removes it)."""
    names = docs.columns
    at = names.index("text")
    put = GENERAL | (general or {})
    spans = find(docs, disclosure, prior_texts).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names that cannot clash
    same = F.col(f"c{names.index('doc_id')}").eqNullSafe(F.col("_id")) & (F.xxhash64(f"c{at}") == F.col("_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, own in enumerate(batch.column(len(names)).to_pylist()):
                end, parts = 0, []
                for s in sorted(own or (), key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= end:
                        parts += [texts[k][end : s["start"]], put[s["kind"]]]
                        end = s["end"]
                    elif s["end"] > end:
                        end = s["end"]
                if parts:
                    texts[k] = "".join(parts) + texts[k][end:]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if c == at else batch.column(c) for c in range(len(names))], names)

    return plain.join(spans, same, "left").drop("_id", "_hash").mapInArrow(run, docs.schema)
