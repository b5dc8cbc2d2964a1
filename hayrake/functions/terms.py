"""Terms of whole tables of texts, counted in bulk, and scores of their records; all in Arrow batches.

A record is a row's whole part of an inverted index: row_id and, for each of
its fields with terms, the field, dl (all its tokens) and its terms with
their tf. A row's counts and scores need nothing but its own record, so
neither counting nor scoring deals rows out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FIELDS = "array<struct<field: string, dl: bigint, terms: array<struct<term: string, tf: bigint>>>>"
#: Words whose terms a task remembers, and their longest.
WORDS, LONGEST = 200_000, 64
#: Cells (rows times queries) that are summed at once, and candidates that a task holds besides its best.
CELLS, HELD = 1_000_000, 500_000

#: What stands about a word's letters, and words without it that are one term.
_EDGES, _ONE = "^[^A-Za-z0-9_-]+|[^A-Za-z0-9_-]+$", "^(?:[A-Z]?[a-z0-9]+|[A-Z0-9]+)$"
_WHOLE = re.compile(rb"[A-Za-z0-9_-]+")
_OTHER = re.compile(rb"[^A-Za-z0-9]+")
_RUN = re.compile(rb"([A-Z])([A-Z][a-z])")
_HUMP = re.compile(rb"([a-z])([A-Z])")


def word_terms(word: bytes) -> tuple[bytes, ...]:
    """The terms of a word in UTF-8, as `text.split_identifier` finds them."""
    parts = _OTHER.split(_HUMP.sub(rb"\1 \2", _RUN.sub(rb"\1 \2", word)).lower())
    if _WHOLE.fullmatch(word):
        parts.insert(0, word.lower())
    return tuple(dict.fromkeys(filter(None, parts)))


def count_terms(texts: pa.Array, known: dict[bytes, tuple[bytes, ...]]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, term and tf of every different term of every text, by row. Each different word is split once; known remembers short ones."""
    words = pc.ascii_split_whitespace(texts)
    flat, rows = pc.list_flatten(words).dictionary_encode(), pc.list_parent_indices(words).to_numpy()
    bare = pc.replace_substring_regex(flat.dictionary.cast(pa.binary()), pattern=_EDGES, replacement="")
    one = pc.match_substring_regex(bare, _ONE)
    more, many = [], np.flatnonzero(~one.to_numpy(zero_copy_only=False))
    for w in flat.dictionary.cast(pa.binary()).take(pa.array(many)).to_pylist():
        found = known.get(w)
        if found is None:
            found = word_terms(w)
            if len(w) <= LONGEST:
                if len(known) >= WORDS:
                    known.clear()
                known[w] = found
        more.append(found)
    ones = pc.ascii_lower(bare.filter(one).cast(pa.string()))
    terms = pa.concat_arrays([ones, pa.array(chain.from_iterable(more), pa.binary()).cast(pa.string())]).dictionary_encode()
    sizes = np.ones(len(bare), np.int64)
    sizes[many] = np.fromiter(map(len, more), np.int64, len(more))
    starts = np.cumsum(one.to_numpy(zero_copy_only=False)) - 1
    starts[many] = len(ones) + np.cumsum(sizes[many]) - sizes[many]
    codes, of = terms.indices.to_numpy(), flat.indices.to_numpy()
    rows, at = np.repeat(rows, sizes[of]), _ranges(starts[of], sizes[of])
    n = max(len(terms.dictionary), 1)
    keys = np.sort(rows.astype(np.int64) * n + codes[at])
    firsts = _firsts(keys)
    keys, tf = keys[firsts], np.diff(np.append(firsts, len(keys)))
    return keys // n, terms.dictionary.take(pa.array(keys % n)), tf


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then those of starts[1], and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Places at which a run of equal rows begins."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def recorder(fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: records of rows (row_id and text columns); rows without terms have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[bytes, ...]] = {}
        for batch in batches:
            parts = [count_terms(batch.column(f), known) for f in fields]
            row = np.concatenate([p[0] for p in parts])
            if not len(row):
                continue
            field = np.repeat(np.arange(len(fields)), [len(p[0]) for p in parts])
            order = np.lexsort((field, row))
            row, field, tf = row[order], field[order], np.concatenate([p[2] for p in parts])[order]
            term = pa.concat_arrays([p[1] for p in parts]).take(pa.array(order))
            groups = _firsts(row, field)
            rows = _firsts(row[groups])
            ends = lambda firsts, n: pa.array(np.append(firsts, n), pa.int32())
            terms = pa.ListArray.from_arrays(ends(groups, len(row)), pa.StructArray.from_arrays([term, pa.array(tf)], ["term", "tf"]))
            names = pa.DictionaryArray.from_arrays(pa.array(field[groups], pa.int32()), pa.array(fields, pa.string())).dictionary_decode()
            own = pa.StructArray.from_arrays([names, pa.array(np.add.reduceat(tf, groups)), terms], ["field", "dl", "terms"])
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(row[groups][rows])), pa.ListArray.from_arrays(ends(rows, len(groups)), own)], ["row_id", "fields"])

    return run


def rounded(x: np.ndarray, decimals: int) -> np.ndarray:
    """x as Spark's round gives it: half up, by the decimal digits of the number."""
    scaled = x * 10.0**decimals
    whole = np.floor(scaled)
    part = scaled - whole
    out = (whole + (part >= 0.5)) / 10.0**decimals
    for k in np.flatnonzero((np.abs(part - 0.5) < 1e-3) | (np.abs(scaled) > 1e12)):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP))
    return out


def scorer(known: pa.Table, k1: float, b: float, decimals: int, limit: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over records: query_id, row_id and score of rows that share a term with a query.

    known: query_id, field, term, w, avgdl. With a limit only each task's best
    rows of each query leave it (score falling, row_id rising).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = lambda name: known.column(name).combine_chunks()
        asked, terms, fields = (column(c).dictionary_encode("encode") for c in ("query_id", "term", "field"))
        q_of, t_of, f_of = (x.indices.to_numpy().astype(np.int64) for x in (asked, terms, fields))
        nq, nt, nf = len(asked.dictionary), len(terms.dictionary), len(fields.dictionary)
        weight, mean = np.zeros((nf, nt)), np.full((nf, nt), np.nan)
        weight[f_of, t_of], mean[f_of, t_of] = column("w").to_numpy(), column("avgdl").to_numpy()
        pairs = np.unique(t_of * nq + q_of)  # a query of a term once, whatever the fields
        queries, counts = pairs % nq, np.bincount(pairs // nq, minlength=nt)
        starts = np.cumsum(counts) - counts
        least, held, n_held = np.full(nq, -np.inf), [], 0

        def told(q: np.ndarray, ids: pa.Array, score: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(q), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([asked.dictionary.take(pa.array(q[part])), ids[part], pa.array(score[part])], ["query_id", "row_id", "score"])

        def best(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, ids, score = (np.concatenate(x) for x in zip(*parts))
            score = rounded(score, decimals)
            order = np.lexsort((ids, -score, q))
            q, ids, score = q[order], ids[order], score[order]
            firsts = _firsts(q)
            place = np.arange(len(q)) - np.repeat(firsts, np.diff(np.append(firsts, len(q))))
            last = place == limit - 1
            least[q[last]] = score[last]
            return q[place < limit], ids[place < limit], score[place < limit]

        for batch in batches:
            ids = batch.column("row_id")
            groups, group_row = pc.list_flatten(batch.column("fields")), pc.list_parent_indices(batch.column("fields")).to_numpy()
            own = pc.struct_field(groups, "terms")
            flat, hit_group = pc.list_flatten(own), pc.list_parent_indices(own).to_numpy()
            code = pc.fill_null(pc.index_in(pc.struct_field(flat, "term"), value_set=terms.dictionary), -1).to_numpy()
            field = pc.fill_null(pc.index_in(pc.struct_field(groups, "field"), value_set=fields.dictionary), -1).to_numpy()
            hits = np.flatnonzero(code >= 0)
            hits = hits[field[hit_group[hits]] >= 0]
            g, t = hit_group[hits], code[hits].astype(np.int64)
            f, row = field[g], group_row[g].astype(np.int64)
            tf, dl = pc.struct_field(flat, "tf").to_numpy()[hits].astype(float), pc.struct_field(groups, "dl").to_numpy()[g].astype(float)
            there = ~np.isnan(mean[f, t])
            row, t, f, tf, dl = row[there], t[there], f[there], tf[there], dl[there]
            part = weight[f, t] * tf / (tf + k1 * (1 - b + b * dl / mean[f, t]))
            step = max(1, CELLS // nq)
            for first in range(0, len(ids), step):
                a, z = np.searchsorted(row, (first, first + step))
                size = counts[t[a:z]]
                cell = np.repeat((row[a:z] - first) * nq, size) + queries[_ranges(starts[t[a:z]], size)]
                total = np.bincount(cell, weights=np.repeat(part[a:z], size))
                at = np.flatnonzero(np.bincount(cell))
                q, r, score = at % nq, at // nq + first, total[at]
                if limit is None:
                    yield from told(q, ids.take(pa.array(r)), score)
                    continue
                good = score >= least[q] - 2 * 10.0**-decimals
                q, r, score = q[good], r[good], score[good]
                if ids.null_count:  # a row without an id, of which there is one, is not weighed against others here
                    none = ids.is_null().to_numpy(zero_copy_only=False)[r]
                    yield from told(q[none], pa.nulls(none.sum(), ids.type), rounded(score[none], decimals))
                    q, r, score = q[~none], r[~none], score[~none]
                held.append((q, pc.fill_null(ids, 0).to_numpy()[r], score))
                n_held += len(q)
                if n_held > HELD + nq * limit:
                    held = [best(held)]
                    n_held = len(held[0][0])
        if n_held:
            q, r, score = best(held)
            yield from told(q, pa.array(r), score)

    return run
