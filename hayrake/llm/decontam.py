"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Training words stream through the automaton, which tracks the longest match
that ends at each word. Where it reaches a window (``window`` words, or all
words of a shorter item) the window's words are hit. Vectorised exact tests
come first: only runs of words and word pairs that occur in the items reach
the automaton.

Defined results: null and empty texts have no words; items without words
match nothing; repeated items and documents count as they are; empty tables
give empty or clean results; columns besides ids and texts are ignored by
`contamination` and kept by `remove_contamination`, whatever their names. The
longest match is known up to PART_WORDS words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrake.llm import texts as T
from hayrake.session import materialise, prepare

WINDOW = 10
#: Bytes of item texts in one automaton. More items make more passes over the documents' texts, each of which writes hits only.
BLOCK_BYTES = 512 << 10
#: Items of more words are cut into parts of so many, which overlap by a window less a word and so have the same windows.
PART_WORDS = 8192
#: Documents with hits, of several passes, that are broadcast with them; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

_automata: dict[tuple, Automaton] = {}


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        column = pa.array([t for _, t in items], pa.large_string())
        data, offsets = T.text_bytes(column)
        s, e, rows, hashes = T.words(data, offsets, T.ALNUM)
        low = T.LOWER[data].tobytes()
        bounds = T.row_bounds(rows, len(items))
        whole = window
        ends: list[tuple[int, int, int]] = []  # state of a prefix, words of it, item
        for k in range(len(items)):
            last = 0
            for n, i in enumerate(range(bounds[k], bounds[k + 1]), 1):
                last = self._extend(last, low[s[i] : e[i]])
                ends.append((last, n, k))
            if 0 < bounds[k + 1] - bounds[k]:
                whole = min(whole, int(bounds[k + 1] - bounds[k]))
        self.least = whole
        self.names = [i for i, _ in items]
        sizes = np.diff(bounds)
        self.items: dict[int, set[int]] = {}  # by state of a window: items that hold it
        self.short: dict[int, int] = {}  # states that are a whole short item: its words
        for state, n, k in ends:
            if n >= window:
                self.items.setdefault(self.at_window(state), set()).add(k)
            elif n == sizes[k]:
                self.items.setdefault(state, set()).add(k)
                self.short[state] = n
        self.words = np.unique(hashes)
        same = rows[1:] == rows[:-1] if len(rows) else np.zeros(0, dtype=bool)
        self.pairs = np.unique(pair(hashes[:-1], hashes[1:])[same]) if len(hashes) else hashes
        self.nearest = [self._nearest(v) for v in range(len(self.next))] if self.short else None

    def _extend(self, last: int, word: bytes) -> int:
        got = self.next[last].get(word)
        if got is not None:
            if self.length[got] == self.length[last] + 1:
                return got
            return self._split(last, got, word)
        cur = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return cur

    def _new(self, length: int, to: dict[bytes, int], link: int) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def at_window(self, state: int) -> int:
        """The state of the last ``window`` words of a state's string."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _nearest(self, state: int) -> tuple[int, ...]:
        """Short items that are suffixes of a state's string, by their states."""
        out = []
        while state > 0:
            if state in self.short:
                out.append(state)
            state = self.link[state]
        return tuple(out)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit ranges of words, items and the longest match."""
        state, n, longest = 0, 0, 0
        hits, items = [], set()
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            to = self.next[state].get(w)
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            longest = max(longest, n)
            if n >= self.window:
                v = self.at_window(state)
                items |= self.items[v]
                hits.append((i + 1 - self.window, i + 1))
            if self.nearest:
                for v in self.nearest[state]:
                    if self.short[v] <= n:
                        items |= self.items[v]
                        hits.append((i + 1 - self.short[v], i + 1))
        return hits, items, longest


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return T.mix(a * np.uint64(3) + T.mix(b))


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def forget() -> None:
    _automata.clear()


def automaton(items: list[tuple[str, str]], window: int) -> Automaton:
    key = (window, hash(tuple(items)))
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(items, window)
    return _automata[key]


def scan(column: pa.Array, auto: Automaton) -> Iterator[tuple[int, list[tuple[int, int]], set[int], int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: words, hit word ranges, items, longest match, word starts and ends (bytes), its bytes."""
    data, offsets = T.text_bytes(column)
    for lo, hi in T.groups_of_rows(offsets):
        part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        s, e, rows, h = T.words(part, offs, T.ALNUM)
        bounds = T.row_bounds(rows, hi - lo)
        known = member(h, auto.words)
        joined = np.zeros(len(h), dtype=bool)  # with the next word
        both = np.flatnonzero(known[:-1] & known[1:] & (rows[1:] == rows[:-1])) if len(h) else np.zeros(0, dtype=np.int64)
        joined[both] = member(pair(h[both], h[both + 1]), auto.pairs)
        first = known & ~np.concatenate([[False], joined[:-1]]) if len(h) else known
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(known & ~joined) + 1
        keep = ends - starts >= auto.least
        found: dict[int, tuple[list, set, int]] = {}
        for a, z in zip(starts[keep], ends[keep]):
            words = [T.LOWER[part[s[i] : e[i]]].tobytes() for i in range(a, z)]
            hits, items, longest = auto.match(words)
            if hits:
                got = found.setdefault(int(rows[a]), ([], set(), 0))
                base = int(a - bounds[rows[a]])
                got[0].extend((x + base, y + base) for x, y in hits)
                got[1].update(items)
                found[int(rows[a])] = (got[0], got[1], max(got[2], longest))
        for k in range(hi - lo):
            hits, items, longest = found.get(k, ([], set(), 0))
            w = slice(bounds[k], bounds[k + 1])
            yield int(bounds[k + 1] - bounds[k]), merged(hits), items, longest, s[w] - offs[k], e[w] - offs[k], part[offs[k] : offs[k + 1]]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _parts(benchmark: DataFrame, window: int) -> DataFrame:
    """name and text of the different items, long ones in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(PART_WORDS, window)
        for batch in batches:
            names, texts = [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, offsets = T.text_bytes(pa.array([value.as_py()], pa.large_string()))
                s, e, _, _ = T.words(data, offsets, T.ALNUM)
                for at in range(0, max(1, len(s) - window + 1), size - window + 1):
                    last = min(at + size, len(s))
                    names.append(name)
                    texts.append(data[s[at] : e[last - 1]].tobytes().decode() if len(s) else "")
            yield pa.RecordBatch.from_pydict({"name": names, "text": texts})

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return items.distinct().mapInArrow(run, "name string, text string").distinct()


def _blocks(benchmark: DataFrame, window: int) -> Iterator[tuple[list[tuple[str, str]], int]]:
    """Item names and texts, in blocks of about BLOCK_BYTES, one in the driver at a time, and the number of blocks."""
    items = materialise(_parts(benchmark, window), "items")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield sorted((r.name, r.text) for r in own.collect()), n


_HITS = "_words bigint, _hits array<bigint>, _items array<string>, _longest bigint"
_HITS_ARROW = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64()]


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, finish: Callable[[pa.RecordBatch], pa.RecordBatch], kind: str) -> DataFrame:
    """What finish makes of docs with four last columns: words, hits (starts and ends of hit word ranges in turn), items and longest match.

    With one block of items this is one pass; with more, each block's pass
    writes the hits of the documents that have some, and they are joined.
    """
    spark = prepare(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    passes = []
    for block, n in _blocks(benchmark, window):
        shared = spark.sparkContext.broadcast(block)

        def rows(column: pa.Array, shared=shared) -> list[pa.Array]:
            T.begin("decontam", forget)
            auto = automaton(shared.value, window)
            cols: tuple[list, ...] = ([], [], [], [])
            for n_words, hits, items, longest, *_ in scan(column, auto):
                for c, v in zip(cols, (n_words, [x for r in hits for x in r], sorted({auto.names[x] for x in items}), longest)):
                    c.append(v)
            return [pa.array(c, t) for c, t in zip(cols, _HITS_ARROW)]

        def whole(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = rows(batch.column(at))
                yield finish(pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *"0123"]))

        def some(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = rows(batch.column(2))
                keep = pa.array([len(x) > 0 for x in found[1]], pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *found], ["_id", "_hash", "_words", "_hits", "_items", "_longest"]).filter(keep)

        if n == 1:
            return docs.mapInArrow(whole, kind)
        own = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text").mapInArrow(some, f"_id {docs.schema['doc_id'].dataType.simpleString()}, _hash bigint, {_HITS}")
        passes.append(materialise(own.dropDuplicates(["_id", "_hash"]), "hits"))
    found = passes[0]
    for more in passes[1:]:
        found = found.union(more)
    found = materialise(found.groupBy("_id", "_hash").agg(F.flatten(F.collect_list("_hits")).alias("_hits"), F.flatten(F.collect_list("_items")).alias("_items"), F.max("_longest").alias("_longest")), "hits")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items, longest = (batch.column(len(names) + c).to_pylist() for c in range(3))
            data, offsets = T.text_bytes(batch.column(at))
            sizes = np.diff(T.row_bounds(T.words(data, offsets, T.ALNUM)[2], len(batch)))
            hits = [[x for r in merged(list(zip(h[::2], h[1::2]))) for x in r] if h else [] for h in hits]
            cols = [pa.array(c, t) for c, t in zip((sizes, hits, [sorted(set(x or ())) for x in items], [x or 0 for x in longest]), _HITS_ARROW)]
            yield finish(pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *cols], [*names, *"0123"]))

    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names that cannot clash
    same = F.col(f"c{names.index('doc_id')}").eqNullSafe(F.col("_id")) & (F.xxhash64(f"c{at}") == F.col("_hash"))
    return plain.join(found, same, "left").drop("_id", "_hash").mapInArrow(joined, kind)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (as strings), hits (word ranges), longest."""
    finish = lambda batch: pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:]], ["doc_id", "_words", "_hits", "_items", "_longest"])
    found = _marked(docs.select("doc_id", "text"), benchmark, window, finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_HITS}")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_hits") / 2).cast("int") - 1), lambda i: F.struct(F.element_at("_hits", 2 * i + 1).alias("first"), F.element_at("_hits", 2 * i + 2).alias("end")))
    hits = F.when(F.size("_hits") == 0, F.expr("cast(array() as array<struct<first: bigint, end: bigint>>)")).otherwise(pairs)
    return found.select("doc_id", F.col("_words").alias("n_words"), hits.alias("hits"), F.col("_items").alias("item_ids"), F.col("_longest").alias("longest")).withColumn(
        "n_hit", F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, h: a + h.end - h.first)
    )


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, max_length: int = 200) -> DataFrame:
    """docs without benchmark passages.

    Hit word ranges are cut out of the text, with the blanks after them. A
    document goes altogether if more than max_coverage of its words are hit
    or one match is longer than max_length words.
    """
    names = docs.columns
    at = names.index("text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        totals, hits, longest = (batch.column(len(names) + c).to_pylist() for c in (0, 1, 3))
        covered = [sum(h[1::2]) - sum(h[::2]) for h in hits]
        keep = [c <= max_coverage * n and m <= max_length for c, n, m in zip(covered, totals, longest)]
        rows = [k for k, h in enumerate(hits) if h and keep[k]]
        cols = batch.columns[: len(names)]
        if rows:
            texts = batch.column(at).to_pylist()
            data, offsets = T.text_bytes(pa.array([texts[k] for k in rows], pa.large_string()))
            s, e, r, _ = T.words(data, offsets, T.ALNUM)
            bounds = T.row_bounds(r, len(rows))
            for j, k in enumerate(rows):
                own, base = data[offsets[j] : offsets[j + 1]], bounds[j]
                left, last = [], 0
                for first, end in zip(hits[k][::2], hits[k][1::2]):
                    a = int(s[base + first] - offsets[j])
                    z = int(s[base + end] - offsets[j]) if base + end < bounds[j + 1] else len(own)
                    left.append(own[last:a].tobytes())
                    last = z
                texts[k] = (b"".join(left) + own[last:].tobytes()).decode("utf-8", "replace")
            cols[at] = pa.array(texts, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))

    return _marked(docs, benchmark, window, cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
