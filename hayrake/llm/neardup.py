"""Near-duplicate documents by HyperMinHash sketches.

A document is its set of word shingles. One hash of each shingle chooses one
of 256 buckets; a bucket keeps its smallest hash as a register of leading-zero
count and mantissa bits. Empty buckets of small sets borrow a register, in a
fixed random order, so that registers agree with a probability near the
Jaccard similarity whatever the size of the set. Bands of six registers give
candidates; the estimate from the registers, corrected for chance agreement,
drops hopeless ones; every link is confirmed on the full sets.

Groups of any size are handled without all their pairs: equal sets become one
node first; then members of a band are compared with one hub; the members of
bands that still span several components are compared with each other, small
bands as pairs, large ones in square blocks whose tasks return only the links
that join components. Nothing is capped.

Defined results: null, empty and blank texts have no set and no links; a null
doc_id is an id like another but never the smallest, unless there is no other;
repeated rows share a component, and `deduplicate` keeps one; an empty table
gives an empty result; columns besides id and text are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hayrake.llm import texts as T
from hayrake.llm.graph import components
from hayrake.session import materialise, prepare

SHINGLE = 5
SIMILARITY = 0.8
BUCKETS = 256
MANTISSA = 10
ROWS = 6
BANDS = BUCKETS // ROWS
#: Largest band whose members are compared as pairs; larger ones go in blocks of BLOCK members.
SMALL = 32
BLOCK = 512
#: Bytes of sets in a block, about.
CELL_BYTES = 16 << 20
#: Tables of at most so many rows of a few numbers are broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 500_000

_order = np.argsort(np.argsort(np.random.default_rng(20240501).random((BUCKETS, BUCKETS)), axis=1), axis=1).astype(np.uint16)


def shingle_sets(column: pa.Array, size: int, seed: int = 0) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = T.text_bytes(column)
    for lo, hi in T.groups_of_rows(offsets):
        part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        _, _, rows, h = T.words(part, offs, T.NOT_SPACE)
        bounds = T.row_bounds(rows, hi - lo)
        with np.errstate(over="ignore"):
            h = T.mix(h + np.uint64(seed))
            g = h[: max(0, len(h) - size + 1)].copy()
            for k in range(1, size):
                g = T.mix(g * np.uint64(3) + h[k : k + len(g)])
        for k in range(hi - lo):
            a, z = bounds[k], bounds[k + 1]
            if z - a >= size:
                yield np.unique(g[a : z - size + 1])
            elif z > a:
                with np.errstate(over="ignore"):
                    whole = np.uint64(z - a)
                    for x in h[a:z]:
                        whole = T.mix(np.array([whole * np.uint64(5) + x]))[0]
                yield np.array([whole], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def sketch(items: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set of hashes: 0 if the bucket is empty."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    if len(items):
        bucket = (items >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        value = (items[first] << np.uint64(8)) | np.uint64(255)
        zeros = np.minimum(63 - np.floor(np.log2(value.astype(np.float64))).astype(np.int64), 53).clip(0)
        mantissa = ((value << zeros.astype(np.uint64)) >> np.uint64(63 - MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
        out[bucket[first]] = ((zeros + 1) << MANTISSA) | mantissa
    return out


def filled(registers: np.ndarray) -> np.ndarray:
    """Registers with the empty ones borrowed from the non-empty bucket that comes first in their own order."""
    full = np.flatnonzero(registers)
    if len(full) in (0, BUCKETS):
        return registers
    empty = np.flatnonzero(registers == 0)
    out = registers.copy()
    out[empty] = registers[full[_order[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """BANDS keys for each row of filled registers."""
    parts = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = T.mix(key * np.uint64(31) + parts[:, :, k])
    return key


def possible(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches may belong to sets of that similarity (five standard errors of leave).

    Of n buckets that either set uses, k registers agree. Unequal minima
    agree by chance with a probability below 2**-MANTISSA, so the corrected
    estimate is (k / n - c) / (1 - c).
    """
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1)
    chance = 2.0**-MANTISSA
    estimate = (same / np.maximum(used, 1) - chance) / (1 - chance)
    return estimate >= similarity - 5 * np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b| for sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _digests(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, check (two digests of the set; null without one) and keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.begin("neardup")
        for batch in batches:
            n, node, check, sketches = [], [], [], []
            for items in shingle_sets(batch.column(2), size, seed):
                n.append(len(items))
                with np.errstate(over="ignore"):
                    one = T.mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
                    two = T.mix(items * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)).sum(dtype=np.uint64)
                    pair = T.mix(np.array([one + np.uint64(len(items)), two], dtype=np.uint64)).view(np.int64)
                node.append(int(pair[0]) if len(items) else None)
                check.append(int(pair[1]) if len(items) else None)
                sketches.append(filled(sketch(items)))
            keys = band_keys(np.array(sketches, dtype=np.uint16).reshape(-1, BUCKETS)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(keys) + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1)))
            cols = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "text_hash", "n_shingles", "node", "check", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, node bigint, check bigint, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int, seed: int) -> DataFrame:
    """node, items, sketch, keys (binary) of the wanted (rep, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [x.tobytes() for x in shingle_sets(batch.column(1), size, seed)]
            sketches = [sketch(np.frombuffer(x, dtype=np.uint64)) for x in items]
            keys = band_keys(np.array([filled(s) for s in sketches], dtype=np.uint16).reshape(-1, BUCKETS))
            cols = [pa.array(items, pa.binary()), pa.array([s.tobytes() for s in sketches], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["node", "items", "sketch", "keys"])

    few = wanted.count() <= BROADCAST_ROWS
    wanted = F.broadcast(wanted) if few else wanted
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("hash") == F.col("rep_hash")))
    return found.dropDuplicates(["node"]).select("node", "text").mapInArrow(run, "node bigint, items binary, sketch binary, keys binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs of nodes (a, b) whose full sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a_items", "b_items"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS) for c in ("a_sketch", "b_sketch"))
            may = possible(x, y, percent / 100)
            keep = [k for k in np.flatnonzero(may) if linked(np.frombuffer(a[k], dtype=np.uint64), np.frombuffer(b[k], dtype=np.uint64), percent)]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("items").alias("a_items"), F.col("sketch").alias("a_sketch"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("b_items"), F.col("sketch").alias("b_sketch"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "a_items", "b_items", "a_sketch", "b_sketch").mapInArrow(run, "a bigint, b bigint")


def _by_group(handle: Callable[[list[pa.RecordBatch]], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls handle with the rows of each group of a partition that is sorted by `group` and `key`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None
        for batch in batches:
            g, key = batch.column("group").to_numpy(), batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), len(g)]
            for a, z in zip(cuts, cuts[1:]):
                if z == a:
                    continue
                if (g[a], key[a]) != group:
                    if held and (out := handle(held)) is not None:
                        yield out
                    held, group = [], (g[a], key[a])
                held.append(batch.slice(a, z - a))
        if held and (out := handle(held)) is not None:
            yield out

    return run


def _column(rows: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([r.column(name).to_numpy() for r in rows])


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch | None:
    if not pairs:
        return None
    both = np.array(pairs, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _small_pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    node, comp = _column(rows, "node"), _column(rows, "comp")
    i, j = np.triu_indices(len(node), 1)
    keep = (comp[i] != comp[j]) & (node[i] != node[j])
    i, j = node[i[keep]], node[j[keep]]
    return _edges(list(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())))


def _block_links(percent: int) -> Callable[[list[pa.RecordBatch]], pa.RecordBatch | None]:
    """Links that join components, of the pairs of a cell: those within one block, or across two.

    A pair that shares several bands is compared in the first of them only.
    """

    def handle(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        node, comp, block = (_column(rows, c) for c in ("node", "comp", "block"))
        band = np.uint64(int(rows[0].column("key")[0].as_py()) & (1 << 64) - 1)
        join = lambda c, kind, width: np.frombuffer(b"".join(x for r in rows for x in r.column(c).to_pylist()), dtype=kind).reshape(-1, width)
        keys, sketches = join("keys", np.uint64, BANDS), join("sketch", np.uint16, BUCKETS)
        items = [np.frombuffer(x, dtype=np.uint64) for r in rows for x in r.column("items").to_pylist()]
        sizes = np.array([len(x) for x in items])
        across = len(np.unique(block)) > 1
        if rows[0].column("two")[0].as_py() and not across:
            return None
        earlier = keys[:, : int(np.flatnonzero(keys[0] == band)[0])]
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for i in range(len(node)):
            rest = np.arange(i + 1, len(node))
            rest = rest[(comp[rest] != comp[i]) & (node[rest] != node[i]) & ((block[rest] != block[i]) if across else True)]
            rest = rest[100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])]
            if len(rest) and earlier.shape[1]:
                rest = rest[~(earlier[rest] == earlier[i]).any(axis=1)]
            if len(rest):
                rest = rest[possible(sketches[rest], sketches[i], percent / 100)]
            for j in rest.tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and linked(items[i], items[j], percent):
                    root[max(x, y)] = min(x, y)
                    out.append((int(node[i]), int(node[j])))
        return _edges(out)

    return handle


def mixed_of(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, size, comp, n (members of the band) and main (its largest component) of the bands in several components."""
    now = members.join(labels, "node", "left").select("key", "node", "size", F.coalesce("comp", "node").alias("comp"))
    by_comp = now.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = by_comp.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top")).filter("comps > 1").select("key", "n", F.col("top.comp").alias("main"))
    return materialise(now.join(mixed, "key"), "mixed")


def cells_of(many: DataFrame) -> DataFrame:
    """The members of large bands by cell: group, key, node, comp, block and two (whether the cell is of two blocks).

    The members of a band's main component are in no cell with each other: a
    cell joins a block of the others with itself, with another of them or
    with a block of the main ones. Blocks have at most about BLOCK members
    and CELL_BYTES of sets.
    """
    side = many.withColumn("is_main", F.col("comp") == F.col("main"))
    sizes = side.groupBy("key").agg(
        *(F.greatest(F.lit(1), F.ceil(F.count(F.when(own, 1)) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(own, F.col("size"))), F.lit(0)) * 8 / CELL_BYTES)).cast("int").alias(name) for name, own in (("mains", F.col("is_main")), ("others", ~F.col("is_main"))))
    )
    side = side.join(sizes, "key").withColumn("block", F.when(F.col("is_main"), F.col("others") + F.pmod(F.xxhash64("node"), "mains")).otherwise(F.pmod(F.xxhash64("node"), "others")).cast("int"))
    every = F.sequence(F.lit(0), F.col("others") - 1 + F.when(F.col("is_main"), 0).otherwise(F.col("mains")))
    cells = side.withColumn("other", F.explode(every))
    return cells.select("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "node", "comp", "block", (F.col("block") != F.col("other")).alias("two"))


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a band that are in different components so far."""
    now = mixed_of(members, labels)
    few = now.filter(F.col("n") <= SMALL).select("key", F.col("key").alias("group"), "node", "comp")
    few = few.repartition("group").sortWithinPartitions("group").mapInArrow(_by_group(_small_pairs), "a bigint, b bigint").distinct()
    found = _confirmed(few, sets, percent)
    many = now.filter(F.col("n") > SMALL)
    if not many.isEmpty():
        # A cell of two blocks holds its members once: those of a block come from the rows of the other's number.
        cells = cells_of(many).join(sets, "node").repartition("group").sortWithinPartitions("group", "key")
        found = found.union(cells.mapInArrow(_by_group(_block_links(percent)), "a bigint, b bigint"))
    return found


def _classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of all documents."""
    for seed in range(8):
        digests = materialise(_digests(docs, size, seed), "digests")
        some = digests.filter(F.col("node").isNotNull())
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
        nodes = materialise(some.groupBy("node").agg(first, F.min("check").alias("x"), F.max("check").alias("y"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.max("n_shingles").alias("size")), "nodes")
        if nodes.filter("x <> y").isEmpty():  # else two different sets share a digest: other hashes
            break
    bands = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub <> top").select("key", "hub")
    members = materialise(bands.join(shared, "key"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash")), "node")
    sets = materialise(_sets(docs, materialise(wanted, "wanted"), size, seed), "sets")
    stars = members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = materialise(_confirmed(stars, sets, percent), "links")
    labels = components(links)
    more = materialise(_rest(members, labels, sets, percent), "links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))
    joined = nodes.join(labels, "node", "left").select("node", "first", "n", F.coalesce("comp", "node").alias("comp"), F.col("comp").isNotNull().alias("inner"))
    roots = labels.select(F.col("comp").alias("node")).distinct().withColumn("is_root", F.lit(True))
    joined = joined.join(roots, "node", "left").filter("n > 1 or inner or is_root")
    least = joined.groupBy("comp").agg(F.min("first").alias("least"))
    ids = materialise(joined.join(least, "comp").select("node", F.col("least.doc_id").alias("least")), "classes")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    joined = digests.drop("check", "keys").join(ids.withColumn("found", F.lit(True)), "node", "left")
    return joined.select("doc_id", "text_hash", "n_shingles", F.when(F.col("found"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) and kept of each document."""
    prepare(docs.sparkSession)
    found = _classes(docs, shingle, round(100 * similarity))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near-duplicates; documents without words all stay.

    Of several rows with the id that stays, the one whose text and then whose
    whole row, as JSON, is the smallest stays.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names that cannot clash
    doc_id, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    found = materialise(_classes(docs, shingle, round(100 * similarity)), "found")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    same = doc_id.eqNullSafe(F.col("_gone_id")) & (F.xxhash64(text) == F.col("_gone_hash"))
    few = gone.count() <= BROADCAST_ROWS
    kept = plain.join(F.broadcast(gone) if few else gone, same, "left_anti")
    again = found.filter("n_shingles > 0").groupBy("doc_id", "component_id").count().filter("count > 1").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    again = materialise(again.select(F.col("doc_id").alias("_again_id")), "again")
    if again.isEmpty():
        return kept.toDF(*names)
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    twice = doc_id.eqNullSafe(F.col("_again_id"))
    words = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    worded, rest = kept.filter(words), kept.filter(~words)
    first = F.row_number().over(Window.partitionBy(doc_id).orderBy(text, F.to_json(F.struct("*"))))
    one = worded.join(again, twice, "left_semi").withColumn("_rank", first).filter("_rank = 1").drop("_rank")
    return worded.join(again, twice, "left_anti").union(one).union(rest).toDF(*names)
