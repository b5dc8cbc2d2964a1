"""Cross-site boilerplate lines by HyperLogLog spread.

For each line hash a sketch of its sites is merged by aggregation. Lines well
above the threshold are boilerplate, lines well below are not, and lines near
it get an exact distinct count. Every boilerplate line stays once: at its
first place in the document with the smallest id.

Lines are what stands between newlines; those shorter than min_bytes bytes
never count. Defined results: null texts stay null; a null site is a site of
its own; a null id is never the smallest unless there is no other; repeated
rows each keep or lose the same lines; empty tables give empty results;
columns besides id, text and site are kept by `remove_boilerplate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrake.llm import texts as T
from hayrake.session import materialise, prepare

MIN_SITES = 10
MIN_BYTES = 16
LG_K = 10
#: Relative half-width of the range about the threshold that is counted exactly (six standard errors at LG_K).
NEAR = 0.2
#: At most so many boilerplate lines are broadcast; more are joined by shuffles.
BROADCAST_ROWS = 500_000


def _lines(column: pa.Array, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number among the row's non-empty lines, and hash of the lines that count."""
    data, offsets = T.text_bytes(column)
    out = []
    for lo, hi in T.groups_of_rows(offsets):
        s, e, rows, h = T.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], T.NOT_NEWLINE, fold=False)
        number = np.arange(len(rows)) - T.row_bounds(rows, hi - lo)[rows] if len(rows) else rows
        keep = e - s >= min_bytes
        out.append((rows[keep] + lo, number[keep], h[keep].view(np.int64)))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def spread(docs: DataFrame, site_col: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """line (hash), site (hash) and first (smallest doc_id), a few rows for each pair."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.begin("linededup")
        for batch in batches:
            rows, _, line = _lines(batch.column(1), min_bytes)
            rows = rows[np.lexsort((rows, line))] if len(rows) else rows
            line = np.sort(line)
            site = batch.column(2).to_numpy()[rows]
            table = pa.table({"line": line, "site": site, "first": batch.column(0).take(pa.array(rows, pa.int64()))})
            table = table.group_by(["line", "site"]).aggregate([("first", "min")]).rename_columns(["line", "site", "first"])
            yield from table.combine_chunks().to_batches()

    site = F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit("")))
    return docs.select("doc_id", "text", site.alias("site")).mapInArrow(run, f"line bigint, site bigint, first {kind}")


def boilerplate(docs: DataFrame, site_col: str, min_sites: int = MIN_SITES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """line (hash) and owner (smallest doc_id) of the lines that at least min_sites sites have."""
    pairs = materialise(spread(docs, site_col, min_bytes), "spread")
    sketched = pairs.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.min("first").alias("owner"))
    sketched = materialise(sketched.filter(F.col("sites") >= min_sites * (1 - NEAR)), "sketched")
    near = sketched.filter(F.col("sites") <= min_sites * (1 + NEAR)).select("line", "owner")
    exact = pairs.join(near, "line").groupBy("line", "site").agg(F.first("owner").alias("owner")).groupBy("line").agg(F.count("*").alias("n"), F.first("owner").alias("owner"))
    return sketched.filter(F.col("sites") > min_sites * (1 + NEAR)).select("line", "owner").union(exact.filter(F.col("n") >= min_sites).select("line", "owner"))


def remove_boilerplate(docs: DataFrame, site_col: str, min_sites: int = MIN_SITES, min_bytes: int = MIN_BYTES, counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """docs with boilerplate lines taken out of the text.

    counts adds n_lines (non-empty ones) and n_removed; drop_emptied leaves
    out documents all of whose non-empty lines are removed.
    """
    spark = prepare(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    at, id_at = names.index("text"), names.index("doc_id")
    found = materialise(boilerplate(docs, site_col, min_sites, min_bytes), "boilerplate")
    n = found.count()
    small = n <= BROADCAST_ROWS
    if small:
        rows = sorted((r.line, r.owner) for r in found.collect()) if n else []
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), [r[1] for r in rows]))
    else:
        key = [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")]
        kind = docs.schema["doc_id"].dataType.simpleString()

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, _, line = _lines(batch.column(2), min_bytes)
                where = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(line)], ["_id", "_hash", "line"])

        own = docs.select(*key, "text").mapInArrow(explode, f"_id {kind}, _hash bigint, line bigint").distinct().join(found, "line")
        own = own.groupBy("_id", "_hash").agg(F.collect_list("line").alias("_found"), F.collect_list(F.col("_id").eqNullSafe(F.col("owner"))).alias("_own"))
        same = F.col(f"c{id_at}").eqNullSafe(F.col("_id")) & F.xxhash64(f"c{at}").eqNullSafe(F.col("_hash"))
        docs = docs.toDF(*(f"c{k}" for k in range(len(names)))).join(own, same, "left").drop("_id", "_hash")  # names that cannot clash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.begin("linededup")
        for batch in batches:
            column = batch.column(at)
            rows, number, line = _lines(column, min_bytes)
            if small:
                table, owners = shared.value
                place = np.searchsorted(table, line)
                place[place == len(table)] = 0
                hit = table[place] == line if len(table) else np.zeros(len(line), dtype=bool)
                mine = lambda k, x: owners[place[k]] == batch.column(id_at)[int(x)].as_py()
            else:
                lists = [dict(zip(a or (), b or ())) for a, b in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist())]
                hit = np.array([x in lists[r] for r, x in zip(rows.tolist(), line.tolist())], dtype=bool)
                mine = lambda k, x: lists[x][int(line[k])]
            gone: dict[int, set[int]] = {}
            seen: set[tuple[int, int]] = set()
            for k in np.flatnonzero(hit).tolist():
                row = int(rows[k])
                if (row, int(line[k])) not in seen and mine(k, row):
                    seen.add((row, int(line[k])))
                else:
                    gone.setdefault(row, set()).add(int(number[k]))
            texts = column.to_pylist()
            totals, removed, keep = [], [], []
            for row, text in enumerate(texts):
                own = gone.get(row, ())
                total = 0
                if text is not None and (counts or own):
                    parts, left = text.split("\n"), []
                    for part in parts:
                        if part == "" or total not in own:
                            left.append(part)
                        total += part != ""
                    texts[row] = "\n".join(left)
                totals.append(total)
                removed.append(len(own))
                keep.append(not (drop_emptied and own and len(own) == total))
            cols = [pa.array(texts, batch.schema.field(at).type) if c == at else batch.column(c) for c in range(len(names))]
            if counts:
                cols += [pa.array(totals, pa.int64()), pa.array(removed, pa.int64())]
            out = pa.RecordBatch.from_arrays(cols, [*names, "n_lines", "n_removed"] if counts else names)
            yield out.filter(pa.array(keep)) if drop_emptied else out

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.mapInArrow(run, kind + (", n_lines bigint, n_removed bigint" if counts else ""))
