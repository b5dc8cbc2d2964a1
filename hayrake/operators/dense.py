"""Exact dense retrieval: every live vector is scored.

Queries are few and go to the vectors: blocks of at most QUERY_BLOCK of them
are broadcast, and each Arrow batch of vectors is one matrix product. A task
keeps its best rows of each query; only those leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrake.errors import DimensionMismatch, ModelMismatch, NonFiniteScore
from hayrake.functions.vectors import dot
from hayrake.operators.lexical import BEST_ROWS, top
from hayrake.session import prepare

QUERY_BLOCK = 2000
DECIMALS = 9


def live(vectors: DataFrame) -> DataFrame:
    return vectors.filter("live") if "live" in vectors.columns else vectors


def check_model(stored: str | None, used: str | None) -> None:
    if stored != used:
        raise ModelMismatch(f"the index holds vectors of {stored!r}, the query is of {used!r}")


def scores_sql(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, row_id, score by built-in functions alone: queries (query_id, query_vector) against all vectors."""
    n = queries.count()
    if n > QUERY_BLOCK:
        raise ValueError(f"{n} queries; more than {QUERY_BLOCK} go in blocks, by search")
    pairs = live(vectors).crossJoin(F.broadcast(queries))
    return pairs.select("query_id", "row_id", F.round(dot(F.col("vector"), F.col("query_vector")), DECIMALS).alias("score"))


def _matrix(column: pa.Array, dims: int | None) -> np.ndarray:
    if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
        raise DimensionMismatch("vectors are not lists of numbers")
    if not len(column):
        return np.zeros((0, dims or 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // len(column)
    if column.null_count or (column.value_lengths().to_numpy(zero_copy_only=False) != width).any() or dims not in (None, width):
        raise DimensionMismatch(f"vectors are not all of {dims or width} dimensions")
    return flat.reshape(len(column), width)


def _best(vectors: DataFrame, ids: list, matrix: np.ndarray, limit: int) -> DataFrame:
    spark = prepare(vectors.sparkSession)
    shared = spark.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        nothing = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        held, best = nothing

        def told() -> Iterator[pa.RecordBatch]:
            n = held.shape[1]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([i for i in ids for _ in range(n)], pa.int64()), pa.array(held.reshape(-1), pa.int64()), pa.array(best.reshape(-1))], ["query_id", "row_id", "score"])

        for batch in batches:
            if not len(batch):
                continue
            rows = batch.column(0).to_numpy()
            # the order of summation may depend on the batch, so scores are rounded before they are ranked
            got = np.round(np.einsum("vd,qd->qv", _matrix(batch.column(1), matrix.shape[1]), matrix, optimize=len(ids) * len(rows) > 200_000), DECIMALS)
            if not np.isfinite(got).all():
                raise NonFiniteScore(f"row {rows[int(np.argwhere(~np.isfinite(got))[0][1])]} has a score that is not finite")
            held, best = np.concatenate([held, np.broadcast_to(rows, got.shape)], axis=1), np.concatenate([best, got], axis=1)
            keep = np.lexsort((held, -best), axis=1)[:, :limit]
            held, best = np.take_along_axis(held, keep, axis=1), np.take_along_axis(best, keep, axis=1)
            if len(ids) * limit > BEST_ROWS:  # too many to hold: the best of each batch
                yield from told()
                held, best = nothing
        yield from told()

    return live(vectors).select("row_id", "vector").mapInArrow(run, "query_id bigint, row_id bigint, score double")


def search(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The best live rows of each query (query_id, query_vector): query_id, row_id, score, rank."""
    if limit <= 0:
        return top(scores_sql(vectors, queries.limit(0)), 0)
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    found = None
    for k in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        rows = own.select("query_id", "query_vector").orderBy("query_id").collect()
        if not rows:
            continue
        part = _best(vectors, [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64), limit)
        found = part if found is None else found.union(part)
    return top(found if found is not None else scores_sql(vectors, queries.limit(0)), limit)
