"""Reciprocal rank fusion of candidate lists and assembly of results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hayrake.functions.text import preview
from hayrake.functions.vectors import reciprocal_rank
from hayrake.operators.lexical import bounded

DECIMALS = 12


@dataclass(frozen=True)
class Fusion:
    """How many candidates of each list count, and the constant of the rank term."""

    lexical_depth: int = 50
    dense_depth: int = 50
    k: int = 60


ABLATIONS = {"fused": Fusion(50, 50), "lexical_only": Fusion(50, 0), "dense_only": Fusion(0, 50)}


def fuse(lexical: DataFrame, dense: DataFrame, config: Fusion = Fusion()) -> DataFrame:
    """query_id, row_id, rank and score in either list (null where absent), fused_score, rank.

    One union and one grouping; both lists come with query_id, row_id, score and rank.
    """
    name = lambda df, kind, depth: df.filter(F.col("rank") <= depth).select("query_id", "row_id", F.lit(kind).alias("kind"), "rank", "score")
    both = name(lexical, "lexical", config.lexical_depth).unionByName(name(dense, "dense", config.dense_depth))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    fused = both.groupBy("query_id", "row_id").agg(
        of("lexical", "rank").alias("lexical_rank"), of("lexical", "score").alias("lexical_score"), of("dense", "rank").alias("dense_rank"), of("dense", "score").alias("dense_score"),
        F.round(F.sum(reciprocal_rank(F.col("rank"), config.k)), DECIMALS).alias("fused_score"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), F.asc("row_id"))
    return fused.withColumn("rank", F.row_number().over(order))


def assemble(fused: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """The first top_k of each query with their records; rows without a live record drop out and are not replaced."""
    best = fused.filter(F.col("rank") <= top_k)
    live = chunks.filter("live") if "live" in chunks.columns else chunks
    record = live.select("row_id", "file", "symbol", "signature", F.col("doc_first_line").alias("doc"), preview(F.col("body")).alias("preview"), F.array("line_start", "line_end").alias("lines"))
    return bounded(best).join(record, "row_id").select("query_id", "rank", "row_id", "file", "symbol", "signature", "doc", "preview", "lines", "lexical_score", "dense_score", "fused_score")


def as_json(results: DataFrame) -> DataFrame:
    """query_id, rank and the result as JSON, absent scores as null."""
    fields = F.struct("file", "symbol", "signature", "doc", "preview", "lines", "lexical_score", "dense_score", "fused_score")
    return results.select("query_id", "rank", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))
