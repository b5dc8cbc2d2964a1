"""Retrieval metrics, all as aggregates over batches of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayrake.functions.text import length_bucket
from hayrake.session import materialise

RANKS = (1, 3, 10)
#: Words of queries that are sent to the files at once.
WORD_BLOCK = 10_000


def nearest_rank(p: float, column: str) -> Column:
    """Nearest-rank percentile of a column within a group: an element of it, 0 if there is none."""
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)").cast("double"), F.lit(0.0))


def first_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id and first_rank (null without one): the best rank among results (query_id, rank, file, symbol) of an expected pair."""
    hits = results.join(expected.select("query_id", "file", "symbol").distinct(), ["query_id", "file", "symbol"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return expected.select("query_id").distinct().join(hits, "query_id", "left")


def summary(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """labels_scored, top_1, top_3, top_10 and mrr of hits (query_id, first_rank), in all or by groups."""
    share = lambda k: F.coalesce(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"top_{k}")
    mrr = F.coalesce(F.avg(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr")
    return hits.groupBy(*(by or [])).agg(F.count("*").alias("labels_scored"), *map(share, RANKS), mrr)


def by_length(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """summary by the length of the query text; empty groups are left out."""
    return summary(hits.join(queries.select("query_id", length_bucket(F.col("query")).alias("bucket")), "query_id"), ["bucket"])


def bytes_before_hit(results: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id and bytes of JSON read (results: query_id, rank, json) up to the first hit, or of all without one."""
    running = F.sum(F.octet_length("json")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    read = results.select("query_id", "rank", running.alias("read")).join(hits, "query_id")
    upto = F.min(F.when(F.col("rank") >= F.col("first_rank"), F.col("read")))
    return read.groupBy("query_id").agg(F.coalesce(upto, F.max("read")).alias("bytes"))


def baseline_bytes(queries: DataFrame, files: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id and bytes of files (file, body) that hold the first word of the query, in path order, up to an expected one.

    A substring can stand anywhere in a file, so all different words go to
    the files in blocks of at most about WORD_BLOCK; what leaves the scan is
    the size of a file and never its text.
    """
    first = queries.select("query_id", F.try_element_at(F.filter(F.split("query", r"\s+"), lambda x: x != ""), F.lit(1)).alias("word")).filter("word is not null")
    words = materialise(first.select("word").distinct(), "words")
    blocks, found = max(1, -(-words.count() // WORD_BLOCK)), None
    for k in range(blocks):
        own = words.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == k)
        part = files.join(F.broadcast(own), F.contains(F.col("body"), F.col("word"))).select("word", "file", F.octet_length("body").cast("bigint").alias("size"))
        found = part if found is None else found.union(part)
    found = found.join(first, "word").select("query_id", "file", "size")
    wanted = expected.select("query_id", "file").distinct().withColumn("hit", F.lit(True))
    found = found.join(wanted, ["query_id", "file"], "left")
    running = F.sum("size").over(Window.partitionBy("query_id").orderBy("file").rowsBetween(Window.unboundedPreceding, 0))
    read = found.withColumn("read", running).groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("hit"), F.col("read"))), F.max("read")).alias("bytes"))
    return queries.select("query_id").distinct().join(read, "query_id", "left").select("query_id", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
