"""Lookups and joins over chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayrake.operators.lexical import bounded


def _live(chunks: DataFrame) -> DataFrame:
    return chunks.filter("live") if "live" in chunks.columns else chunks


def get_many(chunks: DataFrame, request: DataFrame) -> DataFrame:
    """The live record of each requested row (ord, row_id), nulls where there is none; one join whatever their number."""
    return bounded(request.select("ord", "row_id")).join(_live(chunks), "row_id", "left")


def get(chunks: DataFrame, row_id: int) -> DataFrame:
    return _live(chunks).filter(F.col("row_id") == row_id)


def get_by_hash(chunks: DataFrame, digest: str) -> DataFrame:
    return _live(chunks).filter(F.col("content_hash") == digest)


def rows_for_file(chunks: DataFrame, file: str) -> DataFrame:
    return _live(chunks).filter(F.col("file") == file).orderBy("row_id")


def symbol_lookup(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """file, symbol, outcome (found, not_found, ambiguous), row_id if found, candidates as file:signature if ambiguous."""
    hits = _live(chunks).select("file", "symbol", "row_id", "signature").join(bounded(wanted.select("file", "symbol").distinct()), ["file", "symbol"])
    told = F.array_sort(F.collect_list(F.concat_ws(":", "file", "signature")))
    hits = hits.groupBy("file", "symbol").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id"), told.alias("candidates"))
    out = wanted.select("file", "symbol").distinct().join(hits, ["file", "symbol"], "left")
    outcome = F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return out.select("file", "symbol", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("row_id")).alias("row_id"), F.when(F.col("n") > 1, F.col("candidates")).alias("candidates"))


def contained(spans: DataFrame, key: list[str]) -> DataFrame:
    """Pairs (outer_id, inner_id) of different spans (id, start, end) with the same key, one inside the other.

    The join is on the key, and on blocks of the start, so that a key with
    many spans is spread: an inner span starts in a block that the outer one
    covers.
    """
    width = 4096
    block = lambda c: F.floor(F.col(c) / width).cast("bigint")
    outer = spans.select(*key, F.col("id").alias("outer_id"), F.col("start").alias("a"), F.col("end").alias("z"), F.explode(F.sequence(block("start"), F.greatest(block("start"), block("end")))).alias("block"))
    inner = spans.select(*key, F.col("id").alias("inner_id"), F.col("start").alias("b"), F.col("end").alias("y"), block("start").alias("block"))
    return outer.join(inner, [*key, "block"]).filter((F.col("a") <= F.col("b")) & (F.col("y") <= F.col("z")) & (F.col("outer_id") != F.col("inner_id"))).select(*key, "outer_id", "inner_id")


def qualified_names(spans: DataFrame, key: list[str]) -> DataFrame:
    """id and name, with the names of what contains it before it, outermost first, joined by `::`."""
    pairs = contained(spans, key).join(spans.select(*key, F.col("id").alias("outer_id"), "start", "end", "name"), [*key, "outer_id"])
    above = pairs.groupBy(*key, F.col("inner_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("end"), "name"))).alias("above"))
    joined = spans.select(*key, "id", "name").join(above, [*key, "id"], "left")
    names = F.concat(F.coalesce(F.transform("above", lambda x: x["name"]), F.expr("cast(array() as array<string>)")), F.array("name"))
    return joined.select(*key, "id", F.array_join(names, "::").alias("qualified"))


def touched(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct (commit_id, file, symbol) whose line range holds a changed line (commit_id, file, line)."""
    width = 256
    block = lambda c: F.floor(c / width).cast("bigint")
    spans = chunks.filter(F.col("symbol") != "<file_prelude>").select(
        *(["commit_id"] if "commit_id" in chunks.columns else []), "file", "symbol", "line_start", "line_end", F.explode(F.sequence(block(F.col("line_start")), block(F.col("line_end")))).alias("block")
    )
    keys = [c for c in ("commit_id", "file", "block") if c in spans.columns]
    hit = lines.withColumn("block", block(F.col("line"))).join(spans, keys)
    return hit.filter(F.col("line").between(F.col("line_start"), F.col("line_end"))).select("commit_id", "file", "symbol").distinct()


def all_indexed(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """labels (label_id, expected) with scored: whether there is a pair and every pair is a live chunk's (file, symbol)."""
    known = _live(chunks).select("file", "symbol").distinct().withColumn("known", F.lit(True))
    pairs = labels.select("label_id", F.explode("expected").alias("e")).select("label_id", "e.file", "e.symbol").distinct()
    state = pairs.join(known, ["file", "symbol"], "left").groupBy("label_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all"))
    return labels.join(state, "label_id", "left").withColumn("scored", F.coalesce("all", F.lit(False))).drop("all")


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in that order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
