"""Retrieval labels mined from history and from documentation."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hayrake.functions.text import MAINTENANCE, commit_subject, maintenance_pattern, strip_doc_comments, word_count
from hayrake.operators.chunks import chunk_files
from hayrake.operators.lookup import keep_first, touched
from hayrake.session import prepare

PRELUDE = "<file_prelude>"
LEAST_WORDS = 4
MOST_SYMBOLS = 3


def inserted_lines(old: str | None, new: str | None) -> list[int]:
    """Line numbers (from 1) of new that old does not have; all of them without old."""
    if new is None:
        return []
    lines = new.splitlines()
    if old is None:
        return list(range(1, len(lines) + 1))
    matcher = difflib.SequenceMatcher(None, old.splitlines(), lines, autojunk=False)
    return [k + 1 for tag, _, _, a, z in matcher.get_opcodes() if tag in ("insert", "replace") for k in range(a, z)]


def changed_lines(changes: DataFrame) -> DataFrame:
    """commit_id, file, line for changes (commit_id, file, old_text, new_text); deleted files have none."""
    prepare(changes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.commit_id, r.file, n) for r in batch.itertuples() for n in inserted_lines(r.old_text, r.new_text)]
            yield pd.DataFrame(rows, columns=["commit_id", "file", "line"])

    return changes.select("commit_id", "file", "old_text", "new_text").mapInPandas(run, "commit_id string, file string, line int")


def touched_symbols(changes: DataFrame) -> DataFrame:
    """Distinct (commit_id, file, symbol) that changes (commit_id, file, language, old_text, new_text) touch.

    Every line of a new file counts as changed. Deleted files, those without
    a known language and those that cannot be parsed touch nothing, and
    neither do preludes count.
    """
    some = changes.filter("new_text is not null and language is not null")
    key = F.concat_ws(":", "commit_id", "file")  # commit ids hold no colon
    found = chunk_files(some.select(key.alias("file"), "language", F.col("new_text").alias("text"))).filter("problem is null")
    spans = found.withColumn("commit_id", F.substring_index("file", ":", 1)).withColumn("file", F.expr("substring(file, length(commit_id) + 2)"))
    return touched(changed_lines(some), spans)


def mine_commits(commits: DataFrame, touched: DataFrame, indexed: DataFrame, patterns: Sequence[str] = MAINTENANCE) -> DataFrame:
    """commits (commit_id, parents, message) with subject, reason (null: accepted) and expected pairs.

    Reasons in this order: merge, a maintenance pattern, too short a subject,
    no symbol touched (commit_id, file, symbol), more than three, or one of
    them not indexed (file, symbol).
    """
    known = indexed.select("file", "symbol").distinct().withColumn("known", F.lit(True))
    pairs = touched.filter(F.col("symbol") != PRELUDE).select("commit_id", "file", "symbol").distinct().join(known, ["file", "symbol"], "left")
    per = pairs.groupBy("commit_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("all"), F.array_sort(F.collect_list(F.struct("file", "symbol"))).alias("expected"))
    out = commits.withColumn("subject", commit_subject(F.col("message"))).join(per, "commit_id", "left")
    subject = F.col("subject")
    reason = (
        F.when(F.col("parents") > 1, "merge").when(maintenance_pattern(subject, patterns).isNotNull(), "maintenance_pattern").when(word_count(subject) < LEAST_WORDS, "subject_too_short")
        .when(F.coalesce("n", F.lit(0)) == 0, "no_symbols_touched").when(F.col("n") > MOST_SYMBOLS, "too_many_symbols").when(~F.col("all"), "symbol_not_indexed")
    )
    return out.withColumn("reason", reason).select("commit_id", "subject", "reason", F.when(reason.isNull(), F.col("expected")).alias("expected"))


def mining_report(mined: DataFrame) -> DataFrame:
    """commits_examined, labels_accepted and rejected (reason to number)."""
    counts = mined.groupBy("reason").agg(F.count("*").alias("n"))
    rejected = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("commits_examined"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("labels_accepted"), rejected.alias("rejected"))


def commit_labels(mined: DataFrame) -> DataFrame:
    accepted = mined.filter("reason is null")
    return accepted.select(F.col("subject").alias("query"), "expected", F.lit("commit_subject").alias("source"), F.col("commit_id").alias("provenance"), F.lit("mined").alias("label_set"))


def mine_docstrings(chunks: DataFrame) -> DataFrame:
    """A label for each (file, symbol) with documentation, the query being its first line with its marker."""
    own = chunks.filter(F.col("doc_first_line").isNotNull() & (F.col("symbol") != PRELUDE))
    own = keep_first(own, ["file", "symbol"], ["line_start", "row_id"])
    return own.select(
        F.col("doc_first_line").alias("query"), F.array(F.struct("file", "symbol")).alias("expected"), F.lit("docstring").alias("source"),
        F.concat_ws("::", "file", "symbol").alias("provenance"), F.lit("mined").alias("label_set"),
    )


def held_out(chunks: DataFrame) -> DataFrame:
    """chunks as they are indexed for documentation labels: no doc line, no doc comments in the body."""
    return chunks.withColumn("doc_first_line", F.lit(None).cast("string")).withColumn("body", strip_doc_comments(F.col("body")))


def recent(commits: DataFrame, most: int | None = None) -> DataFrame:
    """Commits, the latest first, at most so many."""
    ordered = commits.orderBy(F.desc("ts"), F.asc("commit_id"))
    return ordered if most is None else ordered.limit(most)


def numbered_queries(labels: DataFrame) -> DataFrame:
    """labels with label_id in the order of their provenance, within label_set and source."""
    return labels.withColumn("label_id", F.row_number().over(Window.partitionBy("label_set", "source").orderBy("provenance")))
