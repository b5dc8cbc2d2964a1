"""Chunk tables from files: one row in, a row for each symbol out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrake.functions import chunker
from hayrake.functions.text import content_hash
from hayrake.operators.store import numbered
from hayrake.session import prepare

_FIELDS = ["symbol", "symbol_type", "signature", "doc_first_line", "line_start", "line_end", "body", "fragment"]
SCHEMA = "repository string, file string, language string, symbol string, symbol_type string, signature string, doc_first_line string, line_start int, line_end int, body string, fragment int, problem string"


def chunk_files(files: DataFrame, repository: str = "") -> DataFrame:
    """Chunks of files (file, language, text) with content_hash; a file that cannot be parsed is one row with its problem."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, language, text in batch.itertuples(index=False):
                try:
                    found = chunker.chunk_file(file, text or "", language)
                except chunker.Unparsable as error:
                    rows.append([repository, file, language, *[None] * len(_FIELDS), str(error)])
                    continue
                rows += [[repository, file, language, *(getattr(c, f) for f in _FIELDS), None] for c in found]
            out = pd.DataFrame(rows, columns=["repository", "file", "language", *_FIELDS, "problem"])
            for c in ("line_start", "line_end", "fragment"):
                out[c] = out[c].astype("Int32")
            yield out

    found = files.select("file", "language", "text").mapInPandas(run, SCHEMA)
    return found.withColumn("content_hash", F.when(F.col("problem").isNull(), content_hash(F.col("language"), F.col("symbol"), F.col("body"))))


def with_row_ids(chunks: DataFrame, start: int = 0) -> DataFrame:
    """Live chunks with row ids in the order of file, lines and fragment."""
    own = chunks.filter("problem is null").drop("problem") if "problem" in chunks.columns else chunks
    own = own.withColumn("_fragment", F.coalesce("fragment", F.lit(-1)))
    return numbered(own, "row_id", ["file", "line_start", "line_end", "symbol", "_fragment", "content_hash"], start).drop("_fragment").withColumn("live", F.lit(True))


def hard_splits(texts: DataFrame, most: int = chunker.MAX_CHARS) -> DataFrame:
    """id, part and text of texts (id, text), whole lines packed into parts of at most so many characters."""
    prepare(texts.sparkSession)
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, part) for i, text in batch.itertuples(index=False) for k, part in enumerate(chunker.hard_split(text or "", most))]
            yield pd.DataFrame(rows, columns=["id", "part", "text"])

    return texts.select("id", "text").mapInPandas(run, f"id {kind}, part int, text string")
