"""Files of a repository, and labels."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrake.functions import paths
from hayrake.session import prepare

#: Entries that a handwritten set of labels has at least.
LEAST_HANDWRITTEN = 25


def _open(root: str):
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}")


def listing(root: str) -> Iterator[tuple[str, int | None]]:
    """Paths below root and their sizes. Excluded folders come once, with no size, and are not entered; .git not at all."""
    store, top = _open(root.rstrip("/"))
    folders = [top]
    while folders:
        for info in sorted(store.get_file_info(fs.FileSelector(folders.pop())), key=lambda i: i.path):
            file = info.path[len(top) + 1 :]
            if info.type == fs.FileType.Directory:
                if info.base_name in paths.VENDOR_DIRS:
                    yield file, None
                elif info.base_name != ".git":
                    folders.append(info.path)
            elif info.type == fs.FileType.File:
                yield file, info.size


def walk(spark: SparkSession, root: str, gitignore: str = "") -> DataFrame:
    """file, language, text of the files to index, and reason and null text of the others.

    The driver lists names and sizes; paths are judged by them, and executors
    read only what passes. (Spark's own file listing leaves out names that
    begin with an underscore or a full stop, which sources may.)
    """
    prepare(spark)
    listed = spark.createDataFrame(list(listing(root)), "file string, length bigint")
    reason = F.coalesce(F.when(F.col("length").isNull(), "vendor"), paths.skip_reason(F.col("file"), gitignore), F.when(F.col("length") > paths.MOST_BYTES, "too_large"))
    judged = listed.select("file", paths.language(F.col("file")).alias("language"), reason.alias("reason"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _open(root.rstrip("/"))
        for batch in batches:
            contents = []
            for file in batch["file"]:
                with store.open_input_stream(f"{top}/{file}", compression=None) as stream:
                    contents.append(stream.read(paths.MOST_BYTES + 1))
            yield batch.assign(content=contents)

    found = judged.filter("reason is null").select("file", "language").mapInPandas(read, "file string, language string, content binary")
    late = paths.content_reason(F.length("content"), F.col("content"))
    found = found.select("file", "language", late.alias("reason"), F.when(late.isNull(), F.col("content").cast("string")).alias("text"))
    return found.unionByName(judged.filter("reason is not null").select("file", F.lit(None).cast("string").alias("language"), "reason", F.lit(None).cast("string").alias("text")))


def read_gitignore(spark: SparkSession, root: str) -> str:
    """The .gitignore at the root, empty if there is none."""
    store, top = _open(root.rstrip("/"))
    if store.get_file_info(f"{top}/.gitignore").type != fs.FileType.File:
        return ""
    with store.open_input_stream(f"{top}/.gitignore", compression=None) as stream:
        return stream.read().decode("utf-8", "replace")


def handwritten_labels(spark: SparkSession, path: str) -> DataFrame:
    """json_labels of the handwritten set, which has at least LEAST_HANDWRITTEN entries."""
    found = json_labels(spark, path)
    n = found.count()
    if n < LEAST_HANDWRITTEN:
        raise ValueError(f"{n} handwritten labels, fewer than {LEAST_HANDWRITTEN}")
    return found


def json_labels(spark: SparkSession, path: str, label_set: str = "handwritten") -> DataFrame:
    """Labels of a JSON array of {query, expected: [[file, symbol], ...]}, in the order of the array."""
    raw = spark.read.text(path, wholetext=True)
    items = raw.select(F.posexplode(F.from_json("value", "array<struct<query: string, expected: array<array<string>>>>")).alias("at", "x"))
    pairs = F.transform("x.expected", lambda e: F.struct(F.get(e, 0).alias("file"), F.get(e, 1).alias("symbol")))
    return items.select(
        "x.query", pairs.alias("expected"), F.lit("commit_subject").alias("source"), F.concat(F.lit("handwritten:"), F.col("at").cast("string")).alias("provenance"), F.lit(label_set).alias("label_set")
    )
