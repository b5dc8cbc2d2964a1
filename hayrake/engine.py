"""The four verbs over a store: search, find similar, get a symbol, index a repository."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrake.errors import IndexInProgress, LexicalOutOfSync, SymbolAmbiguous, SymbolNotFound
from hayrake.functions.vectors import hashed_vector
from hayrake.operators import lexical, search
from hayrake.operators.chunks import chunk_files
from hayrake.operators.fusion import Fusion, assemble, fuse
from hayrake.operators.lookup import symbol_lookup
from hayrake.operators.store import Store, change_work, changed_rows
from hayrake.session import prepare
from hayrake.sources import files as file_source
from hayrake.sources import git
from hayrake.streaming.incremental import index_changes

MOST_RESULTS, MOST_QUERY, MOST_CODE = 20, 1000, 20_000


class Embedder(Protocol):
    model_id: str
    dims: int

    def embed(self, texts: list[str], role: str) -> np.ndarray: ...


@dataclass
class MockEmbedder:
    model_id: str = "mock"
    dims: int = 64
    query_prefix: str = ""
    document_prefix: str = ""

    def embed(self, texts: list[str], role: str) -> np.ndarray:
        prefix = self.query_prefix if role == "query" else self.document_prefix
        return np.array([hashed_vector(prefix + t, self.dims) for t in texts]).reshape(-1, self.dims)


def check_query(query: str, top_k: int, most: int = MOST_QUERY, name: str = "query") -> None:
    if not 1 <= top_k <= MOST_RESULTS:
        raise ValueError(f"top_k must be within 1 and {MOST_RESULTS}")
    if not query.strip():
        raise ValueError(f"{name} must not be empty")
    if len(query) > most:
        raise ValueError(f"{name} has more than {most} characters")


class Engine:
    def __init__(self, spark: SparkSession, store: Store, embedder: Embedder, progress: Callable[[str], None] | None = None) -> None:
        store.check_model(embedder.model_id)
        self.spark, self.store, self.embedder = prepare(spark), store, embedder
        self.progress = progress or (lambda stage: None)
        self.indexing, self.started = False, time.time()
        self.index: lexical.Index | None = None
        self._load()

    def _load(self) -> None:
        """A view of the active generation; searches use it until the next one is complete.

        Once there is an index, only rows that changed since are split into terms.
        """
        before = self.chunks if self.index else None
        self.chunks, self.vectors = self.store.chunks, self.store.vectors.join(self.store.chunks.select("row_id", "live"), "row_id")
        if before is None:
            self.index = lexical.build(self.chunks)
        else:
            self.index = lexical.upsert(self.index, *changed_rows(before, self.chunks, list(lexical.BOOSTS)))
        indexed, live = self.index.postings.select("row_id").distinct(), self.chunks.filter("live").select("row_id")
        if not indexed.join(live, "row_id", "left_anti").isEmpty():
            raise LexicalOutOfSync("the lexical index has rows that the store has not")

    def search_many(self, queries: list[str], top_k: int = 5, config: Fusion = Fusion()) -> tuple[DataFrame, search.Diagnostics]:
        for q in queries:
            check_query(q, top_k)
        vectors = self.embedder.embed(queries, "query").tolist()
        asked = self.spark.createDataFrame([(k, q, v) for k, (q, v) in enumerate(zip(queries, vectors))], "query_id bigint, query string, query_vector array<double>")
        by_terms, by_vector, told = search.candidates(self.index, self.vectors, asked, config)
        return assemble(fuse(by_terms, by_vector, config), self.chunks, top_k).orderBy("query_id", "rank"), told

    def search_code(self, query: str, top_k: int = 5) -> DataFrame:
        return self.search_many([query], top_k)[0]

    def find_similar_code(self, code: str, top_k: int = 5) -> DataFrame:
        check_query(code, top_k, MOST_CODE, "code")
        asked = self.spark.createDataFrame([(0, self.embedder.embed([code], "document")[0].tolist())], "query_id bigint, query_vector array<double>")
        return search.similar(self.chunks, self.vectors, asked, top_k)[0].orderBy("rank")

    def get_symbol(self, file: str, symbol: str) -> dict:
        if not file or not symbol:
            raise ValueError("file and symbol must not be empty")
        wanted = self.spark.createDataFrame([(file, symbol)], "file string, symbol string")
        got = symbol_lookup(self.chunks, wanted).first()
        if got.outcome == "not_found":
            raise SymbolNotFound(f"{file} has no {symbol}")
        if got.outcome == "ambiguous":
            raise SymbolAmbiguous(f"{file} has more than one {symbol}", got.candidates)
        return self.chunks.filter(F.col("row_id") == got.row_id).first().asDict()

    def _embed_frame(self, rows: DataFrame) -> DataFrame:
        embedder, dims = self.embedder, self.embedder.dims

        def run(batches):
            for batch in batches:
                vectors = embedder.embed(batch["body"].tolist(), "document").reshape(-1, dims)
                yield pd.DataFrame({"ord": batch["ord"], "vector": list(vectors.astype(np.float32))})

        return rows.mapInPandas(run, "ord bigint, vector array<float>")

    def index_repository(self, path: str, full: bool = False, policy: str = "index_worktree") -> dict[str, int]:
        """Brings the store to the state of a git work tree, from its last indexed commit or from all files."""
        if not path:
            raise ValueError("path must not be empty")
        if self.indexing:
            raise IndexInProgress("an index run is under way")
        self.indexing = True
        try:
            self.store.check_fresh()
            self.progress("walking")
            loose, state = git.apply_policy(self.spark, path, policy)
            base = (self.store.manifest.indexed_commit or "").removesuffix("+dirty")
            walked = file_source.walk(self.spark, path, file_source.read_gitignore(self.spark, path))
            good = walked.filter("reason is null").select("file", "language", "text")
            if policy == "index_commit_only":
                good = good.drop("text").join(git.files_at(self.spark, path, good), "file").filter("text is not null")
            if full or not base or self.store.manifest.indexed_commit.endswith("+dirty"):
                before = self.store.chunks.filter("live").select("file").distinct()
                feed = good.select(F.lit(0).cast("bigint").alias("seq"), F.lit("M").alias("op"), F.col("file").alias("path"), F.lit(None).cast("string").alias("from_path"), "language", "text")
                gone = before.join(good, "file", "left_anti").select(F.lit(0).cast("bigint").alias("seq"), F.lit("D").alias("op"), F.col("file").alias("path"), F.lit(None).cast("string").alias("from_path"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("text"))
                feed = feed.unionByName(gone)
            else:
                work = change_work(loose, git.diff(self.spark, path, base))
                olds = work.filter("from_path is not null").select(F.lit("D").alias("op"), F.col("from_path").alias("path"), F.lit(None).cast("string").alias("from_path"))
                work = work.select("op", "path", "from_path").unionByName(olds.join(work.select("path"), "path", "left_anti"))
                feed = work.join(good.withColumnRenamed("file", "path"), "path", "left")
                feed = feed.select(F.lit(0).cast("bigint").alias("seq"), F.when(F.col("text").isNull(), "D").otherwise(F.col("op")).alias("op"), "path", "from_path", "language", "text")
            self.progress("parsing")
            report = index_changes(self.store, feed, chunk_files, self._embed_frame)
            self.progress("storing")
            self.store.update(self.store.chunks, state)
            self._load()
            return report | self.store.stats().first().asDict()
        finally:
            self.indexing = False

    def status(self) -> dict:
        own = self.store.stats().first().asDict()
        return own | {"model_id": self.store.manifest.model_id, "indexed_commit": self.store.manifest.indexed_commit, "indexing": self.indexing, "uptime": time.time() - self.started}
