"""Batches of searches: lexical and dense candidates, fused and assembled in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame

from hayrake.errors import HayrakeError, SearchFailed
from hayrake.operators import dense, lexical
from hayrake.operators.fusion import Fusion, assemble, fuse
from hayrake.session import materialise

_EMPTY = "query_id bigint, row_id bigint, score double, rank int"


@dataclass
class Diagnostics:
    lexical_ok: bool = True
    dense_ok: bool = True
    errors: dict[str, str] = field(default_factory=dict)


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], _EMPTY)


def _own_error(error: Exception) -> str | None:
    """What an error of this package, raised here or in a task, or of an unfit table says; None for others."""
    lines = str(error).splitlines() or [""]
    if isinstance(error, (HayrakeError, AnalysisException)):
        return lines[0]
    return next((x.strip() for x in lines if x.strip().startswith("hayrake.errors.")), None)


def candidates(index: lexical.Index | None, vectors: DataFrame | None, queries: DataFrame, config: Fusion = Fusion()) -> tuple[DataFrame, DataFrame, Diagnostics]:
    """Both candidate lists.

    If one retriever fails by an error of this package the other's list
    stands alone, and the diagnostics say so; if all that were asked fail, so
    does the search. Other errors, such as lost executors, are raised.
    """
    told, asked, found = Diagnostics(), 0, []
    for name, ask in (
        ("lexical", lambda: lexical.search(index, queries.select("query_id", "query"), config.lexical_depth) if index is not None and config.lexical_depth else None),
        ("dense", lambda: dense.search(vectors, queries.select("query_id", "query_vector").filter("query_vector is not null"), config.dense_depth) if vectors is not None and config.dense_depth else None),
    ):
        try:
            got = ask()
            found.append(_empty(queries) if got is None else materialise(got, name))
            asked += got is not None
        except (HayrakeError, PySparkException) as error:
            said = _own_error(error)
            if said is None:
                raise
            asked += 1
            setattr(told, f"{name}_ok", False)
            told.errors[name] = said
            found.append(_empty(queries))
    if told.errors and len(told.errors) == asked:
        raise SearchFailed("; ".join(f"{k}: {v}" for k, v in told.errors.items()))
    return found[0], found[1], told


def hybrid(index: lexical.Index, chunks: DataFrame, vectors: DataFrame, queries: DataFrame, top_k: int = 5, config: Fusion = Fusion()) -> tuple[DataFrame, Diagnostics]:
    """Results of all queries (query_id, query, query_vector), and which retrievers answered."""
    by_terms, by_vector, told = candidates(index, vectors, queries, config)
    return assemble(fuse(by_terms, by_vector, config), chunks, top_k), told


def similar(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, top_k: int = 5, config: Fusion = Fusion()) -> tuple[DataFrame, Diagnostics]:
    """Dense candidates alone, for snippets that were embedded as documents (query_id, query_vector)."""
    _, by_vector, told = candidates(None, vectors, queries, config)
    return assemble(fuse(_empty(queries), by_vector, config), chunks, top_k), told
