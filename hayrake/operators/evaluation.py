"""The evaluation of retrieval: metrics by configuration, breakdowns of the fused one, medians of bytes, and the report."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrake.functions.text import length_bucket
from hayrake.operators import metrics
from hayrake.operators.fusion import Fusion
from hayrake.schema import HARNESS_VERSION

METRICS = ("top_1", "top_3", "top_10", "mrr")


@dataclass
class RunManifest:
    """What has to be the same for two runs to be compared."""

    repo_commit: str
    indexed_commit: str
    model_id: str
    label_set: str
    timestamp: str
    fusion: Fusion = field(default_factory=Fusion)
    harness_version: int = HARNESS_VERSION


def evaluate(hits: DataFrame, labels: DataFrame, discarded: int = 0) -> DataFrame:
    """part, name, labels_scored, labels_discarded and the metrics of hits (config, query_id, first_rank).

    A row of part ablation for each configuration, and of the fused one rows
    of parts source and length for each source and each bucket of length
    among labels (query_id, query, source). Groups without labels are left
    out; labels_discarded is the same number everywhere. One shuffle joins
    the labels, one sums all parts.
    """
    row = lambda part, name: F.struct(F.lit(part).alias("part"), name.alias("name"))
    fused = F.col("config") == "fused"
    parts = F.array(row("ablation", F.col("config")), F.when(fused, row("source", F.col("source"))), F.when(fused, row("length", F.col("bucket"))))
    own = labels.select("query_id", "source", length_bucket(F.col("query")).alias("bucket"))
    every = hits.join(own, "query_id").select("first_rank", F.explode(parts).alias("p")).filter("p is not null").select("first_rank", "p.part", "p.name")
    return metrics.summary(every, ["part", "name"]).withColumn("labels_discarded", F.lit(discarded).cast("bigint")).select("part", "name", "labels_scored", "labels_discarded", *METRICS)


def medians(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: the nearest-rank medians, as whole numbers, of bytes read until the first hit (query_id, bytes) by search and by the baseline.

    A query of the baseline without search results has read nothing.
    """
    both = baseline.select("query_id", F.col("bytes").alias("base")).join(results.select("query_id", "bytes"), "query_id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    return both.agg(metrics.nearest_rank(0.5, "bytes").cast("bigint").alias("search_median"), metrics.nearest_rank(0.5, "base").cast("bigint").alias("baseline_median"))


def report(evaluated: DataFrame, manifest: RunManifest) -> str:
    """The report as JSON: the manifest and the metrics of each part (a row for each configuration, source and bucket)."""
    said = asdict(manifest)
    said["fusion"] = {"lexical_depth": manifest.fusion.lexical_depth, "dense_depth": manifest.fusion.dense_depth, "rrf_k": float(manifest.fusion.k)}
    out: dict[str, dict] = {"manifest": said, "per_ablation": {}, "by_source": {}, "by_query_length": {}}
    of = {"ablation": "per_ablation", "source": "by_source", "length": "by_query_length"}
    for r in evaluated.orderBy("part", "name").collect():
        out[of[r.part]][str(r.name)] = {k: r[k] for k in ("labels_scored", "labels_discarded", *METRICS)}
    return json.dumps(out, indent=2)


def write_report(evaluated: DataFrame, manifest: RunManifest, path: str) -> None:
    """Writes the report below a folder of any file system that Spark writes to."""
    evaluated.sparkSession.createDataFrame([(report(evaluated, manifest),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
