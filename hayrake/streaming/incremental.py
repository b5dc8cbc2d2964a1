"""Index maintenance as a stream: each micro-batch of file states is merged into the chunk table of a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrake.operators import store as S
from hayrake.operators.lookup import keep_first
from hayrake.session import materialise

#: A feed of file states: op A or M with the file's chunks' text, D without, R with from_path.
FEED = "seq bigint, op string, path string, from_path string, language string, text string"


def merge_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """state (file, language, text) after a batch of changes; the last change of a path holds."""
    last = keep_first(batch, ["path"], [F.desc("seq")])
    moved = batch.filter("op = 'R'").select(F.col("from_path").alias("file"))
    gone = last.select(F.col("path").alias("file")).union(moved.join(last.filter("op <> 'D'").select(F.col("path").alias("file")), "file", "left_anti")).distinct()
    return state.join(gone, "file", "left_anti").select("file", "language", "text").unionByName(last.filter("op <> 'D'").select(F.col("path").alias("file"), "language", "text"))


def index_changes(store: S.Store, batch: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Applies a batch of changes to a store.

    Renamed rows move with their file; chunks (by chunk: files to chunks) of
    changed files are compared with the live ones by hash; vanished ones are
    tombstoned, and only hashes that are not live yet are embedded (by embed:
    ord and body to ord and vector). Applying a batch again changes nothing.
    """
    batch = materialise(keep_first(batch, ["path"], [F.desc("seq")]), "changes")
    chunks = store.chunks
    renames = batch.filter("op = 'R' and from_path is not null")
    if not renames.isEmpty():
        chunks = S.rekey(chunks, renames)
    changed = batch.select(F.col("path").alias("file"))
    new = chunk(batch.filter("op <> 'D'").select(F.col("path").alias("file"), "language", "text"))
    bad = materialise(new.filter("problem is not null").select("file").distinct(), "unparsed")
    new = materialise(S.numbered(new.filter("problem is null").drop("problem").withColumn("_f", F.coalesce("fragment", F.lit(-1))), "ord", ["file", "line_start", "line_end", "symbol", "_f", "content_hash"]).drop("_f"), "new")
    scope = changed.distinct().join(bad, "file", "left_anti")  # a file that cannot be parsed keeps its rows
    old = chunks.filter("live").join(scope, "file", "left_semi")
    gone = materialise(S.snapshot_diff(old, new).filter("action = 'tombstone'").join(old, ["file", "content_hash"]).select("row_id"), "gone")
    kept_elsewhere = new.select("content_hash").distinct()
    gone = materialise(gone.join(old.join(kept_elsewhere, "content_hash", "left_semi").select("row_id"), "row_id", "left_anti"), "gone")
    chunks = S.tombstone(chunks, gone)
    place = keep_first(new, ["content_hash"], ["ord"]).select("content_hash", F.col("file").alias("_file"), F.col("line_start").alias("_start"), F.col("line_end").alias("_end"))
    owned = chunks.join(place, "content_hash", "left")
    stays = F.col("live") & F.col("_file").isNotNull()  # line numbers, and the file of a moved body, follow the source
    owner_changed = owned.join(scope.withColumn("_in", F.lit(True)), "file", "left")
    now = owner_changed.withColumn("line_start", F.when(stays & F.col("_in"), F.col("_start")).otherwise(F.col("line_start"))).withColumn("line_end", F.when(stays & F.col("_in"), F.col("_end")).otherwise(F.col("line_end")))
    now = now.withColumn("file", F.when(stays & F.col("_in"), F.col("_file")).otherwise(F.col("file")))
    store.update(materialise(now.select(*chunks.columns), "chunks"))
    fresh = new.join(store.chunks.filter("live").select("content_hash"), "content_hash", "left_anti")
    fresh = materialise(keep_first(fresh, ["content_hash"], ["ord"]), "fresh")
    placed = store.insert(fresh, embed(fresh.select("ord", "body")))
    added = placed.filter("outcome = 'inserted'").count()
    removed = gone.count()
    compacted = store.compact() is not None
    return {"files": batch.count(), "added": added, "removed": removed, "embedded": added, "reused": new.count() - added, "unparsed": bad.count(), "compacted": int(compacted)}


def run_stream(spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Applies the JSON change files of a folder in order of arrival until all are seen; restarts go on where they ended."""
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).json(folder)
    feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
