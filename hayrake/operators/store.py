"""Index maintenance on tables of chunks and vectors, and the store that keeps their generations.

A generation is a folder of Parquet tables; a small manifest names the active
one and is replaced in one rename, so readers see the old generation or the
new one. Row ids are dense and deterministic; numbering is in two phases
(within ranges, then offsets of ranges), not in one task.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hayrake.errors import CorruptStore, DimensionMismatch, ModelMismatch, StoreNotEmpty, StoreStale
from hayrake.functions.vectors import dead_fraction
from hayrake.schema import CHUNK, SCHEMA_VERSION, VECTOR
from hayrake.session import materialise, prepare

COMPACT_ABOVE = 0.20


def numbered(df: DataFrame, name: str, order: list[str], start: int = 0) -> DataFrame:
    """df with dense numbers from start in that order (the order must tell all rows apart)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = dict(ranged.groupBy("_part").count().collect())  # one row for each partition
    offsets, at = [], start
    for k in range(max(counts, default=0) + 1):
        offsets.append(at)
        at += counts.get(k, 0)
    base = F.element_at(F.array(*map(F.lit, offsets)), F.col("_part") + 1)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, (base + rank - 1).cast("bigint")).drop("_part")


def dedup_insert(live: DataFrame, batch: DataFrame, start: int, order: str = "ord") -> DataFrame:
    """batch (ord, content_hash, ...) with row_id and outcome.

    A hash that is live already is reused; of equal hashes in the batch the
    first is inserted and the others are reused. New rows are numbered in
    their order from start.
    """
    known = live.select("content_hash", F.col("row_id").alias("known_id")).groupBy("content_hash").agg(F.min("known_id").alias("known_id"))
    rank = F.row_number().over(Window.partitionBy("content_hash").orderBy(order))
    marked = batch.withColumn("_first", rank == 1).join(known, "content_hash", "left")
    new = numbered(marked.filter("_first and known_id is null").select(order, "content_hash"), "row_id", [order], start).select("content_hash", F.col("row_id").alias("new_id"))
    out = marked.join(new, "content_hash", "left")
    outcome = F.when(F.col("known_id").isNotNull(), "reused").when(F.col("_first"), "inserted").otherwise("reused")
    return out.withColumn("row_id", F.coalesce("known_id", "new_id")).withColumn("outcome", outcome).drop("_first", "known_id", "new_id")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, content_hash and action of two states of chunks: add, keep, tombstone, or skip where a file's set of hashes is the same."""
    sides = old.select("file", "content_hash").distinct().withColumn("old", F.lit(1)).join(new.select("file", "content_hash").distinct().withColumn("new", F.lit(1)), ["file", "content_hash"], "full_outer")
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "tombstone").otherwise("keep")
    marked = sides.select("file", "content_hash", action.alias("action"))
    same = F.min(F.col("action") == "keep").over(Window.partitionBy("file"))
    return marked.select("file", "content_hash", F.when(same, "skip").otherwise(F.col("action")).alias("action"))


def changed_rows(old: DataFrame, new: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The live rows of new that old has not alike in those columns, and the row_id of old's live rows that new has not."""
    mark = F.xxhash64(F.to_json(F.struct(*columns))).alias("_mark")
    was, now = old.filter("live").select("row_id", mark), new.filter("live").select("*", mark)
    return now.join(was, ["row_id", "_mark"], "left_anti").drop("_mark"), was.select("row_id").join(now.select("row_id"), "row_id", "left_anti")


def compaction_map(chunks: DataFrame) -> DataFrame:
    """old_id and new_id of the live rows, renumbered from 0 in the old order."""
    return numbered(chunks.filter("live").select(F.col("row_id").alias("old_id")), "new_id", ["old_id"])


def renumber(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """df with row_id by the mapping; rows outside it are left out."""
    return df.join(mapping, df.row_id == mapping.old_id).drop("row_id", "old_id").withColumnRenamed("new_id", "row_id").select(*df.columns)


def stats(chunks: DataFrame) -> DataFrame:
    live, dead = F.count_if(F.col("live")), F.count_if(~F.col("live"))
    return chunks.agg(live.alias("live"), dead.alias("dead"), dead_fraction(live, dead).alias("dead_fraction"))


def verify(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """problem and row_id: orphan vectors, missing vectors, and rows of live hashes that occur more than once."""
    orphan = vectors.select("row_id").join(chunks.select("row_id"), "row_id", "left_anti").withColumn("problem", F.lit("orphan"))
    missing = chunks.select("row_id").join(vectors.select("row_id"), "row_id", "left_anti").withColumn("problem", F.lit("missing"))
    twice = chunks.filter("live").withColumn("n", F.count("*").over(Window.partitionBy("content_hash"))).filter("n > 1").select("row_id", F.lit("duplicate").alias("problem"))
    return orphan.unionByName(missing).unionByName(twice).select("problem", "row_id")


def tombstone(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    dead = rows.select("row_id").distinct().withColumn("_dead", F.lit(True))
    return chunks.join(dead, "row_id", "left").withColumn("live", F.col("live") & F.col("_dead").isNull()).drop("_dead").select(*chunks.columns)


def rekey(chunks: DataFrame, renames: DataFrame) -> DataFrame:
    """chunks with the files of live rows renamed by (from_path, path)."""
    moved = renames.select(F.col("from_path").alias("file"), F.col("path").alias("_to"))
    out = chunks.join(F.broadcast(moved) if moved.count() <= 100_000 else moved, "file", "left")
    return out.withColumn("file", F.when(F.col("live"), F.coalesce("_to", "file")).otherwise(F.col("file"))).drop("_to").select(*chunks.columns)


def change_work(dirty: DataFrame, diff: DataFrame) -> DataFrame:
    """One change for each path: a dirty one before that of the diff (op, path, from_path, ord)."""
    both = dirty.withColumn("_side", F.lit(0)).unionByName(diff.withColumn("_side", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("_side", "ord"))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_side")


@dataclass
class Manifest:
    model_id: str
    dims: int
    generation: str = ""
    schema_version: int = SCHEMA_VERSION
    indexed_commit: str | None = None
    store_id: str = field(default_factory=lambda: uuid.uuid4().hex)


class Store:
    """Generations of a chunk table and a vector table below one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest) -> None:
        self.spark, self.path, self.manifest = prepare(spark), path, manifest

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, model_id: str, dims: int) -> Store:
        p, fs = cls._fs(spark, path)
        if fs.exists(p) and len(fs.listStatus(p)):
            raise StoreNotEmpty(f"{path} is not empty")
        store = cls(spark, path, Manifest(model_id, dims))
        store.publish(spark.createDataFrame([], CHUNK), spark.createDataFrame([], VECTOR))
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, check: bool = True) -> Store:
        p, fs = cls._fs(spark, f"{path}/MANIFEST.json")
        if not fs.exists(p):
            raise CorruptStore(f"{path} has no manifest")
        stream = fs.open(p)
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        manifest = Manifest(**json.loads(text))
        if manifest.schema_version != SCHEMA_VERSION:
            raise CorruptStore(f"schema version {manifest.schema_version}, not {SCHEMA_VERSION}")
        if "/" in manifest.generation or manifest.generation in ("", ".", ".."):
            raise CorruptStore("the manifest names a generation outside the store")
        store = cls(spark, path, manifest)
        if check:
            store.reclaim()
            found = [r.asDict() for r in store.verify().limit(5).collect()]
            if found:
                raise CorruptStore(f"problems: {found}")
        return store

    def check_model(self, model_id: str) -> None:
        if model_id != self.manifest.model_id:
            raise ModelMismatch(f"the store holds vectors of {self.manifest.model_id!r}, not {model_id!r}")

    def check_fresh(self) -> None:
        """StoreStale if the store was removed or made anew since it was opened."""
        try:
            now = Store.open(self.spark, self.path, check=False).manifest.store_id
        except CorruptStore as error:
            raise StoreStale(f"{self.path} is gone") from error
        if now != self.manifest.store_id:
            raise StoreStale(f"{self.path} was made anew")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.manifest.generation}/{name}")

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks", CHUNK)

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors", VECTOR)

    def publish(self, chunks: DataFrame, vectors: DataFrame, commit: str | None = None) -> None:
        """Writes a generation and makes it the active one. Until the rename the old one stays."""
        generation = f"generation-{uuid.uuid4().hex[:12]}"
        for name, df, schema in (("chunks", chunks, CHUNK), ("vectors", vectors, VECTOR)):
            columns = [c.split()[0] for c in schema.split(", ")]
            df.select(*columns).write.parquet(f"{self.path}/{generation}/{name}")
        manifest = Manifest(**(asdict(self.manifest) | {"generation": generation, "indexed_commit": commit or self.manifest.indexed_commit}))
        temp, fs = self._fs(self.spark, f"{self.path}/.manifest-{generation}")
        out = fs.create(temp, True)
        try:
            out.write(bytearray(json.dumps(asdict(manifest)).encode()))
            out.hsync()
        finally:
            out.close()
        final, _ = self._fs(self.spark, f"{self.path}/MANIFEST.json")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        over = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temp, final, over)
        self.manifest = manifest

    def insert(self, batch: DataFrame, vectors: DataFrame) -> DataFrame:
        """Adds chunks (ord and chunk columns) with vectors (ord, vector); returns batch with row_id and outcome."""
        wrong = vectors.filter(F.size("vector") != self.manifest.dims).limit(1).count()
        if wrong:
            raise DimensionMismatch(f"a vector has not {self.manifest.dims} dimensions")
        old, old_vectors = self.chunks, self.vectors
        start = old.agg(F.coalesce(F.max("row_id"), F.lit(-1))).first()[0] + 1
        placed = materialise(dedup_insert(old.filter("live"), batch, start), "placed")
        new = placed.filter("outcome = 'inserted'").withColumn("live", F.lit(True))
        for c in (c.split() for c in CHUNK.split(", ")):
            if c[0] not in new.columns:
                new = new.withColumn(c[0], F.lit(None).cast(c[1]))
        added = new.select("ord", "row_id").join(vectors, "ord").select("row_id", F.col("vector").cast("array<float>"))
        self.publish(old.unionByName(new.select(*old.columns)), old_vectors.unionByName(added))
        return placed

    def update(self, chunks: DataFrame, commit: str | None = None) -> None:
        self.publish(chunks, self.vectors, commit)

    def stats(self) -> DataFrame:
        return stats(self.chunks)

    def verify(self) -> DataFrame:
        return verify(self.chunks, self.vectors)

    def reclaim(self) -> int:
        """Drops vectors behind the last chunk, if chunks are numbered without gaps; returns their number."""
        got = self.chunks.agg(F.count("*").alias("n"), F.max("row_id").alias("last")).first()
        last = -1 if got.last is None else got.last
        if got.n != last + 1:
            return 0
        extra = self.vectors.filter(F.col("row_id") > last).count()
        if extra:
            self.publish(self.chunks, self.vectors.filter(F.col("row_id") <= last))
        return extra

    def compact(self, above: float = COMPACT_ABOVE) -> DataFrame | None:
        """Renumbers the live rows if the dead share is above; returns the mapping."""
        if self.stats().first().dead_fraction <= above:
            return None
        mapping = materialise(compaction_map(self.chunks), "mapping")
        self.publish(renumber(self.chunks.filter("live"), mapping), renumber(self.vectors, mapping))
        return mapping


