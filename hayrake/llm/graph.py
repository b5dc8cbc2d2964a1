"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrake.session import drop, materialise


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b) of longs: node and comp, the smallest node reachable, of all nodes but the smallest of a component.

    Every step only takes minima by node and joins them back, so a node with
    any number of neighbours is pre-aggregated and split; steps are written
    to the shared folder. A graph of diameter d needs about log(d) steps.
    """
    star = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star, before = materialise(star, "edges"), None
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, star = star, materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(old)
        if now == before or not now[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = now
