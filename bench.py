"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1). BENCH_CPUS: local
threads (default 8). Each query runs once to warm up and then twice; the
better time counts. The headline queries build the lexical index in each run;
index_build and the warm_ entries, which are not in the total, tell apart what
building it takes and what a search of a built one takes. Results are written to Spark's noop sink, so all rows are
made.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hayrake.operators import fusion, lexical, search
from hayrake.plans import catalogue
from hayrake.plans.catalogue import QUERIES

HEADLINE = ["tokenize_terms", "postings_stats", "bm25_batch", "dense_batch", "rrf_fuse", "hybrid_search", "ablation_metrics", "dedup_insert", "snapshot_diff", "compaction_map", "percentile_nearest_rank", "normalize_hash"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}

    def measure(name: str, make: Callable[[], DataFrame]) -> None:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs[1:]), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr)

    for name in HEADLINE:
        measure(name, lambda name=name: QUERIES[name](spark, sf_dir))
    total = round(sum(took.values()), 3)
    chunks, vectors, asked = catalogue.chunks(spark, sf_dir), catalogue.vector_table(spark, sf_dir), catalogue.asked(spark, sf_dir)
    measure("index_build", lambda: lexical.build(chunks, catalogue.BOOSTS).lengths)
    index = lexical.build(chunks, catalogue.BOOSTS)
    for name, some in (("warm_search_one", asked.orderBy("query_id").limit(1)), ("warm_search_batch", asked)):
        measure(name, lambda some=some: fusion.assemble(fusion.fuse(*search.candidates(index, vectors, some, fusion.Fusion())[:2]), chunks, 10))
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("/sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
