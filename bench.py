"""Seconds of headline graph queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: median of $BENCH_RUNS (3) after a warm one, rows written to nowhere.

The stored graph and the search index, which the queries share, are built once and timed by themselves.
"""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
NAMES = ["impact_supplier_d3", "trace_paths_d4", "reverse_entries", "module_summary", "smells_all", "search_bm25", "graph_delta"]


def main() -> None:
    from pyspark.sql import SparkSession

    from symbolweave.plans.structure import corpus
    from symbolweave.projection import stored_graph
    from symbolweave.queries import queries

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, build in (("graph_build", stored_graph), ("search_index_build", corpus)):
        start = time.time()
        build(spark, sf)
        took[name] = round(time.time() - start, 3)
    for name in NAMES:
        runs = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.time()
            queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        took[name] = round(statistics.median(runs[1:] or runs), 3)
    print(json.dumps({"metric": "headline graph queries, total", "value": round(sum(took[n] for n in NAMES), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
