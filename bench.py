"""Time the headline queries: one JSON line with the seconds of each and their sum."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: The reference's own benchmark shapes (many LIKEs, ALL and DISTINCT aggregates, joins) and common ones.
QUERIES = "flagship like_many agg_all agg_distinct inner_join_equi cross_join lateral_join coll_sum group_as subquery_select semi_join anti_join top_k order_by outer_union path_key graph_path".split()


def main() -> None:
    from pyspark.sql import SparkSession

    from nestq import workload

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = workload.queries()
    queries["scan"](spark, sf_dir).collect()  # starts the engine
    seconds = {}
    for name in QUERIES:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 4)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)


if __name__ == "__main__":
    main()
