"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS as set by the driver."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINE = ["tile_cpc", "od_pairs_flow", "generated_flow", "features_dg", "sample_destinations", "report_decile", "spatial_join_within", "mlp_small", "population_full", "compare_models", "osm_point_filter", "feat_landuse_pivot"]


def main() -> None:
    from pyspark.sql import SparkSession

    from odflow.catalog import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for k in range(4):  # the first warms up
            begin = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
