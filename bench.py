"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], over a catalog stored beforehand; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from quarrylane import queries

HEADLINE = ["search_flagship", "search_substring", "search_regex", "search_filters", "search_path_pattern", "terms_type", "stats_size", "date_histogram_month", "top_hits_by_extension", "duplicates_size_extension", "snapshot_diff", "net_changes", "apply_changes", "tree_metrics", "path_resolution", "text_export"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as folder:  # this runs on one machine
        spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"{folder}/cp").config("spark.sql.warehouse.dir", f"{folder}/wh").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        start = time.time()
        queries.prepare(spark, sf, f"{folder}/catalog")
        prepared, times = round(time.time() - start, 3), {}
        for name in HEADLINE:
            start = time.time()
            queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        rows = queries._files(spark, sf).count()
        spark.stop()
    print(json.dumps({"metric": "headline query seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "prepare_catalog": prepared, "catalog_rows": rows}))


if __name__ == "__main__":
    main()
