"""Times the headline queries, each from cold caches and each by itself; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from termforge.plans import registry

NAMES = ("lexicon", "forward_index", "inverted_index", "barrel_metadata", "stored_barrels", "term_search", "inverted_stats", "forward_stats", "stemmed_lexicon", "incremental_lexicon", "token_counts")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took, failed = {}, {}
    for name in NAMES:
        began = time.time()
        try:
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        except Exception as e:  # noqa: BLE001  one query must not lose the others' figures
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"{name}: {took.get(name, failed.get(name))}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    out = {"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}
    print(json.dumps(out | ({"failed": failed} if failed else {})), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
