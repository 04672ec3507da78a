"""Times the headline queries: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from revverify.catalog import QUERIES

NAMES = ("clause_changes_by_kind", "win_segments", "agg_clause_fingerprints", "ent_extract", "mut_money_change", "set_block_diff", "agg_effective_verdict", "jn_reconcile_payloads", "agg_grid_change", "agg_false_pass", "fn_fingerprint")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        t = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
