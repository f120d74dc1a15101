"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.  Each
query is run once to warm up, then timed over three runs; its figure is the
median.  Results go to Spark's no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from joinwright.operators.joins import join  # noqa: E402
from joinwright.plans import catalogue  # noqa: E402
from joinwright.sources.tables import series  # noqa: E402

HEADLINE = [
    "inner_int8", "inner_int8_hash", "inner_int8_merge", "inner_ts", "inner_date", "inner_float8", "multikey_residual", "keys9", "null_keys", "m2m", "lt_f8",
    "theta_multi", "left_project_inner", "left_is_null", "right_join", "full_join", "semi", "anti", "not_in_plain", "text_key", "star5",
]


def workloads(spark: SparkSession) -> dict:
    big = series(spark, 1, 200_000).selectExpr("cast(g as int) id", "cast(g % 1000 as int) val").repartition(4).cache()
    small = series(spark, 1, 5000).selectExpr("cast(g as int) id", "cast(g % 500 + 1 as int) ref_id").cache()
    big.count(), small.count()
    found = {}
    for s in ("hash", "merge"):
        found[f"micro_200k_{s}"] = lambda s=s: join(big, big, "id", strategy=s).groupBy().count()
    for s in ("hash", "merge", "nestloop"):
        found[f"micro_5k_{s}"] = lambda s=s: join(small, small, [("id", "ref_id")], strategy=s).groupBy().count()
    return found


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = catalogue.queries()
    runs = {name: lambda name=name: known[name](spark, sf_dir) for name in HEADLINE} | workloads(spark)
    seconds = {}
    for name, run in runs.items():
        took = []
        for _ in range(4):
            began = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "join_catalogue_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
