"""Time operators on many copies of the events, one copy per day of a longer history, with and without a hot series.

usage: python scale.py [copies]      BENCH_SF_DIR and BENCH_CPUS as in bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from tierlake.operators import health, maintain, quantiles, rates, rollup, stats
from tierlake.schemas import DAY_MS, SERIES
from tierlake.session import local_session, scratch_path
from tierlake.sources import demo

OPERATORS = {
    "poller_stats": stats.poller_stats,
    "rollup_5min": rollup.rollup_samples,
    "rollup_hourly_sketch": lambda df: rollup.rollup_samples(df, "hourly", True),
    "percentiles_exact": lambda df: quantiles.percentiles_exact(rollup.numeric(df), SERIES, "value"),
    "latest_sample": maintain.latest_sample,
    "health_timeline": health.health_timeline,
    "counter_rate": rates.counter_rate,
}


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 100
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cpus, cpus * 2, "scale")
    copied = (
        demo.samples(spark, sf_dir, "customer")
        .repartition(cpus)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumns(
            {
                "timestamp_ms": F.col("timestamp_ms") + F.col("copy") * (30 * DAY_MS),
                "seq": F.col("seq") * copies + F.col("copy"),
            }
        )
        .drop("copy")
    )
    hot = F.col("seq") % 3 == 0
    tables = {
        "even": copied,
        "hot": copied.withColumns(
            {c: F.when(hot, F.lit(v)).otherwise(F.col(c)) for c, v in zip(SERIES, ("AFRICA", "hot", "click"))}
        ),
    }
    report = {}
    for name, df in tables.items():
        path = scratch_path(spark, f"scale-{name}")
        df.write.parquet(path)
        rows = spark.read.schema(df.schema).parquet(path)
        total = rows.count()
        for operator, run in OPERATORS.items():
            started = time.perf_counter()
            run(rows).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - started
            report[f"{operator}_{name}"] = {"sec": round(seconds, 2), "samples_per_sec": round(total / seconds)}
            print(operator, name, report[f"{operator}_{name}"], file=sys.stderr, flush=True)
    print(json.dumps({"samples": total, "cpus": cpus, "operators": report}))
    spark.stop()


if __name__ == "__main__":
    main()
