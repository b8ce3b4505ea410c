"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local threads.
``compare_lineitem`` is the whole comparison of two snapshots of the largest table: key scan,
join and export of all changed rows, statistics, and the checks of both sides;
``profile_lineitem`` the full profile of both.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import rowaccord as ra  # noqa: E402
from rowaccord.functions.storage import new_path  # noqa: E402
from verification import snapshots as s  # noqa: E402
from verification.registry import LINE_KEYS, QUERIES  # noqa: E402

HEADLINE = (
    "diff_counts",
    "diff_column_stats",
    "diff_changes",
    "diff_sample",
    "diff_composite_key",
    "diff_duplicate_keys",
    "diff_hot_keys",
    "profile_columns",
    "profile_nulls",
    "profile_distinct",
    "key_uniqueness",
    "discover_keys",
    "checks",
    "value_set_counts",
    "transactional_compare",
    "aggregation_compare",
)


def compare_lineitem(spark: SparkSession, folder: str) -> None:
    s.load(spark, folder, "lineitem")
    one, two = spark.table("lineitem"), spark.sql(s.LINEITEM_2)
    c = ra.compare(one, two, keys=LINE_KEYS, rules=ra.IgnoreRules(case=True, whitespace=True))
    changed = c.diff.stored(new_path(spark, "bench-changes"))
    changed.statistics().collect()
    c.checks().collect()


def profile_lineitem(spark: SparkSession, folder: str) -> None:
    s.load(spark, folder, "lineitem")
    for df in (spark.table("lineitem"), spark.sql(s.LINEITEM_2)):
        ra.profile_columns(df).collect()


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rowaccord-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rowaccord-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {name: (lambda n: lambda: consume(QUERIES[n](spark, folder)))(name) for name in HEADLINE}
    jobs["compare_lineitem"] = lambda: compare_lineitem(spark, folder)
    jobs["profile_lineitem"] = lambda: profile_lineitem(spark, folder)
    seconds: dict[str, float] = {}
    # The first run of each query compiles it; the best of the runs is reported.
    for name, job in jobs.items():
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            job()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    spark.stop()
    sf = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf.group(1)) if sf else folder,
            }
        )
    )


if __name__ == "__main__":
    main()
