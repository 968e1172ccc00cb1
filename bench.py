"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEAT (default 3),
BENCH_CONF (JSON of extra Spark settings, for experiments).
Setup (not timed per query, reported under "setup"): the fixture is mapped from the driver
tables and written as the month-partitioned raw table, then the clean table is written
once, and so are the RFM and product tables that some checks read. Each query then runs once
cold ("cold") and BENCH_REPEAT times warm into the noop sink; the median of the warm runs is
reported, with the Spark jobs that a run takes ("jobs") and the shuffles of its last plan.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from clickweave.config import build_session  # noqa: E402
from clickweave.operators.rfm import rfm  # noqa: E402
from clickweave.plans.registry import QUERIES, catalog_for  # noqa: E402

HEADLINE = [
    "clean_events", "funnel", "cohort_retention", "rfm", "product_metrics", "overview",
    "eda_monthly_shape", "eda_event_type_mix", "eda_null_audit", "eda_top_categories",
    "eda_category_depth", "eda_purchase_price_profile", "eda_duplicate_keys",
    "check_product_category", "check_rfm_segments", "check_month_completeness",
]

# rfm is computed anew each time, not read from its table
TIMED = {**QUERIES, "rfm": lambda s, d: rfm(catalog_for(s, d).clean(), catalog_for(s, d).params)}


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    extra = json.loads(os.environ.get("BENCH_CONF", "{}"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus), extra=extra)
    cat = catalog_for(spark, sf_dir)
    setup = {}
    t0 = time.time()
    cat.raw()
    setup["raw_table"] = round(time.time() - t0, 3)
    t0 = time.time()
    cat.clean()
    setup["clean_table"] = round(time.time() - t0, 3)

    for name in ("rfm", "product"):  # tables that several queries read: built once, reported here
        t0 = time.time()
        getattr(cat, name)()
        setup[f"{name}_table"] = round(time.time() - t0, 3)

    results, cold, exchanges, jobs = {}, {}, {}, {}
    for name in HEADLINE:
        times = []
        for i in range(repeat + 1):
            spark.sparkContext.setJobGroup(f"{name}-{i}", name)
            t0 = time.time()
            df = TIMED[name](spark, sf_dir)
            _noop(df)
            times.append(time.time() - t0)
        cold[name] = round(times[0], 3)
        results[name] = round(statistics.median(times[1:]), 3)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{name}-{repeat}"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        # shuffles (hash / range / single partition) of the last plan, reused ones not counted twice
        exchanges[name] = len(re.findall(r"(?<![A-Za-z])Exchange (?:hashpartitioning|rangepartitioning|SinglePartition)", plan))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "cold": cold,
        "setup": setup,
        "jobs": jobs,
        "exchanges": exchanges,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
