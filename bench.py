"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]
and print one JSON line.  Each query is executed in full through the
``noop`` sink (all rows produced, nothing collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from replenix.plans import catalog  # noqa: E402
from replenix.session import build_session  # noqa: E402

HEADLINE = ("daily_sales", "restock_ranked", "window_8_30", "window_15", "window_30", "window_diagnostic",
            "decisions", "container_check", "top_urgent", "family_filter_fallback", "quality_same_demand")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or list(HEADLINE)
    extra = {"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")}
    if os.environ.get("BENCH_EVENT_LOG"):  # stage timings for scripts/stage_times.py
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus), extra=extra)
    qs = catalog.queries()
    # warm-up: JIT and file listing, not timed
    qs["stock_long"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
