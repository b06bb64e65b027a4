"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {key: sec}, "sf"}.
Each query is built and fully executed (``noop`` sink, so every row is produced but
nothing is collected); the reported time includes planning.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from splitlens.plans import registry  # noqa: E402
from splitlens.session import local_session  # noqa: E402

HEADLINE = [
    "web_log_clean", "master", "kpi_summary", "error_rate_by_step", "attempts",
    "finisher_rate", "funnel", "process_durations", "completion_durations",
    "steps_crosstab", "balance_describe", "ztest_completion", "ztest_error_rate",
    "welch_duration", "duration_by_age", "step_duration_by_arm",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="splitlens-bench")
    qs = registry.queries()
    # JVM warm-up (class loading, codegen caches) on a small query, not timed
    qs["demo_clean"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for key in keys:
        t0 = time.perf_counter()
        qs[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
    spark.stop()
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
