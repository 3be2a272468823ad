"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line. Each query runs to completion through the no-op sink
(full execution, nothing collected). One untimed pass over all queries warms
the JVM and the Python worker pool; each query's time is then the best of
$BENCH_RUNS timed passes."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexigen.plans import catalog as C  # noqa: E402
from lexigen.session import local_session  # noqa: E402

HEADLINE = [
    "eval_summary",
    "eval_detail",
    "exact_split",
    "assign_batches",
    "sft_examples",
    "length_profile",
    "vocab",
    "impressions",
    "judge_scores",
    "parse_list",
    "parse_scores",
    "training_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="lexigen-bench")
    qs = C.all_queries()
    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in HEADLINE:
        run(name)
    best: dict[str, float] = {}
    for _ in range(runs):
        for name in HEADLINE:
            dt = run(name)
            best[name] = min(dt, best.get(name, dt))
    times = {name: round(best[name], 3) for name in HEADLINE}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "total_headline_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
