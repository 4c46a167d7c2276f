"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  tables to read (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query, after one warm-up run; the median counts (default 1)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "baseline_accuracy",
    "momentum_and_volatility",
    "sector_cohort_return",
    "neighbor_event_count",
    "structure_by_bar",
    "return_correlation",
    "lexicon_scores",
    "document_mentions",
    "documents_in_window",
    "news_features",
    "top_drivers",
    "barrier_outcomes",
    "strategy_metrics",
    "equity_curve",
    "sessions_equal_weight",
    "overlay_metrics",
    "permuted_globally",
    "bootstrap_drawdown",
    "sector_outlook",
    "feature_frame",
)


def main() -> None:
    import catalog
    from tidemark.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = max(1, int(os.environ.get("BENCH_RUNS", "1")))
    names = sys.argv[1:] or HEADLINE
    catalog.load()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", "16g")

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
