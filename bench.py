"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assentlake.session import local_session  # noqa: E402
from verification import QUERIES  # noqa: E402

# The scan from text to hits, the report, log parsing with and without a running model, the
# leaderboards, and the matcher study.
HEADLINE = (
    "hits",
    "rank_models",
    "agg_harness",
    "agg_daily",
    "agg_phrases",
    "top_phrases_per_model",
    "quotes_round_robin",
    "corpus_stats",
    "report_summary",
    "norm_claude",
    "norm_codex",
    "norm_cursor",
    "line_audit",
    "payload_entries",
    "board_people",
    "board_models",
    "hottest_models",
    "profile",
    "matcher_sweep",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    warm_up = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in HEADLINE if os.path.isdir(warm_up) else ():
        QUERIES[name](spark, warm_up).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
