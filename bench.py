"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanline.catalog import load
from spanline.catalog.registry import QUERIES
from spanline.session import local_session

HEADLINE = [
    "dominant_state",
    "w01_run_length_encode",
    "w03_filter_min_duration",
    "w04_anchor_smooth",
    "w08_union_intervals",
    "w10_dedup_observations",
    "w11_merge_similar",
    "w13_feed_at",
    "w21_segment_rounds",
    "w29_switches",
    "w30_lifecycle",
    "src11_sampling_grid",
    "jn01_state_at",
    "jn03_asof_forward",
    "jn06_nearest_event",
    "jn08_overlap_duration",
    "jn10_valid_at",
    "jn13_relaxed_match",
    "jn17_lookahead_pending",
    "flt01_valid_observation",
    "ag02_majority_vote",
    "ag06_share_of_total",
    "ag12_label_accuracy",
    "ag23_transition_counts",
    "h02_parse_title",
    "h26_page_text",
    "h34_parse_event",
    "ml06_viterbi_smooth",
    "src09_ml07_flatten_stats",
    "st02_stream_sessions",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    load()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    QUERIES["w25_number_rows"](spark, sf).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(median(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
            }
        )
    )


if __name__ == "__main__":
    main()
