"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_RUNS (default 2, after one warm-up run).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "signal_stats", "cell_envelope", "zero_crossings", "pulse_detection", "pulse_detection_long_recording", "crossing_rate_bins", "stft_magnitude",
    "welch_psd", "mean_spectrum", "spectral_flux", "low_pass", "bit_usage", "lsb_verdict", "overlap_flags", "best_candidates", "identity_matches",
    "species_resolution", "annotation_tree",
]


def main() -> None:
    from echolake.plans import load_all
    from echolake.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus, "runs": runs,
    }))


if __name__ == "__main__":
    main()
