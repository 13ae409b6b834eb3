"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from voxlake.plans import catalog
from voxlake.session import build_session

HEADLINE = [
    "flagship_turn_report",
    "tx02_normalize_unicode",
    "tx12_normalize_documents",
    "tx12_normalize_for_wer",
    "tx09_word_errors",
    "ag01_corpus_wer",
    "ag03_bootstrap_ci",
    "ag06_wer_histograms",
    "ag07_latency_percentiles",
    "sg01_tokens_to_words",
    "sg02_natural_segments",
    "sg03_caption_cues",
    "wn04_seam_stitch",
    "wn05_speech_regions",
    "jn03_assign_speakers",
    "jn11_duplicate_contents",
    "ag16_cumulative_histogram",
    "st11_event_rate",
    "st12_wn15_error_alerts",
    "tx21_subword_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("voxlake-bench", os.environ.get("BENCH_CPUS", "8"), **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that starting the JVM and the Python workers is not charged to the first entry.
    catalog.QUERIES["tx10_word_edit_distance"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    line = {
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
