"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (full execution,
nothing collected) and timed; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pairs_resolved", "pairs_funnel", "guardrail_scan", "guardrail_profile", "language_detect",
    "metrics_escalation", "metrics_class_report", "metrics_latency", "judge_kappa",
    "sample_golden_set", "sample_smart_kb", "sample_fixed_gold", "kb_knn_embeddings",
    "kb_lexical_benchmark", "reply_constraints", "triage_conversations", "extras_sentence_bleu",
    "extras_rouge_l", "sources_tweets_csv_pairs", "kb_ingest", "kb_ticket_context",
    "judge_calibration_run", "stream_triage_rules",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from ticketlens.session import get_spark
    spark = get_spark("ticketlens-bench", cores=cpus, shuffle_partitions=int(cpus) * 2)
    from ticketlens.plans import QUERIES

    names = sys.argv[1:] or HEADLINE
    # warm-up (not timed): every query once on the smallest scale factor next to
    # sf_dir, so JIT compilation, codegen classes and Python workers are not
    # charged to whichever query happens to run first
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_dir = small if os.path.isdir(small) else sf_dir
    for n in names:
        try:
            QUERIES[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
        except Exception:  # noqa: BLE001 - e.g. a fixed-size sample larger than the tiny
            pass            # tables; the timed run below surfaces real errors
    times = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
