"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row computed, nothing
collected to the driver).  Prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a1_decayed_topic_counts",
    "a2_decayed_embeddings",
    "a3_decay_grid_topics",
    "a3_decay_grid_embeddings",
    "p1_clean_text",
    "k2_dedup_title_earliest",
    "p30_master_daily_multiseries",
    "w10_expanding_folds",
    "r5_event_importance_matrix",
    "a16_classification_report",
    "a20_bootstrap_ci",
    "a22_ovo_auc",
    "a33_threshold_sweep",
    "b1_portfolio_backtest",
    "b2_backtest_cost_scenarios",
    "r7_cost_sensitivity",
    "a23_roc_points",
    "a28_topic_stats",
    "t1_tfidf_label_scores",
    "t4_second_pass_other",
    "t5_hashed_embedding",
    "a23_macro_roc",
    "a1_decayed_counts_quarter_hours",
    "m4_forest_random_search",
    "m7_split_evaluation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    from tidemark.plans import registry
    from tidemark.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8))
    qs = registry.queries()
    names = [n for n in HEADLINE if n in qs]
    extra = [a for a in sys.argv[1:] if a in qs]
    names = extra or names
    # warm-up: JVM, Python workers, parquet footers
    qs["a34_source_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
