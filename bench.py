"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from threadgauge.plans.registry import queries
from threadgauge.session import local_session

HEADLINE = (
    "snp_06_roots_deep_chains",
    "snp_11_comments_table",
    "snp_18_half_split",
    "txt_01_html_to_text",
    "txt_02_sentence_split",
    "txt_06_pain_flag",
    "txt_11_dictionary_mentions",
    "smp_08_stratified_sample",
    "smp_15_fallback_rates",
    "smp_18_two_phase",
    "smp_24_label_queue",
    "ans_03_pack",
    "ans_13_two_level_assignment",
    "crd_02_card_metrics",
    "crd_10_rank_cards",
    "est_02_cluster_bootstrap",
    "est_04_interval",
    "est_06_ppi_mean",
    "est_11_share_panel",
    "est_15_signal_shares",
    "met_01_binary_metrics",
    "rep_04_unsolved",
    "trm_01_distinctive_terms",
    "led_02_summary",
    "led_04_admission",
    "gate_04_pattern_findings",
    "pub_08_funnel_bounds",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    plans = queries()
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        plans[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(found.group(1)) if found else folder,
    }))


if __name__ == "__main__":
    main()
