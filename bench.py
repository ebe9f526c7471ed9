"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line.

Each query runs once to warm up code generation and the page cache, then ``BENCH_RUNS`` times; the
median counts. Results are consumed with the noop sink, so no row is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tideline.queries.catalog import REGISTRY
from tideline.session import build_session

HEADLINE = {
    "flagship": "flagship_weekly_signals",
    "bars_1d": "bars_daily_supplier",
    "bars_multi_tf": "bars_count_snapshots",
    "bars_cal_iso": "bars_calendar_iso",
    "bars_anchor_us": "bars_anchored_us",
    "returns": "returns_bars",
    "emas": "ema_seeded_periods",
    "amas": "ama_long_all_sets",
    "indicators": "indicator_pack_zscore",
    "volatility": "volatility_table",
    "cycles": "ath_cycle",
    "asof": "asof_backward",
    "ctf": "ctf_all_combinations",
    "feature_store": "feature_store_join",
    "asset_stats": "asset_stats",
    "pair_corr": "pairwise_rolling_corr",
    "regimes": "regimes_for_assets",
    "signals": "signal_ema_cross",
    "triple_barrier": "label_triple_barrier",
    "garch": "garch_fit",
    "ic": "research_ic_table",
    "cpcv": "eval_cpcv",
    "quality": "quality_table_tests",
    "tf_emas": "ema_timeframes_count",
    "emas_suppliers": "ema_seeded_periods_suppliers",
    "rsi_suppliers": "rsi_suppliers",
    "volatility_suppliers": "range_volatility_suppliers",
    "cycles_suppliers": "ath_cycle_suppliers",
    "tick_ema": "tick_ema_split_keys",
    "near_duplicates": "text_near_duplicates",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = set(sys.argv[1:])
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("OFF")
    timings: dict[str, float] = {}
    for name, key in HEADLINE.items():
        if wanted and name not in wanted:
            continue
        took = []
        for i in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                took.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}))


main()
