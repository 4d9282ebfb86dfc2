"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eraflow import plans  # noqa: E402
from eraflow.session import build_session  # noqa: E402

#: query -> the step of the baseline table it stands for
HEADLINE = {
    "bars_daily": "raw rows to daily bars",
    "flagship_weekly_signal": "minimum slice",
    "records_per_ticker": "distinct dates per ticker (A1)",
    "universe_semi": "universe semi join (J8)",
    "records_between": "record-count filter (A2)",
    "attr_chain": "attribute join (J6)",
    "fill_defaults": "fills (P9)",
    "lenient_cast": "coercion (P10)",
    "code_prefix": "code prefixes (P15)",
    "label_encode": "label encoding (P16)",
    "narrow_types": "type narrowing (P18)",
    "feature_expansion": "per-ticker features (G1)",
    "rolling_stats": "rolling bundle (W10)",
    "horizon_summary": "84 horizons (W4, W31, W32)",
    "ema_recursive": "recursive means (W12)",
    "rsi_wilder": "Wilder RSI, 20 periods (W21)",
    "macd_abs": "MACD (W22)",
    "bollinger": "Bollinger bands (W24)",
    "rolling_corr": "pair correlations (W11)",
    "asof_report_lag": "point-in-time join (J12)",
    "feature_label_join": "feature/label join (J7)",
    "split_sets": "train/validation split (P22)",
    "era_score": "era scoring (A14)",
    "era_quintiles": "era quintiles (W18)",
    "auc_rank": "AUC (A21)",
    "portfolio_score": "portfolio scoring (PF5)",
    "dedup_first": "dedup (P20)",
    "csv_round_trip": "CSV write (S12)",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or list(HEADLINE)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__python__sql__dataFrameDebugging__enabled="false",
        spark__cleaner__referenceTracking__cleanCheckpoints="true",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM code paths and the Python workers before timing
    plans.QUERIES["bars_daily"](spark, folder).write.format("noop").mode("overwrite").save()
    spark.range(8).mapInPandas(lambda it: it, "id bigint").write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
