"""Headline queries timed once each after a warm-up, as one JSON line."""

from __future__ import annotations

import json
import os
import time

from tallyspark.catalog.index import QUERIES
from tallyspark.plans.session import build_session, clear_work

HEADLINE = [
    "a02_spend_by_category", "a05_trend_daily", "a06_trend_monthly", "a09_category_explorer", "a10_group_purchases", "a12_backfill_merchants",
    "w02_recent_per_category", "w08_number_parts", "o01_generate_occurrences", "o03_forecast", "o04_commitment_summary", "o08_occurrence_progress",
    "o14_late_charge", "j07_debt_detail", "o15_active_debts", "x23_maintenance_due", "x25_attention", "x28_eligible_reminders", "w06_rank_merchants",
    "m01_fold_confirmations", "m05_apply_payments", "m14_post_purchases", "dq01_check_splits", "dq06_check_integrity", "c05_suggest_all",
    "e01_predict_hybrid", "e06_threshold_sweep", "n06_normalize_item", "r04_money_tokens", "r07_detect_total", "r16_repair_targets", "r18_select_repairs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", app="bench",
        **{"spark.sql.shuffle.partitions": "16", "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a02_spend_by_category"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        clear_work(spark)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").split("sf")[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
