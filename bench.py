"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints a JSON line after each, the last is the total.

Every query runs whole, into a sink that keeps nothing. The first, untimed query starts the engine. The experiments come
last. A query that is still running when $BENCH_SECONDS are over is stopped and listed under ``stopped`` with the time it
had, and no further one starts.
"""
import json
import os
import tempfile
import threading
import time

from sparkaudit.checks.queries import QUERIES
from sparkaudit.session import build_session

HEADLINE = ["full_audit", "listing_duplicates", "price_robust_z", "modified_z", "invalid_dates", "expectation_report",
            "legacy_same_price_dates", "legacy_price_manipulation", "records_sharing_address", "average_precision",
            "plant_all", "isolation_forest", "matched_training_rows", "twin_anatomy", "duplicate_links", "scan_listings",
            "model_ridge", "model_forest", "model_gbt", "validation_run", "naive_comparison", "leakage_run"]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    end = time.perf_counter() + float(os.environ.get("BENCH_SECONDS", "1500"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    records = spark.read.parquet(f"{folder}/orders.parquet").count()
    QUERIES["missing_rate_by_status"](spark, folder).collect()
    times, stopped = {}, {}
    over = threading.Event()

    def stop():
        # a query of many jobs starts its next one after a cancelled one only if it failed to notice
        while not over.wait(1):
            if time.perf_counter() > end:
                spark.sparkContext.cancelAllJobs()

    threading.Thread(target=stop, daemon=True).start()
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        if start > end:
            stopped[name] = 0.0
            continue
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception:
            if time.perf_counter() <= end:
                raise
            stopped[name] = round(time.perf_counter() - start, 3)
        print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                          "queries": times, "stopped": stopped, "sf": os.path.basename(os.path.normpath(folder)),
                          "records": records, "records_per_sec": {n: round(records / t) for n, t in times.items()}}), flush=True)
    over.set()
    spark.stop()


if __name__ == "__main__":
    main()
