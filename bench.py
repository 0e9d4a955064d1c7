"""Headline queries, timed; prints one JSON line.

Each query runs to completion into a no-op sink, so every row and column is produced.
Set BENCH_SF_DIR and BENCH_CPUS to choose the tables and the number of local cores.  The tables are first
copied into one file per core, outside the timed part, as each of them is a single file.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from contractflow.plans import catalog
from contractflow.plans.derived_events import derived_events
from contractflow.streaming.loop import Store, heal_batch

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "canonical_payload",
    "canonical_extract",
    "rename_candidates",
    "learned_aliases",
    "healed_view",
    "played_per_user",
    "verdicts",
    "violation_report",
    "graph_verdicts",
    "ntriples_lines",
    "decision_log_counts",
    "metric_latest",
    "encrypted_user_totals",
    "raw_audit_count",
    "contract_on_orders",
    "orders_reference_check",
    "text_functions",
)


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("contractflow-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the tables as a cluster would hold them, in at least one split per core; not timed
    tables = f"{scratch}/tables"
    for name in ("events", "orders", "customer", "documents"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(int(CPUS)).write.parquet(f"{tables}/{name}.parquet")
    events = spark.read.parquet(f"{tables}/events.parquet").count()
    queries = catalog.catalog()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)

    # the whole loop for one batch: log, learn, judge, decide, encrypt, registry
    store = Store(f"{scratch}/store", policy=catalog.POLICY, key=catalog.demo_keys()[0])
    start = time.perf_counter()
    heal_batch(derived_events(spark, tables), 0, store)
    times["heal_batch"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    store.view(spark).write.format("noop").mode("overwrite").save()
    times["stored_view"] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "events": events,
                "heal_batch_events_per_sec": round(events / times["heal_batch"], 1),
                "key_bits": catalog.demo_keys()[0].n.bit_length(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
