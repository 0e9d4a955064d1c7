"""One report per batch: what came in, what was decided and how long it took.

The numbers are observed while the batch writes its tables, so they cost no pass of their own, and the report is the
last thing a batch writes: a batch that broke off has none, and a batch that runs again replaces its report.
"""

from __future__ import annotations

import math
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from contractflow.operators.bounded import lookup_join
from contractflow.operators.decisions import LEVELS
from contractflow.operators.segments import merge_segments, read_segments, write_segment

OUTCOMES = ("healed", "denied", "ambiguous")

REPORT_SCHEMA = (
    "batch_id bigint, started_at timestamp, duration_ms bigint, rows_in bigint, malformed bigint, conforming bigint, not_conforming bigint, "
    f"{', '.join(f'{o} bigint' for o in OUTCOMES)}, decisions bigint, warnings bigint, first_us bigint, last_us bigint"
)


class BatchReport:
    """Watches the tables of one batch as they are written."""

    def __init__(self, batch_id: int):
        self.batch_id = batch_id
        self.started_at, self.clock = datetime.now(timezone.utc), time.monotonic()
        self.events, self.verdicts, self.decisions = Observation(), Observation(), Observation()

    def of_events(self, rows: DataFrame) -> DataFrame:
        return rows.observe(
            self.events, F.count(F.lit(1)).alias("rows_in"), F.count_if("malformed").alias("malformed")
        )

    def of_verdicts(self, judged: DataFrame) -> DataFrame:
        return judged.observe(
            self.verdicts,
            F.count_if("conforms").alias("conforming"),
            F.count_if(~F.col("conforms")).alias("not_conforming"),
            *[F.coalesce(F.sum(F.expr(f"size(filter(repairs, r -> r.outcome = '{o}'))")), F.lit(0)).alias(o) for o in OUTCOMES],
        )

    def of_decisions(self, log: DataFrame) -> DataFrame:
        warnings = F.col("level").isin(*LEVELS[: LEVELS.index("WARN") + 1])
        return log.observe(
            self.decisions,
            F.count(F.lit(1)).alias("decisions"),
            F.count_if(warnings).alias("warnings"),
            # unknown where a decision has no time
            F.when(F.count("ts") == F.count(F.lit(1)), F.min(F.unix_micros("ts"))).alias("first_us"),
            F.max(F.unix_micros("ts")).alias("last_us"),
        )

    def write(self, spark: SparkSession, root: str) -> None:
        seen = {k: v for o in (self.events, self.verdicts, self.decisions) for k, v in o.get.items()}
        seen |= {"batch_id": self.batch_id, "started_at": self.started_at}
        seen |= {"duration_ms": int(1000 * (time.monotonic() - self.clock))}
        names = [c.strip().split(" ")[0] for c in REPORT_SCHEMA.split(",")]
        row = spark.createDataFrame([tuple(seen[c] for c in names)], REPORT_SCHEMA)
        write_segment(row.coalesce(1), f"{root}/reports", self.batch_id)
        merge_segments(spark, f"{root}/reports", REPORT_SCHEMA, self.batch_id, lambda rows: rows.coalesce(1))


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    return read_segments(spark, f"{root}/reports", REPORT_SCHEMA)


def timed(decisions: DataFrame, reports: DataFrame) -> DataFrame:
    """Decisions with ``batch_ms`` and ``event_ms``; null for a batch without a report."""
    side = reports.select(
        "batch_id", F.col("duration_ms").alias("batch_ms"), (F.col("duration_ms") / F.col("rows_in")).alias("event_ms")
    )
    return lookup_join(decisions, side, ["batch_id"])


def tail_batches(reports: DataFrame, n: int) -> list[int]:
    """Batches that hold the newest ``n`` decisions, newest first.

    Batches are taken by their latest decision until those taken hold ``n`` rows that are all later than
    anything in the rest.  Only as many reports as that needs come to the driver.
    """
    newest = reports.where("decisions > 0").select("batch_id", "decisions", "first_us", "last_us")
    taken, rows = [], []
    for r in newest.orderBy(F.desc("last_us"), F.desc("batch_id")).toLocalIterator():
        # rows without a time come last in the tail
        rest = -math.inf if r["last_us"] is None else r["last_us"]
        if sum(d for d, first in rows if first is not None and first > rest) >= n:
            break
        taken.append(r["batch_id"])
        rows.append((r["decisions"], r["first_us"]))
    return taken
