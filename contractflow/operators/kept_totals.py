"""Encrypted totals per user, kept up to date batch by batch.

What a batch changes is folded into one ciphertext per user: its own values, and the inverses of the values that it
replaces, which take them out of the total of whoever owned them before.  Only the replaced rows of the metric
table are read for this.  A user's total is the product of the user's rows, one per segment, so reading it
touches no metric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.functions.crypto import PublicKey, negated
from contractflow.operators.bounded import is_small
from contractflow.operators.metrics import METRIC_SCHEMA, latest_per_event
from contractflow.operators.private_sum import encrypted_sum
from contractflow.operators.segments import FAN, merge_segments, read_segments, write_segment

TOTAL_SCHEMA = "user_id string, ciphertext binary, n bigint"


def changes(written: DataFrame, before: DataFrame, key: PublicKey) -> DataFrame:
    """``user_id, ciphertext, n`` of what a batch adds and takes out.

    ``written`` are the metric rows of the batch, one per event, ``before`` all rows of earlier batches.
    """
    ids = written.select("event_id")
    # a semi-join keeps the ciphertexts of other events out of the shuffle
    replaced = latest_per_event(before.join(F.broadcast(ids) if is_small(ids) else ids, "event_id", "left_semi"))
    added = written.select("user_id", "ciphertext", F.lit(1).cast("bigint").alias("n"))
    removed = replaced.select("user_id", negated(F.col("ciphertext"), key).alias("ciphertext"), F.lit(-1).cast("bigint").alias("n"))
    return added.unionByName(removed)


def update_totals(spark: SparkSession, metrics: str, path: str, batch_id: int, key: PublicKey, fan: int = FAN) -> None:
    """Bring the totals up to a batch whose metrics are written; running it again replaces what it wrote."""
    written = spark.read.schema(METRIC_SCHEMA).parquet(f"{metrics}/segment={batch_id}-{batch_id}")
    before = read_segments(spark, metrics, METRIC_SCHEMA, batch_id)

    def folded(rows: DataFrame) -> DataFrame:
        # a user whose values have all gone keeps a row, as larger segments may hold what it takes out
        return encrypted_sum(rows, ["user_id"], key).sortWithinPartitions("user_id")

    write_segment(folded(changes(written, before, key)), path, batch_id)
    merge_segments(spark, path, TOTAL_SCHEMA, batch_id, folded, fan)


def read_totals(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    """Rows to be folded and revealed by ``user_totals``, of one user or of all."""
    rows = read_segments(spark, path, TOTAL_SCHEMA)
    return rows if user_id is None else rows.where(F.col("user_id") == user_id)
