"""Usage metrics: which events carry one, and the last-write-wins table of ciphertexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.functions.crypto import MODULUS, PublicKey, encrypt_metric
from contractflow.functions.text import event_key, lit
from contractflow.operators.bounded import in_ranges_over_all_tasks
from contractflow.operators.segments import FAN, merge_segments, read_segments, write_segment
from contractflow.sources.identity import ORD_TYPE

# Fixed value: text accepted as a whole number (no blanks, no decimals).
WHOLE_NUMBER = r"^[+-]?[0-9]+\z"

METRIC_SCHEMA = f"event_id string, user_id string, ciphertext binary, encrypted_at timestamp, ord {ORD_TYPE}"


def metric_value(text: str) -> str:
    """Non-negative 64-bit value of the text, null otherwise."""
    return (
        f"if({text} rlike {lit(WHOLE_NUMBER)} and try_cast({text} as bigint) >= 0, try_cast({text} as bigint), null)"
    )


def eligible_metrics(judged: DataFrame, user: str = "userId", metric: str = "msPlayed", event: str = "eventId") -> DataFrame:
    """``event_id, user_id, ms_played, ord, received_at`` of events with an owner and a usable value."""
    named = f"values.`{event}`" if event else "cast(null as string)"
    return judged.selectExpr(
        f"{event_key(named, 'fallback_id')} as event_id",
        f"values.`{user}` as user_id",
        f"{metric_value(f'values.`{metric}`')} as ms_played",
        "ord",
        "received_at",
    ).where("user_id is not null and ms_played is not null")


def encryptable(metrics: DataFrame, modulus: int = MODULUS) -> DataFrame:
    return metrics.where(F.col("ms_played") < modulus)


def latest_per_event(metrics: DataFrame) -> DataFrame:
    """Last write per ``event_id``.  An aggregate with partial results, so that copies of one id
    are reduced before the shuffle."""
    rest = [c for c in metrics.columns if c != "event_id"]
    return (
        metrics.groupBy("event_id")
        .agg(F.max_by(F.struct(*rest), F.col("ord")).alias("last"))
        .select("event_id", "last.*")
    )


def encrypt_metrics(metrics: DataFrame, key: PublicKey | None, modulus: int = MODULUS) -> DataFrame:
    """Rows of the metric table; values out of range are left out before the UDF sees them.

    The rows are small but each costs an encryption, so they are laid out over many tasks first, in ranges of users and
    events: a user's rows lie together and are folded before ciphertexts move, and a user with most of the rows is
    still cut over many tasks.
    """
    rows = encryptable(metrics, modulus) if key is not None else metrics.where(F.lit(False))
    return in_ranges_over_all_tasks(rows, "user_id", "event_id", "ord").select(
        "event_id",
        "user_id",
        encrypt_metric(F.col("ms_played"), key, modulus).alias("ciphertext"),
        F.col("received_at").alias("encrypted_at"),
        "ord",
    )


def upsert_metrics(rows: DataFrame, path: str, batch_id: int, fan: int = FAN) -> None:
    """Write one batch and merge what it completes; running the batch again replaces what it wrote."""
    write_segment(rows, path, batch_id)
    merge_segments(rows.sparkSession, path, METRIC_SCHEMA, batch_id, latest_per_event, fan)


def read_metrics(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Current rows of the metric table (as the batches older than ``before`` left it)."""
    return latest_per_event(read_segments(spark, path, METRIC_SCHEMA, before))


def read_user_metrics(spark: SparkSession, path: str, user_id: str) -> DataFrame:
    """Current rows of one user.  Only events that ever had this user are resolved, so the filter
    reaches the scan and the ciphertexts of other events are not shuffled."""
    rows = read_segments(spark, path, METRIC_SCHEMA)
    ids = rows.where(F.col("user_id") == user_id).select("event_id").distinct()
    return latest_per_event(rows.join(ids, "event_id", "left_semi")).where(F.col("user_id") == user_id)


def ciphertexts_for_user(metrics: DataFrame, user_id: str) -> DataFrame:
    return metrics.where(F.col("user_id") == user_id).select("event_id", "ciphertext").orderBy("event_id")
