"""Arrival position and identity columns shared by the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractflow.functions.text import file_stem

# Transport labels.
UNKNOWN_ORIGIN = "unknown-app"
QUEUE_PREFIX = "amqp"

ORD_TYPE = "struct<batch:bigint,session:bigint,seq:bigint,tie:string>"


def arrival(
    seq: Column, tie: Column | None = None, batch: Column | int = 0, session: Column | int = 0
) -> Column:
    """Arrival position of an event: (batch, session, sequence number, tie-break), compared in that order."""
    batch, session = (F.lit(c) if isinstance(c, int) else c for c in (batch, session))
    tie = F.lit("") if tie is None else tie
    return F.struct(
        batch.cast("bigint").alias("batch"),
        session.cast("bigint").alias("session"),
        seq.cast("bigint").alias("seq"),
        tie.cast("string").alias("tie"),
    )


def with_batch(events: DataFrame, batch_id: int) -> DataFrame:
    """Stamp the micro-batch number into the arrival position."""
    return events.withColumn("ord", F.col("ord").withField("batch", F.lit(batch_id).cast("bigint")))


def with_identity(df: DataFrame, kind: str, stream_id: str | None = None) -> DataFrame:
    """Derive source, origin and fallback id.

    ``kind='file'`` reads ``path`` and ``file_name``; ``kind='envelope'`` reads ``queue``,
    ``delivery_tag`` and ``app_id``.  Delivery tags restart with every connection, so a ``stream_id`` and,
    where the rows have one, the ``session`` are worked into the fallback id to keep ids apart.
    """
    if kind == "file":
        stem = F.expr(file_stem("file_name"))
        return df.withColumns({"source": F.col("path"), "origin": stem, "fallback_id": stem})
    if kind == "envelope":
        tag = F.col("delivery_tag").cast("string")
        session = [F.col("session").cast("string")] if "session" in df.columns else []
        parts = [F.lit(QUEUE_PREFIX)] + ([F.lit(stream_id)] if stream_id else []) + session + [tag]
        return df.withColumns(
            {
                "source": F.concat(F.lit(f"{QUEUE_PREFIX}:"), F.col("queue"), F.lit(":"), tag),
                "origin": F.coalesce(F.col("app_id"), F.lit(UNKNOWN_ORIGIN)),
                "fallback_id": F.concat_ws("-", *parts),
            }
        )
    raise ValueError(f"unknown identity kind {kind!r}")
