"""Message envelopes from any broker-fed DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractflow.sources import RAW_EVENT_COLUMNS
from contractflow.sources.identity import arrival, with_identity


def from_envelope(df: DataFrame, stream_id: str | None = None) -> DataFrame:
    """``body binary, app_id string, queue string, delivery_tag bigint`` to raw events.

    Tags restart with every connection; :func:`contractflow.sources.sessions.with_sessions` adds the column
    ``session`` that puts them in order of arrival.  Stream and queue break ties.

    Bytes that are not UTF-8 cannot be JSON; they are kept as base64 text, which the parser
    refuses, so the message ends up in quarantine with its content preserved.
    """
    text = F.col("body").cast("string")
    placed = with_identity(df, "envelope", stream_id).withColumns(
        {
            "payload": F.when(F.is_valid_utf8(text), text).otherwise(F.concat(F.lit("base64:"), F.base64("body"))),
            "ord": arrival(
                F.col("delivery_tag"),
                F.concat_ws("/", *([F.lit(stream_id)] if stream_id else []), "queue"),
                session=F.col("session") if "session" in df.columns else 0,
            ),
            "received_at": (
                F.col("received_at") if "received_at" in df.columns else F.current_timestamp()
            ),
        }
    )
    return placed.select(*RAW_EVENT_COLUMNS)
