"""Event sources.  Every source yields the raw-event columns of :data:`RAW_EVENT_COLUMNS`."""

# ord is struct<batch bigint, session bigint, seq bigint, tie string>: the arrival position of the event.
RAW_EVENT_COLUMNS = ("source", "origin", "fallback_id", "payload", "ord", "received_at")
