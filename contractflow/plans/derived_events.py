"""Raw events derived from the ``events`` table by a fixed recipe.

Every seventeenth event takes one of seventeen payload forms: conforming ones, renames of one or
several fields, conflicting and agreeing spellings, missing fields, wrong types and broken JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contractflow.functions.text import names

ORIGINS = ("partner-feed", "internal-batch", "untrusted-source", "unknown-app")


def _member(key: str, value: str) -> str:
    return f"""concat('"{key}":', {value})"""


def _quoted(value: str) -> str:
    return f"""concat('"', {value}, '"')"""


def payload_text() -> str:
    """SQL expression of the payload over the columns of the ``events`` table."""
    event, user = _quoted("concat('evt-', event_id)"), _quoted("concat('u', user_id)")
    track = _quoted("concat('t', event_id % 97)")
    moment = _quoted("""date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")""")
    e, u = _member("eventId", event), _member("userId", user)
    k, t = _member("trackId", track), _member("timestamp", moment)
    m = _member("msPlayed", "floor(value * 1000)")
    plain = [e, m, t, k, u]
    forms = {
        3: [e, m, t, k, _member("userID", user)],
        4: [e, m, t, k, f"if(event_id % 4 >= 2, {_member('UserId', user)}, {u})"],
        5: [e, m, t, k, _member("user_id", user)],
        6: [e, m, t, _member("track_id", track), u],
        7: [_member("event_id", event), m, _member("time_stamp", moment), k, u],
        8: [_member("User.Id", user), e, m, t, k],
        9: [_member("USERID", user), e, m, t, k, _member("user.id", _quoted("'other'"))],
        10: [_member("TRACKID", track), e, m, t, _member("track-id", track), u],
        11: [e, m, t, u],
        12: [e, m, _member("timestamp", "event_id + 1700000000"), k, u],
        13: [e, _member("msPlayed", _quoted("'three minutes'")), t, k, u],
        14: [_member("USER_ID", user), e, m, t, k, _member("userId", "'null'")],
        15: [e, _member("msPlayed", "'-1'"), t, k, _member("userId", _quoted("''"))],
    }
    whens = " ".join(
        f"when {form} then concat('{{', concat_ws(',', {', '.join(parts)}), '}}')" for form, parts in forms.items()
    )
    broken = f"concat('{{', {e}, ',')"
    return (
        f"case event_id % 17 {whens} when 16 then {broken} "
        f"else concat('{{', concat_ws(',', {', '.join(plain)}), '}}') end"
    )


def derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events, with the table's ``event_id`` as arrival number."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    return events.selectExpr(
        "concat('events/input/', event_id, '.json') as source",
        f"element_at(array({names(ORIGINS)}), cast(event_id % 4 + 1 as int)) as origin",
        "concat('evt-file-', event_id) as fallback_id",
        f"{payload_text()} as payload",
        "named_struct('batch', 0L, 'session', 0L, 'seq', event_id, 'tie', '') as ord",
        "cast(ts as timestamp) as received_at",
    )
