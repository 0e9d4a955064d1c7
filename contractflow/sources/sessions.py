"""Sessions of a queue's delivery tags.

A broker counts the messages of a connection from 1, so a tag that is not larger than the one before it in the order of
receipt begins a new session, and (session, tag) is the order of arrival.  Sessions go on from batch to batch
through a small table: the last session, tag and time of every queue.

Only the narrow columns ``queue, received_at, delivery_tag`` are shuffled in ranges, so that a queue with most of the
messages is cut over many tasks: each numbers the sessions of its own range in one run over it, and one row per range and
queue compares the ends and carries the count on.  What comes out is one row per queue, time and tag, which the messages
are joined with, so the work per message does not depend on how many sessions there are.

Without ``received_at`` the order within a batch is that of the tags, and sessions change between batches only.  A message
received again (same time, same tag) begins no session.  Messages without a time belong to the session the batch begins
with, messages without a tag to the last one begun before their time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.operators.bounded import lookup_join
from contractflow.storage import cut_lineage

STATE_SCHEMA = "queue string, session bigint, tag bigint, at timestamp"


def no_sessions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def session_keys(keyed: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``queue, at, tag, session`` of all messages with a time, once each, and ``queue, base, session, tag, at`` of every queue.

    ``keyed`` is ``queue, at, tag``.  ``base`` is the number of the session that the state knows, -1 for a queue that is new;
    ``session``, ``tag`` and ``at`` are those of the queue's last message.
    """
    ranged = cut_lineage(
        keyed.where("at is not null").repartitionByRange("queue", "at", "tag").withColumn("part", F.spark_partition_id())
    )
    before = "(partition by part, queue order by at, tag rows between unbounded preceding and 1 preceding)"
    stepped = ranged.selectExpr(
        "part", "queue", "at", "tag", f"last(if(tag is null, null, struct(at, tag)), true) over {before} as last", f"last(struct(at, tag)) over {before} as above"
    )
    # a smaller tag, or the same one at a later time
    new = "tag < last.tag or (tag = last.tag and at > last.at)"
    begun = f"count_if(coalesce({new}, false)) over (partition by part, queue order by at, tag rows unbounded preceding)"
    # whether the first message with a tag opens a session is seen from the ranges before; messages from it on follow
    counted = cut_lineage(
        stepped.selectExpr("part", "queue", "at", "tag", "tag is not null or last is not null as follows", "above", f"{begun} as begun")
        .where("above is null or not (above <=> struct(at, tag))")
        .drop("above")
    )
    ends = counted.groupBy("part", "queue").agg(
        F.expr("min(struct(at, tag)) filter (where tag is not null)").alias("first"),
        F.expr("max(struct(at, tag)) filter (where tag is not null)").alias("end"),
        F.max("begun").alias("inside"),
    )
    # one row per range and queue
    chained = ends.withColumn("last", F.expr("last(end, true) over (partition by queue order by part rows between unbounded preceding and 1 preceding)"))
    joined = lookup_join(chained, state.selectExpr("queue", "session", "struct(at, tag) as known"), ["queue"])
    # the state's time may lie behind, if clocks differ; its tag decides alone
    edge = joined.selectExpr(
        "part", "queue", "session", "inside", "end", "first.at as at", "first.tag as tag", "last is null as begins",
        "if(last is null, struct(cast(null as timestamp) as at, known.tag as tag), last) as last",
    )
    opens = f"tag is not null and ((begins and (last.tag is null or tag <= last.tag)) or (not begins and ({new})))"
    # the state is asked for queues that have a message with time and tag
    base = "if(max(end) over (partition by queue) is null, -1, coalesce(session, -1))"
    above = "coalesce(sum(inside + edge) over (partition by queue order by part rows between unbounded preceding and 1 preceding), 0)"
    parts = cut_lineage(
        edge.withColumn("edge", F.expr(f"if({opens}, 1, 0)")).selectExpr("part", "queue", "end", "edge", f"{base} as base", f"{base} + {above} as offset", f"{base} + {above} + edge + inside as reached")
    )
    placed = lookup_join(counted, parts.select("part", "queue", "offset", "edge"), ["part", "queue"], "inner")
    found = placed.selectExpr("queue", "at", "tag", "cast(greatest(0, offset + begun + if(follows, edge, 0)) as bigint) as session")
    last = parts.where("end is not null").groupBy("queue").agg(F.max("end").alias("end"), F.max("reached").alias("session"), F.max("base").alias("base"))
    return found, cut_lineage(last.selectExpr("queue", "base", "session", "end.tag as tag", "end.at as at"))


def with_sessions(envelopes: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The envelopes with ``session``, and the state for the next batch.

    ``envelopes`` are read three times and must be a table that does not change; ``queue`` must tell apart all that is counted apart.
    """
    spark = envelopes.sparkSession
    state = no_sessions(spark) if state is None else state
    at = F.col("received_at") if "received_at" in envelopes.columns else F.lit(0).cast("timestamp")
    placed = envelopes.withColumns({"__at": at.cast("timestamp"), "__tag": F.col("delivery_tag").cast("bigint")})
    found, last = session_keys(placed.select("queue", F.col("__at").alias("at"), F.col("__tag").alias("tag")), state)
    # a queue without a name is in no state
    timed = F.col("__at").isNotNull() & F.col("queue").isNotNull()
    sessions = found.selectExpr("queue as __queue", "at as __time", "tag as __key", "session")
    same = (F.col("queue") == F.col("__queue")) & (F.col("__at") == F.col("__time")) & F.col("__tag").eqNullSafe(F.col("__key"))
    joined = placed.where(timed).join(sessions, same, "left").select(*envelopes.columns, F.coalesce("session", F.lit(0).cast("bigint")).alias("session"))
    others = lookup_join(placed.where(~timed), last.select("queue", "base"), ["queue"])
    untimed = others.select(*envelopes.columns, F.expr("cast(greatest(0, coalesce(base, -1)) as bigint)").alias("session"))
    now = last.selectExpr("queue", "cast(if(queue is null, 0, greatest(0, session)) as bigint) as session", "tag", "at")
    rest = state.join(now.select("queue"), "queue", "left_anti")
    return joined.unionByName(untimed), rest.unionByName(now)
