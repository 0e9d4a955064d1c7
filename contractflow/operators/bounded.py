"""Size checks in front of everything that is collected or broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# Side tables up to this many rows and bytes are inlined as literals.
INLINE_LIMIT = 512
INLINE_BYTES = 256 * 1024
# Side tables up to this many rows and bytes are broadcast.
BROADCAST_LIMIT = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def is_small(df: DataFrame, limit: int = BROADCAST_LIMIT, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``limit`` rows and ``max_bytes`` bytes of text.

    One row comes to the driver, and reading stops soon after the limit is passed.  The
    table is evaluated for this, so derived tables are better stored first.
    """
    width = " + ".join(f"coalesce(octet_length(cast(`{c}` as string)), 0)" for c in df.columns)
    widths = df.selectExpr(f"cast({width} as bigint) as w").limit(limit + 1)
    found = widths.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("w"), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= limit and found["bytes"] <= max_bytes


def small_rows(df: DataFrame, limit: int = INLINE_LIMIT, max_bytes: int = INLINE_BYTES) -> list[Row] | None:
    """The rows of a stored table if it is small, otherwise None."""
    return df.collect() if is_small(df, limit, max_bytes) else None


def lookup_join(
    big: DataFrame,
    side: DataFrame,
    on: list[str],
    how: str = "left",
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Join a fact table with a side table that has at most one row per key.

    A side table below ``limit`` rows is broadcast.  Beyond that both sides are shuffled.  One key may
    carry a large share of the fact rows: adaptive execution splits such partitions by their measured
    size and repeats only the one partition of the side table, so nothing is copied for the other keys.
    """
    return big.join(F.broadcast(side) if is_small(side, limit) else side, on, how)


def over_all_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """Lay out few bytes with much work per row over as many tasks as the session shuffles into.

    Adaptive execution merges partitions by size and knows nothing of the work.  The hash of the
    keys is used because a layout by the keys themselves may already be in place, in which case
    the planner would drop this one.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, F.xxhash64(*keys))


def in_ranges_over_all_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """As :func:`over_all_tasks`, with rows that are neighbours in the order of the keys in the same task and sorted."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
