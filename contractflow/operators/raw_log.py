"""The append-only raw log.

A batch is written once, under ``batch_id=<n>``; well-formed and quarantined events are kept
apart by the partition column ``malformed``.  Ids are consecutive numbers in arrival order, yet
need no global sort in one task: every written file holds a range of the arrival order, a small table records
how many rows each file has, and an id is the file's first id plus the row's index in it.  Input whose
partitions are ranges already, as files written one after the other and queues read in pieces are, is written
where it is; other input is range-partitioned first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contractflow.contract import Contract
from contractflow.operators.bounded import lookup_join
from contractflow.operators.parse import parse_events, slots_type
from contractflow.sources.identity import ORD_TYPE
from contractflow.tables import exists

FILE_SCHEMA = "file_name string, rows bigint, first_id bigint"


def raw_schema(contract: Contract) -> str:
    return (
        f"source string, origin string, fallback_id string, ord {ORD_TYPE}, received_at timestamp, "
        f"payload string, slots {slots_type(contract)}"
    )


def in_ranges(events: DataFrame) -> bool:
    """Whether every partition of the input holds a range of the arrival order of its own.

    One narrow pass, which the sampling for a range partitioning would need as well; one row per partition is compared.
    """
    ranges = events.groupBy(F.spark_partition_id().alias("part")).agg(F.min("ord").alias("low"), F.max("ord").alias("high"))
    following = ranges.withColumn("next", F.lead("low").over(Window.orderBy("low", "high")))
    return following.where("next <= high").isEmpty()


def append_raw(
    events: DataFrame,
    root: str,
    batch_id: int,
    contract: Contract,
    arrival_order: bool = True,
    observed: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> None:
    """Parse and write one batch; running the batch again replaces what it wrote.

    Without ``arrival_order`` the write never needs a shuffle, and ids follow the input's file order.  ``observed``
    may watch the rows, ``malformed`` among their columns, as they are written.
    """
    spark = events.sparkSession
    placed = events.repartitionByRange(F.col("ord")) if arrival_order and not in_ranges(events) else events
    rows = parse_events(placed, contract, keep_malformed=True)
    if arrival_order:
        # partition column first: the writer then keeps this order instead of sorting again
        rows = rows.sortWithinPartitions("malformed", "ord")
    observed(rows).write.mode("overwrite").partitionBy("malformed").parquet(f"{root}/raw_events/batch_id={batch_id}")

    stored = batch_rows(spark, root, batch_id, contract).select("ord", F.col("_metadata.file_name").alias("file_name"))
    counts = stored.groupBy("file_name").agg(F.count("*").alias("rows"), F.min("ord").alias("low"))
    # one row per written file of this batch, ordered by arrival or else by the task that wrote it
    task = F.regexp_extract("file_name", r"^part-(\d+)", 1).cast("int")
    order = Window.orderBy("low", "file_name") if arrival_order else Window.orderBy(task, "file_name")
    base = last_id(spark, root, before=batch_id)
    files = counts.withColumn("first_id", F.sum("rows").over(order) - F.col("rows") + F.lit(base + 1))
    files.select("file_name", "rows", "first_id").coalesce(1).write.mode("overwrite").parquet(
        f"{root}/raw_files/batch_id={batch_id}"
    )


def _files(spark: SparkSession, root: str) -> DataFrame | None:
    path = f"{root}/raw_files"
    return spark.read.schema(f"{FILE_SCHEMA}, batch_id bigint").parquet(path) if exists(spark, path) else None


def last_id(spark: SparkSession, root: str, before: int | None = None) -> int:
    """Highest id handed out so far, 0 for an empty log."""
    files = _files(spark, root)
    if files is None:
        return 0
    if before is not None:
        files = files.where(F.col("batch_id") < before)
    return files.agg(F.coalesce(F.max(F.col("first_id") + F.col("rows") - 1), F.lit(0))).collect()[0][0]


def batch_rows(spark: SparkSession, root: str, batch_id: int, contract: Contract) -> DataFrame:
    """Well-formed events of one stored batch, with slots."""
    path = f"{root}/raw_events/batch_id={batch_id}"
    return spark.read.schema(raw_schema(contract) + ", malformed boolean").parquet(path).where("not malformed")


def raw_log(spark: SparkSession, root: str, contract: Contract, with_id: bool = True) -> DataFrame:
    """All stored well-formed events."""
    schema = raw_schema(contract) + ", batch_id bigint, malformed boolean"
    rows = spark.read.schema(schema).parquet(f"{root}/raw_events").where("not malformed").drop("malformed")
    if not with_id:
        return rows
    numbered = rows.withColumns(
        {"file_name": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")}
    )
    files = _files(spark, root).select("batch_id", "file_name", "first_id")
    joined = lookup_join(numbered, files, ["batch_id", "file_name"], "inner")
    return joined.withColumn("id", F.col("first_id") + F.col("__row")).drop("file_name", "first_id", "__row")


def quarantine(spark: SparkSession, root: str, contract: Contract) -> DataFrame:
    """Events whose payload is not JSON, with the text as received."""
    schema = raw_schema(contract) + ", batch_id bigint, malformed boolean"
    return spark.read.schema(schema).parquet(f"{root}/raw_events").where("malformed").drop("malformed", "slots")
