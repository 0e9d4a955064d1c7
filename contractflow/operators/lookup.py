"""Point lookup of an event in the raw log, through an index instead of a scan.

Which value is an event's id depends on the aliases known when it is asked for, so the index has every value that
could ever be it: the one under the canonical key, or else those of all keys with its normal form.  It holds a
hash of the value and the place of the row, sorted by hash, so a lookup reads one row group or so of each segment, and
then the listed rows only.  The healed view over those rows decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.contract import Contract, ContractError
from contractflow.functions.text import lit
from contractflow.operators.extract import slot
from contractflow.operators.raw_log import FILE_SCHEMA, raw_schema
from contractflow.operators.registry import Aliases
from contractflow.operators.segments import merge_segments, read_segments, write_segment
from contractflow.operators.shim import healed_view

INDEX_SCHEMA = "hash bigint, batch_id bigint, file_name string, row bigint"
# places looked at together; an id that many rows could have is gone through in steps
PLACES = 256


def _sorted(entries: DataFrame) -> DataFrame:
    return entries.repartitionByRange("hash").sortWithinPartitions("hash", "batch_id", "file_name", "row")


def write_index(stored: DataFrame, root: str, batch_id: int, field: str) -> None:
    """Index a stored batch; ``stored`` is read from files, with slots."""
    texts = f"if({slot(field, 'text')} is not null, array({slot(field, 'text')}), transform({slot(field, 'others')}, o -> o.text))"
    placed = stored.select(
        F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row"), F.expr(f"array_distinct({texts})").alias("texts")
    )
    entries = placed.selectExpr("file_name", "row", "explode(texts) as text").where("text is not null").selectExpr(
        "xxhash64(text) as hash", f"{batch_id}L as batch_id", "file_name", "row"
    )
    path = f"{root}/raw_index"
    write_segment(_sorted(entries), path, batch_id)
    merge_segments(stored.sparkSession, path, INDEX_SCHEMA, batch_id, _sorted)


def places_of(spark: SparkSession, root: str, value: str) -> DataFrame:
    """``batch_id, file_name, row`` of the rows one of whose values may be the given one."""
    entries = read_segments(spark, f"{root}/raw_index", INDEX_SCHEMA)
    return entries.where(F.expr(f"hash = xxhash64({lit(value)})")).select("batch_id", "file_name", "row")


def rows_at(spark: SparkSession, root: str, places: list, contract: Contract) -> DataFrame:
    """The raw rows at some places, with their ids; only their files are opened."""
    files = sorted({(p["batch_id"], p["file_name"]) for p in places})
    batches = sorted({b for b, _ in files})
    paths = [f"{root}/raw_events/batch_id={b}/malformed=false/{f}" for b, f in files]
    known = spark.read.schema(FILE_SCHEMA).parquet(*[f"{root}/raw_files/batch_id={b}" for b in batches])
    wanted = spark.createDataFrame([(p["file_name"], p["row"]) for p in places], "file_name string, __row bigint")
    found = wanted.join(F.broadcast(known.select("file_name", "first_id")), "file_name")
    rows = spark.read.schema(raw_schema(contract)).parquet(*paths)
    placed = rows.withColumns({"file_name": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})
    joined = placed.join(F.broadcast(found), ["file_name", "__row"])
    return joined.withColumn("id", F.col("first_id") + F.col("__row")).drop("file_name", "first_id", "__row")


def find_event(
    spark: SparkSession, root: str, event_id: str, aliases: Aliases, contract: Contract, safe_keys_only: bool = True
) -> DataFrame:
    """The row of the view with this event id that arrived first; empty if there is none."""
    if not contract.event:
        raise ContractError("the contract names no event id, so events cannot be looked up")
    column = contract.field(contract.event).view_column
    rest = places_of(spark, root, event_id)
    while True:
        places = rest.orderBy("batch_id", "file_name", "row").limit(PLACES).collect()
        if not places:
            view = healed_view(spark.createDataFrame([], f"id bigint, {raw_schema(contract)}"), aliases, contract, safe_keys_only)
            return view
        view = healed_view(rows_at(spark, root, places, contract), aliases, contract, safe_keys_only)
        found = view.where(F.col(column) == event_id).orderBy("id").limit(1)
        if len(places) < PLACES or not found.isEmpty():
            return found
        last = places[-1]
        rest = rest.where(
            F.struct("batch_id", "file_name", "row") > F.struct(F.lit(last["batch_id"]), F.lit(last["file_name"]), F.lit(last["row"]))
        )
