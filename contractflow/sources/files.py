"""A flat directory of ``*.json`` files, one event per file, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.sources import RAW_EVENT_COLUMNS
from contractflow.sources.identity import arrival, with_identity


def _shape(files: DataFrame) -> DataFrame:
    meta = files.select(
        F.col("value").alias("payload"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_modification_time").alias("mtime"),
    )
    # arrival order of files: modification time, then path
    placed = with_identity(meta, "file").withColumns(
        {"ord": arrival(F.unix_micros("mtime"), F.col("path")), "received_at": F.current_timestamp()}
    )
    return placed.select(*RAW_EVENT_COLUMNS)


def read_event_files(spark: SparkSession, directory: str) -> DataFrame:
    reader = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.json")
    return _shape(reader.load(directory))


def stream_event_files(
    spark: SparkSession, directory: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _shape(reader.load(directory))
