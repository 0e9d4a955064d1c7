"""Tables that grow by one folder per batch and are merged in tiers.

A *segment* is a folder ``segment=<first>-<last>`` with what the batches first to last have written.  Every batch writes a
segment of its own; each FAN of them are merged into one, each FAN of those into a larger one, and so on.
A reader takes the widest complete segments, newest first, so it opens about FAN folders per tier, and a row is
rewritten once per tier: neither grows with the number of batches but for its logarithm.

Failure.  A segment counts once its ``_SUCCESS`` is there, so a merge that breaks off leaves its parts in use.  A batch that
runs again replaces its own segment and the merges that end with it.  The parts of a merge are deleted
when the next one of the same tier is complete, so they are still there if its last batch runs again, and a
reader that has chosen them may finish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contractflow.tables import delete, exists, names_in

FAN = 16
PREFIX = "segment="

Span = tuple[int, int]


def _folder(path: str, span: Span) -> str:
    return f"{path}/{PREFIX}{span[0]}-{span[1]}"


def _listed(spark: SparkSession, path: str) -> list[Span]:
    found = [n.removeprefix(PREFIX).split("-") for n in names_in(spark, path) if n.startswith(PREFIX)]
    return [(int(first), int(last)) for first, last in found]


def chosen(spark: SparkSession, path: str, first: int = 0, before: int | None = None) -> list[Span]:
    """The widest complete segments of the batches from ``first`` and older than ``before``, newest first."""
    inside = [s for s in _listed(spark, path) if s[0] >= first and (before is None or s[1] < before)]
    taken: list[Span] = []
    for span in sorted(inside, key=lambda s: (-s[1], s[0])):
        if (not taken or span[1] < taken[-1][0]) and exists(spark, f"{_folder(path, span)}/_SUCCESS"):
            taken.append(span)
    return taken


def read_segments(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of all batches (older than ``before``); a row that later batches replace may still be among them."""
    return _rows(spark, path, schema, chosen(spark, path, before=before))


def _rows(spark: SparkSession, path: str, schema: str, spans: list[Span]) -> DataFrame:
    if not spans:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[_folder(path, s) for s in spans])


def write_segment(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch; running the batch again replaces what it wrote."""
    spark = rows.sparkSession
    for span in _listed(spark, path):
        if span[0] < span[1] == batch_id:
            delete(spark, _folder(path, span))
    rows.write.mode("overwrite").parquet(_folder(path, (batch_id, batch_id)))


def merge_segments(
    spark: SparkSession, path: str, schema: str, batch_id: int, combine: Callable[[DataFrame], DataFrame], fan: int = FAN
) -> list[Span]:
    """Merge the tiers that the batch completes; returns the segments written."""
    written = []
    size = fan
    while (batch_id + 1) % size == 0:
        span = (batch_id + 1 - size, batch_id)
        parts = chosen(spark, path, span[0], batch_id + 1)
        combine(_rows(spark, path, schema, parts)).write.mode("overwrite").parquet(_folder(path, span))
        written.append(span)
        drop_parts(spark, path, (span[0] - size, span[0] - 1))
        size *= fan
    return written


def drop_parts(spark: SparkSession, path: str, span: Span) -> None:
    """Delete the parts of a complete merge."""
    if exists(spark, f"{_folder(path, span)}/_SUCCESS"):
        for part in _listed(spark, path):
            if span[0] <= part[0] and part[1] <= span[1] and part != span:
                delete(spark, _folder(path, part))
