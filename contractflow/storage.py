"""Shared scratch folder, lineage cuts that survive the loss of executors, code for the workers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from contractflow.tables import delete


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if current is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="contractflow-"))
    return sc.getCheckpointDir()


# paths written inside the innermost temporary_tables block; none outside of any
_open_tables: ContextVar[list[str] | None] = ContextVar("open_tables", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written by :func:`cut_lineage` inside the block are deleted at its end.

    Yields their paths, the newest last; what is taken off the list stays.
    """
    written: list[str] = []
    token = _open_tables.set(written)
    try:
        yield written
    finally:
        _open_tables.reset(token)
        for path in written:
            delete(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    A written table rather than an RDD checkpoint: later steps read the columns they need, and its
    size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = _open_tables.get()
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Actions inside the block give up their shuffle files when they end, not when the driver next collects garbage.

    For results that are taken once: a table made inside the block is stored or fetched inside it.
    """
    before = spark.conf.get(RELEASE)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Workers do not see the driver's import path, so operators with Python functions call this first.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="contractflow-code-"), "contractflow")
    sc.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package)))
    _shipped.add(sc.applicationId)
