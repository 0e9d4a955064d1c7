"""Which publisher may teach a new spelling of which field."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.functions.text import names
from contractflow.operators.bounded import INLINE_LIMIT, lookup_join, small_rows

# The default policy.
PROTECTED_FIELDS = ("userId",)
TRUSTED_ORIGINS = ("partner-feed", "internal-batch")

MAX_PROTECTED = 10_000


@dataclass(frozen=True)
class Policy:
    """Protected fields may be taught by trusted origins only; other fields by anyone.

    ``trusted`` is a list while small and a one-column DataFrame ``origin`` beyond that.
    ``deny_all`` is the fail-closed state of a policy that could not be read.
    """

    protected: tuple[str, ...] = PROTECTED_FIELDS
    trusted: tuple[str, ...] | DataFrame = TRUSTED_ORIGINS
    deny_all: bool = False


def save_policy(spark: SparkSession, path: str, protected: list[str], trusted: list[str]) -> None:
    spark.createDataFrame([(p,) for p in protected], "field string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/protected_fields"
    )
    spark.createDataFrame([(t,) for t in trusted], "origin string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/trusted_origins"
    )


def load_policy(spark: SparkSession, path: str, limit: int = INLINE_LIMIT) -> Policy:
    """Read ``<path>/protected_fields`` and ``<path>/trusted_origins``.

    A policy that cannot be read, for whatever reason, or that holds no row at all, denies everything.
    """
    try:
        fields = small_rows(spark.read.schema("field string").parquet(f"{path}/protected_fields").distinct(), MAX_PROTECTED)
        origins = spark.read.schema("origin string").parquet(f"{path}/trusted_origins").distinct()
        few = small_rows(origins, limit)
    except (PySparkException, Py4JError) as error:
        # missing, damaged or out of reach: nobody may teach
        logging.getLogger(__name__).warning("policy %s cannot be read: %s", path, type(error).__name__)
        return Policy(deny_all=True)
    if fields is None:
        raise ValueError(f"{path}/protected_fields lists more fields than any contract can have")
    if not fields and few is not None and not few:
        return Policy(deny_all=True)
    trusted = origins if few is None else tuple(r["origin"] for r in few)
    return Policy(tuple(r["field"] for r in fields), trusted)


def with_trust(events: DataFrame, policy: Policy | None) -> DataFrame:
    """Add ``trusted``: whether the event's origin is a trusted one."""
    if policy is None or policy.deny_all:
        return events.withColumn("trusted", F.lit(policy is None))
    if isinstance(policy.trusted, tuple):
        known = f"coalesce(origin in ({names(policy.trusted)}), false)" if policy.trusted else "false"
        return events.selectExpr("*", f"{known} as trusted")
    side = policy.trusted.select("origin").distinct().withColumn("__t", F.lit(True))
    joined = lookup_join(events, side, ["origin"], "left")
    return joined.withColumn("trusted", F.coalesce("__t", F.lit(False))).drop("__t")


def may_teach(policy: Policy | None, field: str) -> str:
    """Decision for one field of an event carrying ``trusted``; default is to deny."""
    if policy is None:
        return "true"
    if policy.deny_all:
        return "false"
    return f"coalesce({field} not in ({names(policy.protected)}) or trusted, false)" if policy.protected else "true"


def policy_gate(candidates: DataFrame, policy: Policy | None) -> DataFrame:
    """Add ``allow`` to candidate rows that carry ``origin`` and ``canonical``."""
    return (
        with_trust(candidates, policy)
        .withColumn("allow", F.expr(may_teach(policy, "canonical")))
        .drop("trusted")
    )
