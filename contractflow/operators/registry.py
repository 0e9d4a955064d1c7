"""The alias registry: which raw keys stand for which canonical field, and since when.

A registry is a DataFrame of :data:`REGISTRY_SCHEMA`.  ``learned_pos`` is the arrival position of
the event that taught the alias; it orders the aliases of a field and decides which events saw it.

Operators take *aliases*: a list of :class:`Alias` while the registry is small (it is inlined into
the plan as a literal map), or the registry DataFrame itself beyond that (it is joined).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.contract import Contract, ContractError
from contractflow.functions.text import lit, normalize_key, timestamp_text
from contractflow.operators.bounded import INLINE_LIMIT, lookup_join, small_rows
from contractflow.sources.identity import ORD_TYPE
from contractflow.tables import read_version

REGISTRY_SCHEMA = (
    f"canonical string, raw_key string, learned_pos {ORD_TYPE}, learned_at timestamp, last_used_at timestamp"
)

# Positions before every event: the canonical names themselves come first, then seeded aliases.
DEFAULT_POS = (-2, 0, 0, "")
SEED_POS = (-1, 0, 0, "")

Position = tuple[int, int, int, str]


@dataclass(frozen=True)
class Alias:
    canonical: str
    raw_key: str
    pos: Position
    at: datetime | None = None


Aliases = list[Alias] | DataFrame


def position_sql(pos: Position) -> str:
    batch, session, seq, tie = pos
    return f"named_struct('batch', {batch}L, 'session', {session}L, 'seq', {seq}L, 'tie', {lit(tie)})"


def position_key(pos: Position) -> tuple[int, int, int, bytes]:
    """Driver-side sort key equal to Spark's order of position structs."""
    return (*pos[:3], pos[3].encode())


def alias_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), REGISTRY_SCHEMA)


def empty_registry(spark: SparkSession) -> DataFrame:
    return alias_rows(spark, [])


def default_registry(spark: SparkSession, contract: Contract) -> DataFrame:
    """Every canonical name is an alias of itself."""
    return alias_rows(spark, [(n, n, DEFAULT_POS, None, None) for n in contract.names])


def merge_registries(*tables: DataFrame) -> DataFrame:
    """Union without duplicates; of two rows for one pair the earlier position is kept."""
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t)
    return merged.groupBy("canonical", "raw_key").agg(
        F.min("learned_pos").alias("learned_pos"),
        F.min("learned_at").alias("learned_at"),
        F.max("last_used_at").alias("last_used_at"),
    )


def load_registry(spark: SparkSession, contract: Contract, path: str | None = None) -> DataFrame:
    """Canonical names plus the newest version of the learned aliases that the loop keeps under ``path``."""
    defaults = default_registry(spark, contract)
    stored = None if path is None else read_version(spark, path, REGISTRY_SCHEMA)
    return defaults if stored is None else merge_registries(defaults, stored)


def default_aliases(contract: Contract) -> list[Alias]:
    return [Alias(n, n, DEFAULT_POS) for n in contract.names]


def as_aliases(registry: Aliases | None, contract: Contract, limit: int = INLINE_LIMIT) -> Aliases:
    """Canonical names plus a registry, as a list when small and as a DataFrame otherwise."""
    if registry is None:
        return default_aliases(contract)
    if isinstance(registry, list):
        found = registry
    else:
        rows = small_rows(registry.select("canonical", "raw_key", "learned_pos"), limit)
        if rows is None:
            return _checked(registry, contract)
        found = [Alias(r["canonical"], r["raw_key"], tuple(r["learned_pos"] or SEED_POS)) for r in rows]
    for a in found:
        contract.check_alias(a.canonical, a.raw_key)
    known = {(a.canonical, a.raw_key) for a in found}
    missing = [a for a in default_aliases(contract) if (a.canonical, a.raw_key) not in known]
    return sorted(missing + found, key=lambda a: position_key(a.pos))


def _checked(registry: DataFrame, contract: Contract) -> DataFrame:
    pairs = ", ".join(f"{lit(name)}, {lit(norm)}" for name, norm in contract.normal_forms.items())
    belongs = f"{normalize_key('raw_key')} <=> try_element_at(map({pairs}), canonical)"
    bad = registry.where(f"not ({belongs})").limit(1).collect()
    if bad:
        raise ContractError(f"alias {bad[0]['raw_key']!r} does not belong to field {bad[0]['canonical']!r}")
    named = default_registry(registry.sparkSession, contract).select("canonical", "raw_key", "learned_pos")
    extra = registry.join(F.broadcast(named), ["canonical", "raw_key"], "left_anti")
    return named.unionByName(
        extra.selectExpr("canonical", "raw_key", f"coalesce(learned_pos, {position_sql(SEED_POS)}) as learned_pos")
    )


def alias_map(aliases: list[Alias]) -> dict[str, list[str]]:
    """Field to its keys in the order they are tried."""
    out: dict[str, list[str]] = {}
    for a in sorted(aliases, key=lambda a: position_key(a.pos)):
        out.setdefault(a.canonical, []).append(a.raw_key)
    return out


def learn(registry: DataFrame, learned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert-or-ignore: the widened registry and the rows that are really new."""
    fresh = merge_registries(learned).join(
        registry.select("canonical", "raw_key"), ["canonical", "raw_key"], "left_anti"
    )
    return registry.unionByName(fresh), fresh


def touch(registry: DataFrame, used: DataFrame) -> DataFrame:
    """Advance ``last_used_at`` of known pairs; ``used(canonical, raw_key, used_at)`` may repeat pairs.

    ``used`` is read more than once and had better be a stored table.
    """
    latest = used.groupBy("canonical", "raw_key").agg(F.max("used_at").alias("used_at"))
    joined = lookup_join(registry, latest, ["canonical", "raw_key"])
    return joined.withColumn("last_used_at", F.greatest("last_used_at", "used_at")).select(registry.columns)


def alias_audit(registry: DataFrame) -> DataFrame:
    """Learned aliases with both timestamps as text, sorted."""
    return (
        registry.where(F.col("canonical") != F.col("raw_key"))
        .select(
            "canonical",
            "raw_key",
            F.expr(timestamp_text("learned_at")).alias("learned_at"),
            F.expr(timestamp_text("last_used_at")).alias("last_used_at"),
        )
        .orderBy("canonical", "raw_key")
    )


def stale_aliases(registry: DataFrame, as_of: datetime | Column, age: timedelta) -> DataFrame:
    """Learned aliases not used during the last ``age``, longest unused first."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return (
        registry.where((F.col("canonical") != F.col("raw_key")) & (F.col("last_used_at") < moment - F.lit(age)))
        .select("canonical", "raw_key", "learned_at", "last_used_at")
        .orderBy("last_used_at", "canonical", "raw_key")
    )
