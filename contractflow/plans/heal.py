"""The heal plan for one batch: learn from it, then judge every event of it in parallel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractflow.contract import Contract
from contractflow.functions.text import lit, string_array
from contractflow.operators.bounded import INLINE_LIMIT
from contractflow.operators.checks import VIOLATION_TYPE, conforms, values_in, violation_list
from contractflow.operators.discover import UNIQUE, missing_matches
from contractflow.operators.fence import fenced
from contractflow.operators.extract import any_missing, missing_fields, values_struct, via_struct, with_hits
from contractflow.operators.learning import REPLAY_LIMIT, learn_aliases
from contractflow.operators.policy import Policy, may_teach, with_trust
from contractflow.operators.registry import Aliases, alias_rows, as_aliases
from contractflow.storage import cut_lineage


REPAIR_TYPE = "array<struct<canonical:string,outcome:string,raw_key:string,candidates:array<string>>>"


@dataclass(frozen=True)
class Healed:
    judged: DataFrame
    learned: Aliases
    aliases: Aliases


def judge(events: DataFrame, aliases: Aliases, policy: Policy | None, contract: Contract) -> DataFrame:
    """Verdict of every event with the aliases known at its arrival.

    Adds ``values`` and ``resolved_via`` (structs with one member per field, null where nothing
    was found), ``missing_before, repairs, missing_required, conforms, violations``; breach and
    repairs look at the aliases known before the event, everything else at those known after its
    own lesson.  Reports are built for the events that need one only.
    """
    known = with_trust(with_hits(events, aliases, contract), policy)
    breach = any_missing(contract, "before")
    outcome = (
        f"case when m.outcome <> '{UNIQUE}' then m.outcome "
        f"when {may_teach(policy, 'm.canonical')} then 'healed' else 'denied' end"
    )
    repairs = (
        f"transform({missing_matches(contract, 'before')}, m -> named_struct("
        f"'canonical', m.canonical, 'outcome', {outcome}, 'raw_key', m.raw_key, 'candidates', m.candidates))"
    )
    resolved = known.selectExpr(
        "ord",
        "source",
        "origin",
        "fallback_id",
        "received_at",
        f"{values_struct(contract)} as values",
        f"{via_struct(contract)} as resolved_via",
        f"if({breach}, {missing_fields(contract, 'before')}, {string_array()}) as missing_before",
        f"if({breach}, {repairs}, cast(array() as {REPAIR_TYPE})) as repairs",
        f"if({breach}, {missing_fields(contract, 'after')}, {string_array()}) as missing_required",
    )
    value_of = values_in("values")
    verdict = resolved.selectExpr("*", f"size(missing_required) = 0 and {conforms(contract, value_of)} as conforms")
    report = f"if(conforms, cast(array() as {VIOLATION_TYPE}), {violation_list(contract, value_of)})"
    pinned = ["values", "resolved_via", "missing_before", "repairs", "missing_required", "conforms"]
    return fenced(verdict, {**{c: f"`{c}`" for c in pinned}, "violations": report})


def _widen(aliases: Aliases, learned: Aliases, contract: Contract, events: DataFrame) -> Aliases:
    if isinstance(aliases, list) and isinstance(learned, list) and len(aliases) + len(learned) <= INLINE_LIMIT:
        return as_aliases(aliases + learned, contract)
    spark = events.sparkSession
    tables = [alias_table(spark, a).select("canonical", "raw_key", "learned_pos") for a in (aliases, learned)]
    return as_aliases(cut_lineage(tables[0].unionByName(tables[1])), contract)


def alias_table(spark, aliases: Aliases) -> DataFrame:
    """Aliases as registry rows; a fresh alias counts as used when it was learned."""
    if isinstance(aliases, list):
        return alias_rows(spark, [(a.canonical, a.raw_key, a.pos, a.at, a.at) for a in aliases])
    table = aliases
    for name in ("learned_at", "last_used_at"):
        if name not in table.columns:
            source = F.col("learned_at") if "learned_at" in table.columns else F.lit(None)
            table = table.withColumn(name, source.cast("timestamp"))
    return table.select("canonical", "raw_key", "learned_pos", "learned_at", "last_used_at")


def heal(
    events: DataFrame,
    registry: Aliases | None,
    policy: Policy | None,
    contract: Contract,
    replay_limit: int = REPLAY_LIMIT,
) -> Healed:
    """``events`` carry slots.  Equal to processing them one by one in arrival order."""
    known = as_aliases(registry, contract)
    learned = learn_aliases(events, known, policy, contract, replay_limit)
    aliases = _widen(known, learned, contract, events)
    return Healed(judge(events, aliases, policy, contract), learned, aliases)


def used_pairs(judged: DataFrame, contract: Contract) -> DataFrame:
    """Learned aliases that resolved a field, with the last moment they did."""
    renamed = {n: f"resolved_via.`{n}` <> {lit(n)}" for n in contract.names}
    pairs = [
        f"if({test}, named_struct('canonical', {lit(n)}, 'raw_key', resolved_via.`{n}`), null)"
        for n, test in renamed.items()
    ]
    return (
        judged.where(" or ".join(renamed.values()))
        .selectExpr(f"inline(array_compact(array({', '.join(pairs)})))", "received_at")
        .groupBy("canonical", "raw_key")
        .agg(F.max("received_at").alias("used_at"))
    )
