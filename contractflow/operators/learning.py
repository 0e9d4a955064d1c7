"""Learn aliases from a whole batch at once, with the result of one-by-one processing.

What an event proposes for a field depends on the event alone: the set of its keys with that
normal form (kept only if unique or in agreement).  It teaches the first key of that set unless
some key of the set is known by then.  So of all events with the same key set only the first one
can teach, and one aggregation ``(field, key set) -> first arrival`` carries everything there is
to know.  Fields whose normal forms are distinct do not influence each other; those that share one do, and
are replayed together (:mod:`contractflow.operators.shared_forms`).
"""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractflow.contract import Contract
from contractflow.operators.bounded import lookup_join, small_rows
from contractflow.functions.text import lit, string_array
from contractflow.operators.discover import agreeing
from contractflow.operators.extract import slot
from contractflow.operators.policy import Policy, may_teach, with_trust
from contractflow.operators.registry import Alias, Aliases, alias_rows, as_aliases, position_key
from contractflow.operators.shared_forms import learn_shared
from contractflow.sources.identity import ORD_TYPE
from contractflow.storage import cut_lineage, ship_package

# Up to this many distinct key sets are replayed on the driver, more in tasks.
REPLAY_LIMIT = 20_000
REPLAY_BYTES = 16 * 1024 * 1024
# Key sets that one task replays together.
COMPONENT_LIMIT = 100_000


def lessons(events: DataFrame, aliases: Aliases, policy: Policy | None, contract: Contract) -> DataFrame:
    """First arrival of every key set that may teach: ``canonical, keys, ord, at``.

    Lone keys and sets of values without scalar text are sets of one; other sets list every key
    that would have resolved the field had it been known.
    """
    offers = []
    lone = lone_fields(contract)
    for n in lone:
        others = slot(n, "others")
        keys = (
            f"if(exists({others}, o -> o.scalar), transform({others}, o -> o.key), array({others}[0].key))"
        )
        allowed = may_teach(policy, lit(n))
        if isinstance(aliases, list):
            known = string_array([a.raw_key for a in aliases if a.canonical == n])
            allowed = f"{allowed} and not arrays_overlap({keys}, {known})"
        offers.append(
            f"if(size({others}) > 0 and {agreeing(others)} and {allowed}, "
            f"array(named_struct('canonical', {lit(n)}, 'keys', {keys})), "
            "cast(array() as array<struct<canonical:string,keys:array<string>>>))"
        )
    some = " or ".join(f"size({slot(n, 'others')}) > 0" for n in lone)
    slim = events.where(some).select("ord", "received_at", "origin", "slots")
    offered = with_trust(slim, policy).selectExpr(
        "named_struct('ord', ord, 'at', received_at) as arrival", f"inline(concat({', '.join(offers)}))"
    )
    first = (
        offered.groupBy("canonical", "keys")
        .agg(F.min("arrival").alias("arrival"))
        .select("canonical", "keys", "arrival.ord", "arrival.at")
    )
    if isinstance(aliases, list):
        return first
    known_sets = lookup_join(
        first.select("canonical", "keys", F.explode("keys").alias("raw_key")),
        aliases.select("canonical", "raw_key"),
        ["canonical", "raw_key"],
        "inner",
    ).select("canonical", "keys")
    return first.join(known_sets.distinct(), ["canonical", "keys"], "left_anti")


def lone_fields(contract: Contract) -> list[str]:
    """Required fields that share their normal form with no other."""
    shared = {n for fields in contract.shared_forms.values() for n in fields}
    return [n for n in contract.required if n not in shared]


def replay(rows: list[tuple[str, list[str], tuple, datetime | None]]) -> list[Alias]:
    """One-by-one processing of a few key sets none of whose keys is known yet."""
    known: set[tuple[str, str]] = set()
    learned = []
    for canonical, keys, pos, at in sorted(rows, key=lambda r: position_key(r[2])):
        if not any((canonical, k) in known for k in keys):
            known.add((canonical, keys[0]))
            learned.append(Alias(canonical, keys[0], pos, at))
    return learned


def with_component(first: DataFrame) -> DataFrame:
    """``first`` with ``component``: key sets that share keys, directly or through others, have the same; stored.

    In every round a set takes the least label among the sets that share a key with it, and then the label of
    the set with that label, so the number of rounds is about the logarithm of the longest chain.
    """
    sets = cut_lineage(first.withColumn("set", F.monotonically_increasing_id()))
    member = cut_lineage(sets.select("canonical", "set", F.explode("keys").alias("raw_key")))
    labels = cut_lineage(sets.select("set", F.col("set").alias("label")))
    while True:
        seen = member.join(labels, "set")
        least = seen.groupBy("canonical", "raw_key").agg(F.min("label").alias("near"))
        near = member.join(least, ["canonical", "raw_key"]).groupBy("set").agg(F.min("near").alias("near"))
        beyond = labels.select(F.col("set").alias("near"), F.col("label").alias("beyond"))
        moved = cut_lineage(near.join(beyond, "near").join(labels, "set").select("set", F.least("near", "beyond").alias("label"), F.col("label").alias("old")))
        if moved.where("label < old").isEmpty():
            return cut_lineage(sets.join(moved.select("set", F.col("label").alias("component")), "set").drop("set"))
        labels = moved.select("set", "label")


def resolve_by_components(first: DataFrame, limit: int = COMPONENT_LIMIT) -> DataFrame:
    """:func:`replay` for any number of key sets: ``canonical, raw_key, learned_pos, learned_at``.

    Sets of different components have nothing to do with each other, so every component is replayed by itself, in the
    task that holds it.  A component of more than ``limit`` sets is resolved by joins.
    """
    ship_package(first.sparkSession)
    placed = with_component(first)
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > limit).select("component"))
    schema = f"canonical string, raw_key string, learned_pos {ORD_TYPE}, learned_at timestamp"
    position = pa.struct([("batch", pa.int64()), ("session", pa.int64()), ("seq", pa.int64()), ("tie", pa.string())])
    types = pa.schema(
        [("canonical", pa.string()), ("raw_key", pa.string()), ("learned_pos", position), ("learned_at", pa.timestamp("us", "UTC"))]
    )

    def replayed(table: pa.Table) -> pa.Table:
        rows = [(r["canonical"], r["keys"], tuple(r["ord"].values()), r["at"]) for r in table.to_pylist()]
        learned = [
            {
                "canonical": a.canonical,
                "raw_key": a.raw_key,
                "learned_pos": {f.name: v for f, v in zip(position, a.pos)},
                "learned_at": a.at,
            }
            for a in replay(rows)
        ]
        return pa.Table.from_pylist(learned, schema=types)

    small = lookup_join(placed, large.withColumn("large", F.lit(True)), ["component"]).where("large is null")
    found = small.select("component", *first.columns).groupBy("component").applyInArrow(replayed, schema)
    if large.isEmpty():
        return found
    rest = placed.join(large, "component", "left_semi").select(*first.columns)
    return found.unionByName(resolve_by_joins(rest))


def resolve_by_joins(first: DataFrame) -> DataFrame:
    """The same for any number of key sets: ``canonical, raw_key, learned_pos, learned_at``.

    Each round decides every set whose fate no longer depends on an undecided earlier one: it is
    void if one of its keys was learned before it, and it teaches if no undecided set in front of
    it could teach one of its keys.  The earliest undecided set is always decided.
    """
    pending = cut_lineage(first.withColumn("head", F.element_at("keys", 1)))
    alias_columns = [
        F.col("canonical"), F.col("head").alias("raw_key"), F.col("ord").alias("learned_pos"), F.col("at").alias("learned_at")
    ]
    learned = cut_lineage(pending.where(F.lit(False)).select(*alias_columns))
    while not pending.isEmpty():
        # a set is found again by its keys: positions may repeat
        member = pending.select("canonical", "keys", F.explode("keys").alias("raw_key"))
        front = pending.groupBy("canonical", F.col("head").alias("raw_key")).agg(F.min("ord").alias("front"))
        pair = ["canonical", "raw_key"]
        known = lookup_join(member, learned.select(*pair, "learned_pos"), pair)
        state = (
            lookup_join(known, cut_lineage(front), pair)
            .groupBy("canonical", "keys")
            .agg(F.min("learned_pos").alias("known"), F.min("front").alias("front"))
        )
        judged = cut_lineage(
            pending.join(state, ["canonical", "keys"])
            .withColumn("void", F.coalesce(F.col("known") < F.col("ord"), F.lit(False)))
            .withColumn("teaches", ~F.col("void") & (F.col("front") >= F.col("ord")))
        )
        taught = judged.where("teaches").select(*alias_columns)
        learned = cut_lineage(learned.unionByName(taught))
        pending = cut_lineage(judged.where("not void and not teaches").select(pending.columns))
    return learned


def learn_aliases(
    events: DataFrame,
    registry: Aliases | None,
    policy: Policy | None,
    contract: Contract,
    replay_limit: int = REPLAY_LIMIT,
) -> list[Alias] | DataFrame:
    """Aliases this batch adds to ``registry``, with the position each was learned at."""
    known = as_aliases(registry, contract)
    learned: list[Alias] | DataFrame = []
    if lone_fields(contract):
        first = cut_lineage(lessons(events, known, policy, contract))
        rows = small_rows(first, replay_limit, REPLAY_BYTES)
        if rows is None:
            learned = resolve_by_components(first)
        else:
            learned = replay([(r["canonical"], r["keys"], tuple(r["ord"]), r["at"]) for r in rows])
    together = learn_shared(events, known, policy, contract, replay_limit, REPLAY_BYTES) if contract.shared_forms else []
    if isinstance(learned, list):
        return learned + together
    more = alias_rows(events.sparkSession, [(a.canonical, a.raw_key, a.pos, a.at, None) for a in together])
    return learned.unionByName(more.drop("last_used_at"))
