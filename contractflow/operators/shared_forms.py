"""Learning where fields of a contract share a normal form.

A renamed key suits all fields of its form, and what one of them resolves through, or has matched in the same
pass, is claimed for the others.  So what an event can teach depends on what all these fields know by then, and an
event that taught nothing may have a copy that teaches, once another event has taught.

Events are reduced to their *shape* for one form: its keys, which of them hold scalars, which hold equal values,
and which fields the policy lets them teach.  Events of one shape are the same to the rules.  Spark keeps the first arrival
of every shape; the driver plays these arrivals in order, and when a lesson makes a shape that has passed
teach, it asks Spark for that shape's next arrival.  Only shapes come to the driver, at most ``limit`` at a time: a
span of the batch that holds more is halved.
"""

from __future__ import annotations

import heapq
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractflow.contract import Contract
from contractflow.functions.text import lit
from contractflow.operators.bounded import small_rows
from contractflow.operators.extract import slot
from contractflow.operators.policy import Policy, may_teach, with_trust
from contractflow.operators.registry import SEED_POS, Alias, Aliases, Position, position_key, position_sql
from contractflow.storage import cut_lineage

SHAPE = ["form", "keys", "allowed"]

# form, ((key, is scalar, place of the first key with an equal value), ...), whether each required field may learn
Shape = tuple[str, tuple[tuple[str, bool, int], ...], tuple[bool, ...]]


def shapes(events: DataFrame, policy: Policy | None, contract: Contract) -> DataFrame:
    """``form, keys, allowed, ord, at`` of the events in which a field of a shared form lacks its canonical key; stored."""
    rows = []
    for form, fields in contract.shared_forms.items():
        required = [n for n in fields if n in contract.required]
        keys = f"coalesce({', '.join(slot(n, 'others') for n in required)})"
        value = "if({0}.scalar, {0}.text, null)"
        same = f"coalesce(array_position(transform(k, x -> {value.format('x')}), {value.format('o')}), 0)"
        shaped = f"transform(array({keys}), k -> transform(k, o -> named_struct('key', o.key, 'scalar', o.scalar, 'same', {same})))[0]"
        allowed = f"array({', '.join(may_teach(policy, lit(n)) for n in required)})"
        rows.append(
            f"if(size({keys}) > 0 and array_contains({allowed}, true), named_struct('form', {lit(form)}, 'keys', {shaped}, 'allowed', {allowed}), null)"
        )
    slim = with_trust(events.select("ord", "received_at", "origin", "slots"), policy)
    return cut_lineage(slim.selectExpr("ord", "received_at as at", f"inline(array_compact(array({', '.join(rows)})))"))


class Known:
    """The aliases of the fields that share forms, in the order in which they are tried."""

    def __init__(self, aliases: Aliases, contract: Contract):
        self.required = {form: [n for n in fields if n in contract.required] for form, fields in contract.shared_forms.items()}
        self.fields = contract.shared_forms
        self.keys: dict[str, list[tuple]] = {n: [] for fields in self.fields.values() for n in fields}
        self.table = None if isinstance(aliases, list) else aliases.where(F.col("canonical").isin(*self.keys))
        self.asked: set[str] = set()
        if isinstance(aliases, list):
            for a in aliases:
                self.add(a.canonical, a.raw_key, a.pos)

    def add(self, field: str, key: str, pos: Position) -> None:
        if field in self.keys:
            self.keys[field].append((position_key(pos), key.encode(), key))
            self.keys[field].sort()

    def look_up(self, keys: set[str]) -> None:
        """Read what a large registry knows of these keys."""
        new = sorted(keys - self.asked)
        if self.table is None or not new:
            return
        self.asked.update(new)
        wanted = self.table.sparkSession.createDataFrame([(k,) for k in new], "raw_key string")
        for r in self.table.join(wanted, "raw_key", "left_semi").select("canonical", "raw_key", "learned_pos").collect():
            self.add(r["canonical"], r["raw_key"], tuple(r["learned_pos"] or SEED_POS))

    def lessons(self, shape: Shape) -> list[tuple[str, str]]:
        """The new pairs of field and key that an event of this shape teaches now."""
        form, keys, allowed = shape
        scalars = {k for k, scalar, _ in keys if scalar}
        via = {n: next((k for _, _, k in self.keys[n] if k in scalars), None) for n in self.fields[form]}
        used = {k for k in via.values() if k is not None}
        taught = []
        for field, may in zip(self.required[form], allowed):
            if via[field] is not None:
                continue
            left = [(k, same) for k, _, same in keys if k not in used]
            if left and len({same for _, same in left}) == 1:
                key = left[0][0]
                # claimed before the policy is asked, so a refused key stays claimed
                used.add(key)
                if may and all(k != key for _, _, k in self.keys[field]):
                    taught.append((field, key))
        return taught


def replay_span(table: DataFrame, rows: list, known: Known) -> list[Alias]:
    """Play a span of events; ``rows`` are the first arrivals of its shapes, ``table`` all arrivals."""
    known.look_up({k["key"] for r in rows for k in r["keys"]})
    learned: list[Alias] = []
    coming: list[tuple] = []
    passed: dict[str, dict[Shape, tuple]] = {}

    def push(r) -> None:
        shape = (r["form"], tuple(tuple(k) for k in r["keys"]), tuple(r["allowed"]))
        pos = tuple(r["ord"])
        heapq.heappush(coming, (position_key(pos), repr(shape), shape, pos, r["at"]))

    for r in rows:
        push(r)
    while coming:
        _, _, shape, pos, at = heapq.heappop(coming)
        taught = known.lessons(shape)
        for field, key in taught:
            known.add(field, key, pos)
            learned.append(Alias(field, key, pos, at))
        for key, _, _ in shape[1]:
            passed.setdefault(key, {})[shape] = pos
        touched = {s for _, key in taught for s in passed.get(key, ())}
        again = [s for s in touched if known.lessons(s)]
        if again:
            for s in again:
                for key, _, _ in s[1]:
                    del passed[key][s]
            for r in next_arrivals(table, again, pos):
                push(r)
    return learned


def next_arrivals(table: DataFrame, wanted: list[Shape], after: Position) -> list:
    schema = "form string, keys array<struct<key: string, scalar: boolean, same: bigint>>, allowed array<boolean>"
    side = table.sparkSession.createDataFrame([(f, [tuple(k) for k in keys], list(a)) for f, keys, a in wanted], schema)
    later = table.where(f"ord > {position_sql(after)}").join(F.broadcast(side), SHAPE, "left_semi")
    return first_arrivals(later).collect()


def first_arrivals(table: DataFrame) -> DataFrame:
    return table.groupBy(*SHAPE).agg(F.min(F.struct("ord", "at")).alias("a")).select(*SHAPE, "a.ord", "a.at")


def learn_shared(
    events: DataFrame, aliases: Aliases, policy: Policy | None, contract: Contract, limit: int, max_bytes: int
) -> list[Alias]:
    """Aliases of the fields that share a form, as one-by-one processing would learn them."""
    table = shapes(events, policy, contract)
    known, learned = Known(aliases, contract), []
    spans = [table]
    while spans:
        span = spans.pop()
        first = cut_lineage(first_arrivals(span))
        rows = small_rows(first, limit, max_bytes)
        cut = halves(span) if rows is None else None
        if cut:
            spans += reversed(cut)
        else:
            # shapes that arrive at one position cannot be halved
            learned += replay_span(span, first.collect() if rows is None else rows, known)
    return learned


def halves(span: DataFrame) -> list[DataFrame] | None:
    """The earlier and the later half of a span, by batch, session or number; None if all have one number."""
    for part in ("batch", "session", "seq"):
        ends = span.agg(F.min(f"ord.{part}").alias("low"), F.max(f"ord.{part}").alias("high")).first()
        if ends["low"] < ends["high"]:
            middle = (ends["low"] + ends["high"]) // 2
            return [span.where(f"ord.{part} <= {middle}"), span.where(f"ord.{part} > {middle}")]
    return None
