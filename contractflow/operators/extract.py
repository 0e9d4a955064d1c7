"""Alias-aware extraction of the canonical fields from ``slots``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractflow.contract import Contract
from contractflow.functions.text import lit, string_array
from contractflow.operators.bounded import is_small, lookup_join
from contractflow.operators.fence import fenced
from contractflow.operators.registry import Alias, Aliases, position_sql
from contractflow.sources.identity import ORD_TYPE
from contractflow.storage import ship_package

POSITION = pa.struct([("batch", pa.int64()), ("session", pa.int64()), ("seq", pa.int64()), ("tie", pa.string())])


def slot(field: str, part: str) -> str:
    """``text`` or ``others`` of a field's slot."""
    return f"slots.`{field}`.{part}"


def positions(aliases: list[Alias], field: str) -> str:
    """Literal map of a field's raw keys to the positions they were learned at."""
    pairs = [f"{lit(a.raw_key)}, {position_sql(a.pos)}" for a in aliases if a.canonical == field]
    return f"map({', '.join(pairs)})" if pairs else f"cast(map() as map<string,{ORD_TYPE}>)"


def entry_rows(contract: Contract, condition: str = "true") -> str:
    """All ``others`` entries of an event as array<struct<canonical, raw_key, text>>."""
    per_field = [
        f"coalesce(transform(filter({slot(n, 'others')}, o -> {condition}), "
        f"o -> named_struct('canonical', {lit(n)}, 'raw_key', o.key, 'text', o.text)), array())"
        for n in contract.names
    ]
    return f"flatten(array({', '.join(per_field)}))"


def with_places(events: DataFrame, registry: DataFrame, contract: Contract, scalars_only: bool = True) -> DataFrame:
    """Add ``__at_<field>``: the field's ``others`` as array<struct<pos, key, text>> with the position each key was learned at.

    The registry, checked to be small, goes to every worker as one lookup table; only the keys of events that lack a
    canonical one are looked up there, and events do not move.  The position is null for unknown keys and, unless
    ``scalars_only`` is off, for values that are no scalars.
    """
    ship_package(events.sparkSession)
    table: dict[str, dict[str, dict]] = {n: {} for n in contract.names}
    for r in registry.select("canonical", "raw_key", "learned_pos").collect():
        table.setdefault(r["canonical"], {})[r["raw_key"]] = r["learned_pos"].asDict()
    sent = events.sparkSession.sparkContext.broadcast(table)

    def found(field: str) -> Column:
        @F.arrow_udf(f"array<{ORD_TYPE}>")
        def look_up(keys: pa.Array) -> pa.Array:
            known = sent.value[field]
            return pa.array([None if k is None else [known.get(x) for x in k] for k in keys.to_pylist()], pa.list_(POSITION))

        others = F.col(slot(field, "others"))
        return look_up(F.when(F.size(others) > 0, F.transform(others, lambda o: o["key"])))

    columns = events.columns
    looked_up = events.withColumns({f"__pos_{n}": found(n) for n in contract.names})
    placed = []
    for n in contract.names:
        pos = f"get(`__pos_{n}`, i)"
        pos = f"if(o.scalar, {pos}, null)" if scalars_only else pos
        placed.append(f"transform({slot(n, 'others')}, (o, i) -> named_struct('pos', {pos}, 'key', o.key, 'text', o.text)) as `__at_{n}`")
    return looked_up.selectExpr(*[f"`{c}`" for c in columns], *placed)


def with_hits(events: DataFrame, aliases: Aliases, contract: Contract, timeless: bool = False) -> DataFrame:
    """Add ``hits.<field>.before`` and ``.after``: the alias that resolves a field whose canonical
    key is no plain scalar, as known just before the event and right after its own lesson.

    With ``timeless`` every alias counts for every event and ``ord`` is not needed.  Events do not move for this unless
    the registry is too large to be sent to every task.
    """
    if isinstance(aliases, list):
        placed = events.selectExpr("*", *[_placed_inline(n, aliases) for n in contract.names])
    elif is_small(aliases):
        placed = with_places(events, aliases, contract)
    else:
        return _hits_joined(events, aliases, contract, timeless)

    def hit(field: str) -> str:
        parts = [
            f"'{moment}', array_min(filter(`__at_{field}`, a -> {test}))"
            for moment, test in _moments(timeless, "a.pos").items()
        ]
        return f"{lit(field)}, named_struct({', '.join(parts)})"

    hits = f"named_struct({', '.join(hit(n) for n in contract.names)})"
    return fenced(placed, {"hits": hits}).select(*events.columns, "hits")


def _moments(timeless: bool, pos: str) -> dict[str, str]:
    if timeless:
        return {"before": f"{pos} is not null", "after": f"{pos} is not null"}
    return {"before": f"{pos} < ord", "after": f"{pos} <= ord"}


def _placed_inline(field: str, aliases: list[Alias]) -> str:
    others, known = slot(field, "others"), positions(aliases, field)
    entry = f"named_struct('pos', if(o.scalar, try_element_at({known}, o.key), null), 'key', o.key, 'text', o.text)"
    return f"if(size({others}) > 0, transform({others}, o -> {entry}), null) as `__at_{field}`"


def _hits_joined(events: DataFrame, registry: DataFrame, contract: Contract, timeless: bool) -> DataFrame:
    """The same through a join, for registries too large to be sent to every task.

    Positions repeat when a broker reconnects, so an event is found again by its position and what it
    holds.  Events that agree in both have the same hits.
    """
    events = events.withColumn("__held", F.expr("sha2(to_json(slots), 256)"))
    keyed = events.selectExpr("ord", "__held", f"inline({entry_rows(contract, 'o.scalar')})")
    known = registry.selectExpr("canonical", "raw_key", "learned_pos as pos")
    found = lookup_join(keyed, known, ["canonical", "raw_key"], "inner")
    aggs = []
    for n in contract.names:
        parts = [
            f"'{moment}', min(if(canonical = {lit(n)} and {test}, named_struct('pos', pos, 'key', raw_key, 'text', text), null))"
            for moment, test in _moments(timeless, "pos").items()
        ]
        aggs.append(f"{lit(n)}, named_struct({', '.join(parts)})")
    hits = found.groupBy("ord", "__held").agg(F.expr(f"named_struct({', '.join(aggs)}) as hits"))
    return events.join(hits, ["ord", "__held"], "left").drop("__held")


def resolved_text(field: str, moment: str = "after") -> str:
    return f"coalesce({slot(field, 'text')}, hits.`{field}`.{moment}.text)"


def resolved_key(field: str, moment: str = "after") -> str:
    return f"if({slot(field, 'text')} is not null, {lit(field)}, hits.`{field}`.{moment}.key)"


def values_struct(contract: Contract) -> str:
    return f"named_struct({', '.join(f'{lit(n)}, {resolved_text(n)}' for n in contract.names)})"


def via_struct(contract: Contract) -> str:
    return f"named_struct({', '.join(f'{lit(n)}, {resolved_key(n)}' for n in contract.names)})"


def any_missing(contract: Contract, moment: str = "after") -> str:
    return "(" + " or ".join(f"{resolved_text(n, moment)} is null" for n in contract.required) + ")"


def missing_fields(contract: Contract, moment: str = "after") -> str:
    """Required fields without a value, in contract order."""
    parts = [
        f"if({resolved_text(n, moment)} is null, {string_array([n])}, {string_array()})" for n in contract.required
    ]
    return f"concat({', '.join(parts)})"


def _present(struct: str, contract: Contract) -> str:
    """A struct of fields as a map of those that are not null."""
    entries = ", ".join(f"named_struct('key', {lit(n)}, 'value', {struct}.`{n}`)" for n in contract.names)
    return f"map_from_entries(filter(array({entries}), e -> e.value is not null))"


def extract_canonical(events: DataFrame, aliases: Aliases, contract: Contract, timeless: bool = True) -> DataFrame:
    """Add ``values``, ``resolved_via``, ``used_raw_keys`` and ``missing_required``.

    The canonical name is tried first, then aliases in the order they were learned; only scalar
    values count.
    """
    columns = events.columns
    found = with_hits(events, aliases, contract, timeless).selectExpr(
        *[f"`{c}`" for c in columns],
        f"{values_struct(contract)} as __values",
        f"{via_struct(contract)} as __via",
        f"{missing_fields(contract)} as missing_required",
    )
    maps = found.selectExpr(
        *[f"`{c}`" for c in columns],
        f"{_present('__values', contract)} as values",
        f"{_present('__via', contract)} as resolved_via",
        "missing_required",
    )
    return maps.selectExpr("*", "map_values(resolved_via) as used_raw_keys")
