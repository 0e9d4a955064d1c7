"""The healed view: canonical columns over the raw log, widened by every learned alias.

The view is evaluated at read time, so an alias learned today also repairs rows stored before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractflow.contract import Contract, default_contract
from contractflow.functions.json import json_string, rounded_bigint
from contractflow.functions.text import is_safe_key, lit
from contractflow.operators.bounded import is_small, lookup_join
from contractflow.operators.extract import entry_rows, positions, slot, with_places
from contractflow.operators.fence import fenced
from contractflow.operators.parse import parse_events
from contractflow.operators.registry import Aliases

VIEW_NAME = "streaming_events"
VIEW_PREFIX = ("id", "source", "received_at")


def _safe(key: str) -> bool:
    return key.isascii() and not key[:1].isdigit() and key.replace("_", "a").isalnum()


def _typed(text: str, view_type: str) -> str:
    return rounded_bigint(text) if view_type == "bigint" else text


def coalesce_aliases(keys: list[str], as_bigint: bool = False, payload: str = "payload") -> str:
    """First non-null member of a canonical payload among the usable keys, in order.

    This reads the payload text once per key; :func:`healed_view` works on parsed slots instead.
    """
    view_type = "bigint" if as_bigint else "string"
    texts = [_typed(json_string(payload, k), view_type) for k in keys if _safe(k)]
    return f"coalesce({', '.join(texts)})" if texts else f"cast(null as {view_type})"


def _first_value(field: str, view_type: str, known: str) -> str:
    """Value of the earliest known key that has one, nested values as JSON text."""
    others = slot(field, "others")
    entry = f"named_struct('pos', try_element_at({known}, o.key), 'value', {_typed('o.text', view_type)})"
    usable = f"filter(transform({others}, o -> {entry}), v -> v.pos is not null and v.value is not null)"
    return f"if(size({others}) > 0, array_min({usable}).value, null)"


def _first_known(field: str, view_type: str) -> str:
    """The same from entries that carry the position of their key."""
    entry = f"named_struct('pos', a.pos, 'value', {_typed('a.text', view_type)})"
    usable = f"filter(transform(`__at_{field}`, a -> {entry}), v -> v.pos is not null and v.value is not null)"
    return f"array_min({usable}).value"


def healed_view(
    raw: DataFrame,
    aliases: Aliases,
    contract: Contract | None = None,
    safe_keys_only: bool = True,
    name: str | None = None,
) -> DataFrame:
    """Canonical columns of every stored event under the whole registry.

    ``raw`` carries ``id, source, received_at`` and either ``slots`` or ``payload``.  Keys that are
    no plain identifiers are not read unless ``safe_keys_only`` is off.  With ``name`` the view is
    also registered for SQL.
    """
    contract = contract or default_contract()
    if "slots" not in raw.columns:
        raw = parse_events(raw, contract)
    if isinstance(aliases, list):
        used = [a for a in aliases if not safe_keys_only or _safe(a.raw_key)]
        hits = {f.name: _first_value(f.name, f.view_type, positions(used, f.name)) for f in contract.fields}
    elif is_small(aliases):
        raw = with_places(raw, aliases.where(is_safe_key("raw_key")) if safe_keys_only else aliases, contract, False)
        hits = {f.name: _first_known(f.name, f.view_type) for f in contract.fields}
    else:
        raw = _view_joined(raw, aliases, contract, safe_keys_only)
        hits = {f.name: f"__hit.`{f.name}`.value" for f in contract.fields}
    prefix = [c for c in VIEW_PREFIX if c in raw.columns]
    columns = {
        f.view_column: f"coalesce({_typed(slot(f.name, 'text'), f.view_type)}, {hits[f.name]})" for f in contract.fields
    }
    view = fenced(raw, columns).select(*prefix, *columns)
    if name:
        view.createOrReplaceTempView(name)
    return view


def _view_joined(raw: DataFrame, registry: DataFrame, contract: Contract, safe_keys_only: bool) -> DataFrame:
    """Hits through a join, for registries too large to be sent to every task.  ``id`` identifies the row."""
    known = registry.selectExpr("canonical", "raw_key", "learned_pos as pos")
    if safe_keys_only:
        known = known.where(is_safe_key("raw_key"))
    keyed = raw.selectExpr("id", f"inline({entry_rows(contract)})")
    found = lookup_join(keyed, known, ["canonical", "raw_key"], "inner")
    parts = []
    for f in contract.fields:
        value = _typed("text", f.view_type)
        parts.append(
            f"{lit(f.name)}, min(if(canonical = {lit(f.name)} and {value} is not null, "
            f"named_struct('pos', pos, 'value', {value}), null))"
        )
    hits = found.groupBy("id").agg(F.expr(f"named_struct({', '.join(parts)}) as __hit"))
    return raw.join(hits, "id", "left")


def lookup_event(view: DataFrame, event_id: str) -> DataFrame:
    """At most one row of the view with this event id."""
    return view.where(F.col("event_id") == event_id).limit(1)
