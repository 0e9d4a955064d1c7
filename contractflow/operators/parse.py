"""Parse payloads once and keep the part of them the contract can ever look at.

``slots`` has one entry per canonical field::

    slots.<field>.text    scalar text under the canonical name itself
    slots.<field>.others  only if text is null: every key with the field's normal form, sorted,
                          as struct<key, text, scalar>; text of nested values is JSON text

A canonical scalar always wins, and every other spelling that can matter shares the field's
normal form, so extraction, discovery, validation and the healed view all work on ``slots`` and
never parse the payload again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from contractflow.contract import Contract
from contractflow.functions import json as J
from contractflow.functions.text import lit, normalize_key, string_array
from contractflow.operators.fence import fenced

OTHERS_TYPE = "array<struct<key:string,text:string,scalar:boolean>>"


def slots_type(contract: Contract) -> str:
    inner = ",".join(f"`{n}`:struct<text:string,others:{OTHERS_TYPE}>" for n in contract.names)
    return f"struct<{inner}>"


def _hits(doc: str, wanted: str) -> str:
    """Members whose normal form is wanted: struct<norm, key, text, scalar>."""
    named = (
        f"transform({J.members(doc)}, "
        f"m -> named_struct('norm', {normalize_key('m.key')}, 'key', m.key, 'value', m.value))"
    )
    return (
        f"transform(filter({named}, m -> array_contains({wanted}, m.norm)), m -> named_struct("
        f"'norm', m.norm, 'key', m.key, 'text', {J.member_text('m.value')}, 'scalar', {J.is_scalar('m.value')}))"
    )


def _slot(name: str, norm: str) -> str:
    text = f"__direct.`{name}`"
    others = (
        f"sort_array(transform(filter(__hits, h -> h.norm = {lit(norm)}), "
        "h -> named_struct('key', h.key, 'text', h.text, 'scalar', h.scalar)))"
    )
    return f"named_struct('text', {text}, 'others', cast(if({text} is null, {others}, null) as {OTHERS_TYPE}))"


def parse_events(events: DataFrame, contract: Contract, keep_malformed: bool = False) -> DataFrame:
    """Canonicalise ``payload`` and add ``slots``.

    Malformed payloads are dropped, or kept verbatim with null slots and ``malformed = true``.
    """
    J.enable_duplicate_keys(events.sparkSession)
    explode = "explode_outer" if keep_malformed else "explode"
    keep = [c for c in events.columns if c != "payload"]
    # the generator both parses and drops, so no filter can be pushed below it and parse twice
    docs = events.selectExpr("*", f"{explode}({J.parsed('payload')}) as __doc")
    picked = docs.selectExpr("*", f"{J.selected_members('__doc', contract.names)} as __picked")
    texts = ", ".join(f"{lit(n)}, {J.plain_scalar(f'__picked.`{n}`')}" for n in contract.names)
    direct = picked.selectExpr("*", f"if(__picked is not null, named_struct({texts}), null) as __direct")
    # normal forms of the fields that need a look at the other keys; none for most events
    missing = ", ".join(
        f"if(__direct.`{n}` is null, {string_array([norm])}, {string_array()})"
        for n, norm in contract.normal_forms.items()
    )
    wanted = direct.selectExpr("*", f"if(__picked is not null, concat({missing}), null) as __wanted")
    hits = wanted.selectExpr("*", f"if(size(__wanted) > 0, {_hits('__doc', '__wanted')}, null) as __hits")
    slots = ", ".join(f"{lit(n)}, {_slot(n, norm)}" for n, norm in contract.normal_forms.items())
    text = J.canonical_text("__doc")
    out = {"payload": text, "slots": f"if(__doc is not null, named_struct({slots}), null)"}
    if keep_malformed:
        out |= {"payload": f"coalesce({text}, payload)", "malformed": "__doc is null"}
    return fenced(hits, out).select(*keep, *out)


def split_malformed(events: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Well-formed events with slots, and the quarantined rest with its text untouched."""
    return parse_events(events, contract), events.where(f"not {J.is_valid_json('payload')}")
