"""Find renamed keys for missing required fields."""

from __future__ import annotations

from pyspark.sql import DataFrame

from contractflow.contract import Contract
from contractflow.functions.text import lit
from contractflow.operators.extract import resolved_key, resolved_text, slot, with_hits
from contractflow.operators.registry import Aliases

# Match outcomes.
NONE, UNIQUE, AMBIGUOUS = "none", "unique", "ambiguous"

CANDIDATE_TYPE = "struct<canonical:string,outcome:string,raw_key:string,candidates:array<string>>"


def unclaimed(others: str, used: str) -> str:
    """Entries whose key is not claimed by another field."""
    return f"filter({others}, o -> not array_contains({used}, o.key))"


def agreeing(others: str) -> str:
    """One entry, or several with the same scalar text (where no scalar text counts as a text)."""
    return f"size(array_distinct(transform({others}, o -> if(o.scalar, o.text, null)))) = 1"


def alias_match(canonical: str, others: str, literal: bool = True) -> str:
    """Match a missing field against the event's keys of the same normal form, which are sorted.

    One key is taken without a look at its value, several (the first one) only if they agree.  ``canonical`` is
    the field's name, or with ``literal`` off an expression for it.
    """
    found = f"coalesce(size({others}), 0)"
    outcome = f"case when {found} <= 0 then '{NONE}' when {agreeing(others)} then '{UNIQUE}' else '{AMBIGUOUS}' end"
    raw_key = f"if({found} > 0 and {agreeing(others)}, {others}[0].key, null)"
    keys = f"coalesce(transform({others}, o -> o.key), array())"
    return (
        f"cast(named_struct('canonical', {lit(canonical) if literal else canonical}, 'outcome', {outcome}, 'raw_key', {raw_key}, "
        f"'candidates', {keys}) as {CANDIDATE_TYPE})"
    )


def missing_matches(contract: Contract, moment: str = "before") -> str:
    """Array of struct<canonical, outcome, raw_key, candidates>, one per missing required field."""
    if contract.shared_forms:
        return _matches_in_turn(contract, moment)
    parts = [
        f"if({resolved_text(n, moment)} is null, array({alias_match(n, slot(n, 'others'))}), "
        f"cast(array() as array<{CANDIDATE_TYPE}>))"
        for n in contract.required
    ]
    return f"concat({', '.join(parts)})"


def _matches_in_turn(contract: Contract, moment: str) -> str:
    """The same where fields share a normal form: field by field, in the order of the contract.

    A key that has resolved a field, or that an earlier field of the pass has matched, is claimed and no
    candidate of the fields after it, whatever the policy then says about the match.
    """
    among = [n for fields in contract.shared_forms.values() for n in fields]
    claimed = f"array_compact(array({', '.join(resolved_key(n, moment) for n in among)}))"
    turns = ", ".join(
        f"named_struct('canonical', {lit(n)}, 'missing', {resolved_text(n, moment)} is null, 'others', {slot(n, 'others')})"
        for n in contract.required
    )
    start = f"named_struct('used', cast({claimed} as array<string>), 'found', cast(array() as array<{CANDIDATE_TYPE}>))"
    # what is left of a field's keys, and the match, are bound to names by transforms over one element
    left = unclaimed("f.others", "s.used")
    match = f"transform(array({left}), w -> {alias_match('f.canonical', 'w', literal=False)})"
    taken = (
        f"transform({match}, m -> named_struct('used', if(m.raw_key is null, s.used, array_append(s.used, m.raw_key)), "
        "'found', array_append(s.found, m)))[0]"
    )
    return f"aggregate(array({turns}), {start}, (s, f) -> if(f.missing, {taken}, s), s -> s.found)"


def rename_candidates(
    events: DataFrame, aliases: Aliases, contract: Contract, timeless: bool = True
) -> DataFrame:
    """One row per event and missing required field: ``canonical, outcome, raw_key, candidates``."""
    keep = [f"`{c}`" for c in events.columns if c != "slots"]
    return with_hits(events, aliases, contract, timeless).selectExpr(*keep, f"inline({missing_matches(contract)})")


def event_keys(events: DataFrame, contract: Contract) -> DataFrame:
    """Exploded keys of the event's slots: ``canonical, raw_key, text, scalar``."""
    rows = [
        f"if({slot(n, 'text')} is not null, "
        f"array(named_struct('canonical', {lit(n)}, 'raw_key', {lit(n)}, 'text', {slot(n, 'text')}, 'scalar', true)), "
        f"transform(coalesce({slot(n, 'others')}, array()), "
        f"o -> named_struct('canonical', {lit(n)}, 'raw_key', o.key, 'text', o.text, 'scalar', o.scalar)))"
        for n in contract.names
    ]
    keep = [f"`{c}`" for c in events.columns if c != "slots"]
    return events.selectExpr(*keep, f"inline(flatten(array({', '.join(rows)})))")
