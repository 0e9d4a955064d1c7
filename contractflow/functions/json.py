"""JSON payload functions.

A payload is parsed exactly once, into a VARIANT.  To get *strict* validity out of the same parse
(Spark's parser stops at the end of the first value and ignores what follows), the payload is
placed in an array next to a hash of itself: ``[<payload>,"<hash>"]``.  Trailing text, several
values, an early closing bracket or an empty payload all leave something else than that hash in
the second place.

Duplicate keys resolve to the last one; that needs the session option set by
:func:`enable_duplicate_keys`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from contractflow.functions.text import lit, names

# Variant kinds that are scalars and whose text is already canonical.
SIMPLE_KINDS = ("STRING", "BOOLEAN", "BIGINT")


def enable_duplicate_keys(spark: SparkSession) -> None:
    """Duplicate object keys: keep the last one instead of failing the parse."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parsed(payload: str) -> str:
    """Array of zero or one variant ``[payload, hash]``; empty when the payload is not strict JSON."""
    tag = f"cast(xxhash64({payload}) as string)"
    doc = f"""try_parse_json(concat('[', {payload}, ',"', {tag}, '"]'))"""
    return f"filter(array({doc}), d -> try_variant_get(d, '$[1]', 'string') = {tag})"


def is_valid_json(payload: str) -> str:
    """Exactly one JSON value and nothing after it."""
    return f"coalesce(size({parsed(payload)}) > 0, false)"


def canonical_text(doc: str) -> str:
    """Compact text with sorted keys."""
    return f"to_json(try_variant_get({doc}, '$[0]', 'variant'))"


def canonical_json(payload: str) -> str:
    """Canonical text straight from a payload; null when it is not strict JSON."""
    return f"try_element_at(transform({parsed(payload)}, v -> {canonical_text('v')}), 1)"


def selected_members(doc: str, keys: list[str]) -> str:
    """Some top-level members as a struct of variants, in one pass; null unless an object."""
    inner = ",".join(f"`{k}`:variant" for k in keys)
    return f"try_variant_get({doc}, '$[0]', {lit(f'struct<{inner}>')})"


def members(doc: str) -> str:
    """All top-level members as ``array<struct<key, value variant>>``; null unless an object."""
    return f"map_entries(try_variant_get({doc}, '$[0]', 'map<string,variant>'))"


def object_keys(payload: str) -> str:
    """Top-level keys of canonical payload text."""
    return f"json_object_keys({payload})"


def plain_scalar(value: str) -> str:
    """Text of a string, boolean or integer variant, otherwise null."""
    text = f"cast({value} as string)"
    # only these first characters leave the kind open: numbers, objects, arrays
    return (
        f"case when left({text}, 1) not in ({names(tuple('-0123456789{['))}) then {text} "
        f"when schema_of_variant({value}) in ({names(SIMPLE_KINDS)}) then {text} end"
    )


def is_scalar(value: str) -> str:
    kind = f"schema_of_variant({value})"
    return f"({kind} in ({names(SIMPLE_KINDS)}, 'DOUBLE') or startswith({kind}, 'DECIMAL'))"


def scalar_text(value: str) -> str:
    """Text of any scalar variant; null for null, object and array."""
    kind = f"schema_of_variant({value})"
    # whole numbers of the unsigned 64-bit range keep their digits, larger ones become doubles
    wide = (
        f"startswith({kind}, 'DECIMAL(2') and endswith({kind}, ',0)') "
        f"and abs(cast({value} as decimal(38,0))) < 18446744073709551616"
    )
    return (
        f"case when {kind} in ({names(SIMPLE_KINDS)}) then cast({value} as string) "
        f"when {wide} then cast({value} as string) "
        f"when {is_scalar(value)} then {float_text(f'cast({value} as double)')} end"
    )


def member_text(value: str) -> str:
    """Scalar text, JSON text of an object or array, null for JSON null."""
    return f"coalesce({scalar_text(value)}, if(schema_of_variant({value}) <> 'VOID', to_json({value}), null))"


def float_text(value: str) -> str:
    """Shortest text of a double: plain notation from 1e-5 up to 1e16, otherwise ``d.ddde<n>``."""
    text = f"cast(abs({value}) as string)"
    mantissa = f"substring_index({text}, 'E', 1)"
    exponent = f"coalesce(cast(nullif(regexp_extract({text}, 'E(-?[0-9]+)$', 1), '') as int), 0)"
    whole = f"substring_index({mantissa}, '.', 1)"
    raw = f"concat({whole}, substring_index({mantissa}, '.', -1))"
    bare = f"regexp_replace({raw}, '^0+', '')"
    # d: significant digits, p: how many of them stand before the decimal point
    parts = (
        f"array(named_struct('d', regexp_replace({bare}, '0+$', ''), "
        f"'p', length({whole}) + {exponent} - length({raw}) + length({bare})))"
    )
    shown = (
        "case when x.d = '' then '0.0' "
        "when x.p > 0 and x.p <= 16 and length(x.d) <= x.p then concat(x.d, repeat('0', x.p - length(x.d)), '.0') "
        "when x.p > 0 and x.p <= 16 then concat(left(x.d, x.p), '.', substring(x.d, x.p + 1)) "
        "when x.p > -5 and x.p <= 0 then concat('0.', repeat('0', -x.p), x.d) "
        "else concat(left(x.d, 1), if(length(x.d) > 1, concat('.', substring(x.d, 2)), ''), 'e', x.p - 1) end"
    )
    return f"concat(if({value} < 0, '-', ''), transform({parts}, x -> {shown})[0])"


def json_string(payload: str, key: str) -> str:
    """Text of one top-level member of canonical payload text (nested values as JSON text).

    JSON paths cannot quote an apostrophe, so keys with one are refused.
    """
    if "'" in key:
        raise ValueError(f"key {key!r} cannot be written as a JSON path")
    path = f"$['{key}']"
    return f"get_json_object({payload}, {lit(path)})"


def rounded_bigint(text: str) -> str:
    """Text to BIGINT with decimals rounded half away from zero; null when not a number.

    The first decimal alone decides, so the others of a number without exponent are dropped before
    the cast, which would round them.
    """
    short = f"regexp_replace({text}, '^( *[+-]?[0-9]*[.][0-9])[0-9]+( *)$', '$1$2')"
    return f"try_cast(round(try_cast({short} as decimal(38,18)), 0) as bigint)"
