"""String helpers as SQL expressions (all JVM-side)."""

from __future__ import annotations

import re

# Character classes and fallbacks.
NON_ALNUM = "[^A-Za-z0-9]+"
SAFE_KEY = r"^[A-Za-z_][A-Za-z0-9_]*\z"
IRI_SAFE = "[A-Za-z0-9._-]"
IRI_UNSAFE = "[^A-Za-z0-9._-]+"
UNKNOWN = "unknown"


def lit(text: str | None) -> str:
    """A string as a SQL literal."""
    if text is None:
        return "cast(null as string)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def names(items: list[str] | tuple[str, ...]) -> str:
    """Strings as a list of SQL literals."""
    return ", ".join(lit(i) for i in items)


def string_array(items: list[str] | tuple[str, ...] = ()) -> str:
    return f"cast(array({names(items)}) as array<string>)"


def normalized(text: str) -> str:
    """Driver-side twin of :func:`normalize_key`, for contract metadata."""
    return re.sub(NON_ALNUM, "", text).lower()


def normalize_key(key: str) -> str:
    """Keep ASCII letters and digits, lower-case."""
    return f"lower(regexp_replace({key}, {lit(NON_ALNUM)}, ''))"


def is_safe_key(key: str) -> str:
    """Keys the healed view may read: plain identifiers."""
    return f"({key} rlike {lit(SAFE_KEY)})"


def iri_part(text: str) -> str:
    """Keep the characters that are safe in an IRI; ``unknown`` if none is left."""
    # whether any is left shows at the first of them, so the text is gone through once
    return f"case when {text} rlike {lit(IRI_SAFE)} then regexp_replace({text}, {lit(IRI_UNSAFE)}, '') when {text} is not null then {lit(UNKNOWN)} end"


def escape_literal(text: str) -> str:
    """Escape backslash, double quote, line feed and carriage return."""
    out = text
    for char, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = f"replace({out}, {lit(char)}, {lit(escaped)})"
    return out


def file_stem(file_name: str) -> str:
    """File name without its last suffix; a leading dot does not start a suffix."""
    stem = f"regexp_extract({file_name}, {lit(r'^(.+?)([.][^.]*)?$')}, 1)"
    return f"coalesce(nullif({stem}, ''), {lit(UNKNOWN)})"


def event_key(event_id: str, fallback_id: str) -> str:
    return f"coalesce({event_id}, {fallback_id})"


def timestamp_text(ts: str) -> str:
    return f"cast({ts} as string)"


def wrap_total(total: str, modulus: int) -> str:
    return f"pmod({total}, {modulus})"
