"""Contract checks in row form: one event is one row, a linked node is a field of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractflow.contract import Constraint, Contract
from contractflow.functions.text import lit
from contractflow.operators.bounded import BROADCAST_LIMIT, is_small, lookup_join
from contractflow.storage import cut_lineage

# Lexical forms of the contract datatypes.  Month lengths are part of the pattern,
# only the 29th of February needs the year.
DATETIME_RE = (
    r"^-?([1-9][0-9]{3,}|0[0-9]{3})-"
    r"((0[13578]|1[02])-(0[1-9]|[12][0-9]|3[01])|(0[469]|11)-(0[1-9]|[12][0-9]|30)|02-(0[1-9]|[12][0-9]))"
    r"T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)"
    r"(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?\z"
)
NONNEG_RE = r"^(\+?[0-9]+|-0+)\z"

VIOLATION_TYPE = "array<struct<shape:string,path:string,constraint:string,value:string>>"

# SQL expression of a field's text
ValueOf = Callable[[str], str]

NOTHING = "cast(null as string)"


def is_datetime(text: str) -> str:
    """Lexically an xsd:dateTime, with a day that exists in its month."""
    # the last four digits decide about leap years
    year = f"cast(right(regexp_extract({text}, '([0-9]+)-02-29T', 1), 4) as int)"
    leap = f"({year} % 4 = 0 and ({year} % 100 <> 0 or {year} % 400 = 0))"
    return f"case when not ({text} rlike {lit(DATETIME_RE)}) then false when contains({text}, '-02-29T') then {leap} else true end"


def is_non_negative_integer(text: str) -> str:
    return f"({text} rlike {lit(NONNEG_RE)})"


def datatype_holds(text: str, datatype: str) -> str:
    if datatype == "dateTime":
        return is_datetime(text)
    if datatype == "nonNegativeInteger":
        return is_non_negative_integer(text)
    return "true"


def constraint_fails(c: Constraint, value: str) -> str:
    """Whether a single-valued path breaks a constraint; never null."""
    if c.constraint == "minCount":
        return f"({value} is null)" if int(c.value) == 1 else str(int(c.value) > 1).lower()
    if c.constraint == "maxCount":
        return "false" if int(c.value) >= 1 else f"({value} is not null)"
    if c.constraint == "minLength":
        return f"coalesce(char_length({value}) < {int(c.value)}, false)"
    if c.constraint == "datatype":
        return "false" if c.value == "string" else f"coalesce(not {datatype_holds(value, c.value)}, false)"
    raise ValueError(f"{c.constraint} is not a value constraint")


def _any(tests: list[str]) -> str:
    return "(" + " or ".join(tests or ["false"]) + ")"


def _entries(contract: Contract, value_of: ValueOf) -> list[tuple[Constraint, str, str]]:
    """(constraint, failed, offending value) for the root shape and every linked shape."""
    fields = {(f.node_class, f.path): f.name for f in contract.fields}
    links = {f.link_path: f for f in contract.fields if f.link_path}

    def at(node_class: str, path: str) -> str:
        name = fields.get((node_class, path))
        return value_of(name) if name else NOTHING

    out: list[tuple[Constraint, str, str]] = []
    for c in contract.constraints:
        if c.target_class != contract.root_class:
            # shapes of linked nodes apply where the node exists
            owner = next((f.name for f in contract.fields if f.node_class == c.target_class), None)
            value = at(c.target_class, c.path)
            exists = f"{value_of(owner)} is not null" if owner else "false"
            out.append((c, f"({exists} and {constraint_fails(c, value)})", value))
        elif c.path not in links:
            value = at(c.target_class, c.path)
            out.append((c, constraint_fails(c, value), value))
        else:
            linked = links[c.path]
            value = value_of(linked.name)
            if c.constraint == "class":
                # a linked node is always built with the class of its field
                failed = "false" if c.value == linked.node_class else f"({value} is not null)"
            elif c.constraint == "node":
                inner = [constraint_fails(i, at(linked.node_class, i.path)) for i in contract.of(c.value)]
                failed = f"({value} is not null and {_any(inner)})"
            else:
                failed = constraint_fails(c, value)
            out.append((c, failed, value))
    return [(c, failed, value) for c, failed, value in out if failed != "false"]


def conforms(contract: Contract, value_of: ValueOf) -> str:
    """All constraints hold."""
    return f"not {_any([failed for _, failed, _ in _entries(contract, value_of)])}"


def violation_list(contract: Contract, value_of: ValueOf) -> str:
    """Array of the constraints that fail."""
    found = [
        f"if({failed}, named_struct('shape', {lit(c.shape)}, 'path', {lit(c.path)}, "
        f"'constraint', {lit(c.constraint)}, 'value', cast({value} as string)), null)"
        for c, failed, value in _entries(contract, value_of)
    ]
    return f"cast(array_compact(array({', '.join(found)})) as {VIOLATION_TYPE})"


def columns_as_values(mapping: dict[str, str]) -> ValueOf:
    """Read fields from plain table columns."""
    return lambda field: f"cast(`{mapping[field]}` as string)"


def values_in(column: str = "values") -> ValueOf:
    """Read fields from a struct column with one member per field."""
    return lambda field: f"`{column}`.`{field}`"


def validate(df: DataFrame, contract: Contract, value_of: ValueOf) -> DataFrame:
    """Add ``conforms``."""
    return df.selectExpr("*", f"{conforms(contract, value_of)} as conforms")


def violations(df: DataFrame, contract: Contract, value_of: ValueOf, keep: list[str]) -> DataFrame:
    """Report: one row per failed constraint with the ``keep`` columns of its row."""
    return df.selectExpr(*keep, f"inline({violation_list(contract, value_of)})")


def reference_violations(
    df: DataFrame, key: str, parent: DataFrame, parent_key: str, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Rows whose reference points to no row of ``parent`` (null references do not count).

    Parent keys are broadcast while they are few.  Beyond that the distinct dangling keys are found
    first, so that no hot key meets the parent table, and then their rows.
    """
    keys = parent.select(F.col(parent_key).alias(key)).where(F.col(key).isNotNull())
    rows = df.where(F.col(key).isNotNull())
    if is_small(keys, limit):
        return rows.join(F.broadcast(keys), key, "left_anti")
    dangling = cut_lineage(rows.select(key).distinct().join(keys, key, "left_anti"))
    return lookup_join(rows, dangling, [key], "left_semi", limit=limit)
