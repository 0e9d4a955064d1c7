"""Keep the optimizer from evaluating expensive columns more than once.

Catalyst moves filters below projections and merges neighbouring projections, which repeats the
expression behind a column at every place the column is used.  That is right for cheap expressions
and ruinous for parsed documents and per-row lookups.  Generator output cannot be moved, so passing
finished columns through a generator of exactly one row pins them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def fenced(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add or replace columns, given as SQL expressions, that are computed once per row."""
    keep = [f"`{c}`" for c in df.columns if c not in columns]
    ready = df.selectExpr(*keep, *[f"{e} as `__{name}`" for name, e in columns.items()])
    pinned = ", ".join(f"'{name}', `__{name}`" for name in columns)
    return ready.selectExpr(*keep, f"inline(array(named_struct({pinned})))")
