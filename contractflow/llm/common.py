"""Column expressions and helpers shared by the operators of this package."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows that one task numbers or looks up together.
ROWS_PER_TASK = 100_000
# At most this many keys are treated as hot, so a table of them is always small.
MAX_HOT_KEYS = 1000


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII texts take the JVM's fast path, which is the same for them."""
    only_ascii = F.length(text) == F.octet_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


# Columns by which a decision finds its document again: the id as text and a hash of the text.
KEY = ["__key_id", "__key_text"]


def with_key(docs: DataFrame) -> DataFrame:
    """Add the columns of KEY; rows that share both are copies, and decisions treat them alike."""
    return docs.withColumns(
        {KEY[0]: F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), KEY[1]: F.xxhash64(text_of())}
    )


def crc32_of_id(column: str = "doc_id") -> Column:
    """CRC-32 of the id as text; the id's split is taken from it.  A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def number_within(df: DataFrame, group: str, name: str, spread: Column, rows: int, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Number the rows of every group from 0 without gaps, in bounded tasks.

    A group may hold any share of the rows, so it is cut into cells by a hash of ``spread``; the sizes
    of the cells are added up first, and rows are numbered inside their cell.  ``df`` is read twice
    and must give the same rows each time: pass a stored table.  ``rows`` is its row
    count; wide rows want a smaller ``per_task``.
    """
    cells = max(1, math.ceil(rows / per_task))
    celled = df.withColumn("__cell", F.pmod(F.xxhash64(spread), F.lit(cells)).cast("int"))
    sizes = celled.groupBy(group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    # one row per group and cell here
    before = F.expr(
        f"sum(__n) over (partition by `{group}` order by __cell rows between unbounded preceding and current row) - __n"
    )
    starts = sizes.select(group, "__cell", before.alias("__start"))
    inside = F.expr(f"row_number() over (partition by `{group}`, __cell order by __order) - 1")
    return (
        celled.withColumn("__order", spread)
        .withColumn("__in", inside)
        .join(starts, [group, "__cell"])
        .withColumn(name, (F.col("__start") + F.col("__in")).cast("long"))
        .drop("__cell", "__order", "__in", "__start")
    )


def look_up(big: DataFrame, side: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join with a table of one row per key whose column ``weight`` says how many rows need it.

    Keys needed by more than 1/MAX_HOT_KEYS of the rows number at most MAX_HOT_KEYS, and are broadcast;
    any other key brings a bounded share of the rows to its task.  ``big`` is read twice.
    """
    limit = max(10_000, total // MAX_HOT_KEYS)
    is_hot = F.col(weight) > limit
    columns = [c for c in side.columns if c != key]
    hot = side.where(is_hot).withColumn("__hot", F.lit(True))
    tried = big.join(F.broadcast(hot), key, "left")
    found = tried.where("__hot").drop("__hot")
    rest = tried.where("__hot is null").drop("__hot", *columns)
    return found.unionByName(rest.join(side.where(~is_hot), key, "left"))
