"""Exact deduplication by a tree merge of digest runs.

Every partition of the stored digest table is a run: one entry per digest, holding the best row and
the number of copies.  Runs are exchanged and merged ``fan_in`` at a time, round after round, until one
run is left; it is spread over all tasks by digest, since a merge needs only equal digests together.
A digest that fills a third of the corpus is one entry per run before anything is shuffled.

An entry counts as the same text only if SHA-256, the length in bytes and a second, independent hash
agree; all three form the key of every merge.  The result travels back the same way, from the last run
to the first runs to the rows, so no key ever brings more than one run's rows to a task.

Texts are equal after lower-casing A-Z only.  Of equal texts the row with the largest doc_id stays; null
ids sort below all others, and of rows with the same id exactly one stays.  Null text counts as empty,
and all empty texts are one group.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import ascii_lower, text_of
from contractflow.storage import cut_lineage

KEY = ["digest", "n_bytes", "second"]
FAN_IN = 16


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row, run and the three parts of the key; the only pass over the texts, stored."""
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        ascii_lower(text_of()).alias("text"),
    )
    hashed = keyed.select(
        "doc_id",
        "row",
        "run",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.octet_length("text").alias("n_bytes"),
        F.xxhash64("text").alias("second"),
    )
    return cut_lineage(hashed)


def merge_runs(first: DataFrame, last_run: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge entries of runs 0 to ``last_run`` until every digest has one entry."""
    merged = first
    while last_run > 0:
        merged = (
            merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", *KEY)
            .agg(F.max("best").alias("best"), F.max("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
        )
        last_run //= fan_in
    return merged.drop("run")


def exact_groups(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, row, keep_id, group_size, kept, digest (binary)."""
    stored = digests(docs)
    # order of doc_id, then row, in one number of fixed width, so that the aggregates hash
    rank = (
        "coalesce(cast(doc_id as decimal(20,0)), cast(-9223372036854775809 as decimal(20,0)))"
        " * cast(1000000000000000000 as decimal(19,0)) + cast(row as decimal(19,0))"
    )
    ranked = stored.withColumn("rank", F.expr(f"cast({rank} as decimal(38,0))"))
    last_run = stored.agg(F.max("run")).first()[0] or 0
    first = ranked.groupBy("run", *KEY).agg(
        F.max("rank").alias("best"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")
    )
    last = merge_runs(first, last_run, fan_in)
    known = first.select("run", *KEY).join(last, KEY)
    return ranked.join(known, ["run", *KEY]).select(
        "doc_id",
        "row",
        "keep_id",
        F.col("copies").cast("long").alias("group_size"),
        (F.col("rank") == F.col("best")).alias("kept"),
        "digest",
    )


def keep_distinct(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows are found again by doc_id and digest; of rows that share both any one stays.
    """
    lowered = ascii_lower(text_of()).cast("binary")
    marked = docs.withColumns(
        {"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "__digest": F.unhex(F.sha2(lowered, 256))}
    )
    stay = exact_groups(docs, fan_in).where("kept").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("__id"), F.col("digest").alias("__digest")
    )
    kept = marked.join(stay, ["__id", "__digest"], "left_semi")
    # only matters where ids repeat; the join has sorted the rows by these keys already
    return kept.dropDuplicates(["__id", "__digest"]).drop("__id", "__digest")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE_SQL = """
with normal as (
    select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as d
    from documents
)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, d as text_sha256
from normal window same as (partition by d)
"""
