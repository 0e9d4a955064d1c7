"""A corpus pipeline: stages that each work on all documents the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import crc32_of_id
from contractflow.llm.op04_language import keep_identified
from contractflow.llm.op05_exact_dedup import keep_distinct
from contractflow.llm.op06_decontamination import drop_contaminated
from contractflow.llm.op07_packing import pack
from contractflow.llm.op08_ngram_join import keep_one_of_each
from contractflow.storage import cut_lineage, temporary_tables
from contractflow.tables import delete


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: null texts and texts without a letter.  ``lang`` becomes what the others are found to be in."""
    return keep_identified(docs, F.pmod(crc32_of_id(), F.lit(4)) != 2)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest id stays."""
    return keep_distinct(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word n-grams, similarity 0.8) the document with the smallest id stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, be it with other numbers or names, go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, one sequence each, with the language found in the first stage."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), carry=("lang",))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

# the tokenizer's ids cannot be had in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage reads what the one before has written; a stage's own tables go when it is done, its result one stage later."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with temporary_tables(spark) as written:
            docs = cut_lineage(stage(spark, docs, sf_dir))
            own = written.pop()
        if last:
            delete(spark, last)
        last = own
    return STAGES[-1][1](spark, docs, sf_dir)
