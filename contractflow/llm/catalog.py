"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contractflow.llm import (
    op01_substring_dedup,
    op02_token_counts,
    op03_secrets,
    op04_language,
    op05_exact_dedup,
    op06_decontamination,
    op07_packing,
    op08_ngram_join,
    op09_quality,
    op10_kd_sharding,
    op11_collocations,
    op12_simhash,
    op13_periodic_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op01_substring_dedup.op1_substring_dedup,
        op02_token_counts.op2_token_counts,
        op03_secrets.op3_secrets,
        op04_language.op4_language,
        op05_exact_dedup.op5_exact_dedup,
        op06_decontamination.op6_decontamination,
        op07_packing.op7_packing,
        op08_ngram_join.op8_ngram_join,
        op09_quality.op9_quality,
        op10_kd_sharding.op10_kd_sharding,
        op11_collocations.op11_collocations,
        op12_simhash.op12_simhash,
        op13_periodic_runs.op13_periodic_runs,
    )
    return {q.__name__: q for q in listed}


def oracles() -> dict[str, str]:
    return {"op5_exact_dedup": op05_exact_dedup.ORACLE_SQL, "op11_collocations": op11_collocations.ORACLE_SQL}
