"""The pipeline against what its stages must do to planted rows."""

import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from contractflow.llm.op04_language import keep_identified


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    body = [" ".join(f"{p}{i}" for i in range(80)) for p in ("aa", "bb", "cc")]
    item = "which of these invented words would stand at the very end of this question about words"
    rows = [
        (1, body[0], "en"), (2, body[0].upper(), "en"), (3, body[1], "en"), (4, body[1] + " more", "en"),
        (5, "12 34 !!", "en"), (6, None, "en"), (7, body[2] + " " + item, "en"), (8, body[2][:200], None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({})
    docs = docs.selectExpr("*", "'s' as source", "length(text) as n_chars", "1 as __language", "2 as score")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").drop("__language")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
        left.append(sorted(r["doc_id"] for r in docs.collect()))
    assert left == [[1, 2, 3, 4, 7, 8], [2, 3, 4, 7, 8], [2, 3, 7, 8], [2, 3, 8]]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == {2, 3, 8}


def test_the_language_found_reaches_the_pieces(spark, tmp_path):
    """Documents with a missing or wrong language come out with the one they are in, and can be selected by it."""
    rng = random.Random(4)
    words = {"en": "the of and that with which from have this".split(), "fr": "le la les dans pour une avec sont cette".split()}
    rows = [(i, " ".join(rng.choices(words["en" if i % 2 else "fr"], k=40)) + f" {i}x", "en" if i % 2 else "fr") for i in range(400)]
    held_out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    odd = {held_out[0]: None, held_out[1]: "de", held_out[2]: "fr" if held_out[2] % 2 else "en"}
    rows = [(i, t, odd.get(i, lang), "s", len(t)) for i, t, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == set(range(400))
    assert all(p["lang"] == ("en" if p["doc_id"] % 2 else "fr") for p in pieces)
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    french = keep_identified(docs, learn, languages=["fr"])
    assert sorted(r["doc_id"] for r in french.collect()) == list(range(0, 400, 2)) and french.columns == docs.columns
    assert keep_identified(docs, learn, least_score=1.01).isEmpty()
