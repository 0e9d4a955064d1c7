"""What tasks leave behind in their worker: workers outlive the stages of a pipeline."""

import pyarrow as pa
from pyspark.sql import functions as F

import public_tokenizers
from contractflow.llm import encoding
from contractflow.llm.op04_language import keep_identified
from contractflow.llm.op07_packing import split_documents

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_packed_ids_are_given_up(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, schema: task)
    split = split_documents(docs, WORDS, 2048, 1, True, ("lang",))
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(3_000)) for i in range(50)] + [""]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(51)), "text": texts, "lang": ["en"] * 51})
    try:
        whole = encoding.WordIds(WORDS).ids
        expected = [b"".join(whole(pa.array(t.split())).to_pylist()) + encoding.packed([1]) for t in texts]
        before = pa.total_allocated_bytes()
        found = {}
        for batch in split(iter([rows])):
            for piece in batch.to_pylist():
                found[piece["doc_id"]] = found.get(piece["doc_id"], b"") + piece["ids"]
                assert len(piece["ids"]) == 4 * piece["length"]
        del batch
        assert [found[i] for i in range(51)] == expected
        assert sum(map(len, expected)) > 1_000_000
        assert pa.total_allocated_bytes() - before < 100_000
    finally:
        encoding.release()
    assert not encoding._held and not encoding._loaded


def test_a_kept_text_is_sent_to_the_workers_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    sent, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **k: sent.append(self.columns) or real(self, *a, **k))
    assert keep_identified(docs, F.lit(True)).collect() == [(1, "some words", "en")]
    assert sent[-1] == docs.columns
