"""Work that grew faster than its input, or stayed in one task."""

import json

import pytest
from pyspark.sql import functions as F

from contractflow.functions import text as T
from contractflow.plans import catalog
from contractflow.sources.files import stream_event_files
from contractflow.storage import RELEASE, shuffles_released
from contractflow.streaming import loop


def test_texts_of_one_file_go_to_all_tasks(spark, tmp_path):
    rows = [(i, None if i == 7 else f"Text {i} \\u00e9") for i in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.text_functions(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.select("doc_id").distinct().count() == found.count() == 200


def test_iri_part_goes_through_the_text_once(spark):
    assert T.iri_part("text").count("regexp_replace") == 1
    rows = [("a b/c",), ("",), (" /\u00e9\n",), (None,), ("-._",), ("\u00e9\u00e9x\U0001f600y",)]
    found = spark.createDataFrame(rows, "text string").select(F.expr(T.iri_part("text"))).collect()
    assert [r[0] for r in found] == ["abc", "unknown", "unknown", None, "-._", "xy"]


def test_stream_reads_its_files_once(spark, tmp_path, monkeypatch):
    """What a batch is healed from is a stored table, not the files."""
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"eventId": f"e{i}"}))
    seen = []
    monkeypatch.setattr(loop, "_heal_batch", lambda events, batch_id, store: seen.append((events.count(), events.inputFiles())))
    stream = stream_event_files(spark, f"{tmp_path}/in")
    loop.run_stream(stream, loop.Store(f"{tmp_path}/s"), f"{tmp_path}/c", available_now=True).awaitTermination()
    assert [n for n, _ in seen] == [3] and not any(f.endswith(".json") for _, files in seen for f in files)


def test_suppliers_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, f"s{i}", i % 3) for i in range(40)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_nationkey bigint").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")

    class Done:
        def awaitTermination(self):
            pass

    monkeypatch.setattr(catalog, "run_stream", lambda *args, **kwargs: Done())
    monkeypatch.setattr(catalog, "_folder", lambda *args: f"{tmp_path}/root")
    catalog._streamed_suppliers(spark, str(tmp_path))
    names = [p.name for p in (tmp_path / "root" / "in").glob("part-*.json")]
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) > 1


def test_passes_of_the_phrases_release_their_shuffles(spark, monkeypatch):
    op11 = pytest.importorskip("contractflow.llm.op11_collocations")
    before, seen, count = spark.conf.get(RELEASE), [], op11.count_phrases

    def watched(*args, **kwargs):
        seen.append(spark.conf.get(RELEASE))
        return count(*args, **kwargs)

    monkeypatch.setattr(op11, "count_phrases", watched)
    docs = spark.createDataFrame([(i, "a b c d e f", "en") for i in range(30)], "doc_id bigint, text string, lang string")
    found = op11.frequent_phrases(docs, least=10)
    assert found.where("phrase = 'a b c'").first()["n"] == 30
    assert set(seen) == {"true"} and spark.conf.get(RELEASE) == before
    with pytest.raises(ZeroDivisionError), shuffles_released(spark):
        1 / 0
    assert spark.conf.get(RELEASE) == before
