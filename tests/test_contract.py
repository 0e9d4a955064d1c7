import json
import random
import re

import pytest
from pyspark.sql import functions as F
from sequential import frame, random_events

from contractflow.contract import ContractError, default_contract, load_contract, make_contract, save_contract
from contractflow.operators import checks, graph
from contractflow.operators.parse import parse_events
from contractflow.plans.heal import heal

CONTRACT = default_contract()

DATETIMES = {
    "2026-01-01T00:00:00": True, "2026-01-01T00:00:00.5Z": True, "2026-01-01T00:00:00+14:00": True,
    "2026-01-01T24:00:00": True, "-0044-03-15T00:00:00": True, "12026-01-01T00:00:00": True,
    "2024-02-29T00:00:00": True, "2000-02-29T00:00:00": True,
    "1900-02-29T00:00:00": False, "2026-02-29T00:00:00": False, "2026-02-30T00:00:00": False,
    "2026-04-31T00:00:00": False, "2026-01-01": False, "1768694400": False, "2026-01-01T24:00:01": False,
    "2026-01-01 00:00:00": False, " 2026-01-01T00:00:00": False, "2026-01-01T00:00:00\n": False,
    "2026-01-01T00:00:00+14:30": False, "": False,
}
INTEGERS = {"0": True, "+5": True, "-0": True, "007": True, "9" * 30: True, "-1": False, "1.0": False, "three minutes": False, "": False, "5\n": False}


def test_datatypes(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(DATETIMES)], "i int, v string")
    got = [r["x"] for r in df.selectExpr("i", f"{checks.is_datetime('v')} as x").orderBy("i").collect()]
    assert dict(zip(DATETIMES, got)) == DATETIMES
    df = spark.createDataFrame([(i, v) for i, v in enumerate(INTEGERS)], "i int, v string")
    got = [r["x"] for r in df.selectExpr("i", f"{checks.is_non_negative_integer('v')} as x").orderBy("i").collect()]
    assert dict(zip(INTEGERS, got)) == INTEGERS


BASE = {"eventId": "e", "userId": "u1", "trackId": "t1", "timestamp": "2026-01-01T00:00:00"}
VERDICTS = {
    "complete": (BASE | {"msPlayed": 5}, True),
    "D1a": (BASE | {"userId": ""}, False),
    "D1b": (BASE | {"userId": "!!!not-an-id###"}, True),
    "D2": (BASE | {"msPlayed": "three minutes"}, False),
    "D3": (BASE | {"timestamp": 1768694400}, False),
    "decimal": (BASE | {"msPlayed": 1000.5}, False),
    "plus": (BASE | {"msPlayed": "+5"}, True),
    "no metric": (BASE, True),
    "missing": ({k: v for k, v in BASE.items() if k != "trackId"}, False),
}


def test_verdicts_in_row_and_graph_form(spark):
    events = parse_events(frame(spark, [("x", json.dumps(o)) for o, _ in VERDICTS.values()]), CONTRACT)
    judged = heal(events, None, None, CONTRACT).judged
    rows = judged.orderBy("ord").collect()
    assert {n: r["conforms"] for n, r in zip(VERDICTS, rows)} == {n: v for n, (_, v) in VERDICTS.items()}
    triples = graph.to_triples(judged.withColumn("n", judged["ord.seq"]), CONTRACT, checks.values_in(), keep=["n"])
    verdicts = {r["n"]: r["conforms"] for r in graph.graph_conforms(triples, CONTRACT, graph="n").collect()}
    assert [verdicts[i] for i in range(len(rows))] == [r["conforms"] for r in rows]


def test_row_and_graph_reports_agree_on_random_events(spark):
    rows = [(o, json.dumps(p)) for o, p in random_events(random.Random(5), 200)]
    judged = heal(parse_events(frame(spark, rows), CONTRACT), None, None, CONTRACT).judged.withColumn("n", F.col("ord.seq"))
    by_row = judged.selectExpr("n", "inline(violations)").select("n", "shape", "path", "constraint").collect()
    triples = graph.to_triples(judged, CONTRACT, checks.values_in(), keep=["n"])
    by_graph = graph.graph_violations(triples, CONTRACT, graph="n").select("n", "shape", "path", "constraint").collect()
    assert sorted(map(tuple, by_row)) == sorted(map(tuple, by_graph))


def test_graph_form_counts_values_of_any_graph(spark):
    ns = graph.vocabulary()
    event, user = "http://x/e", "http://x/u"
    rows = [
        (1, event, graph.RDF_TYPE, ns + "StreamingEvent", "iri", None),
        (1, event, ns + "eventId", "a", "literal", graph.XSD + "string"),
        (1, event, ns + "eventId", "b", "literal", graph.XSD + "string"),
        (1, event, ns + "eventTimestamp", "2026-01-01T00:00:00", "literal", graph.XSD + "string"),
        (1, event, ns + "performedBy", user, "iri", None),
        (1, user, ns + "userId", "u", "literal", graph.XSD + "string"),
    ]
    triples = spark.createDataFrame(rows + rows[:1], "g int, s string, p string, o string, o_kind string, datatype string")
    report = graph.graph_violations(triples, CONTRACT, graph="g", deduplicate=True)
    assert sorted((r["path"], r["constraint"]) for r in report.collect()) == [
        ("eventId", "maxCount"), ("eventTimestamp", "datatype"), ("involvesTrack", "minCount"), ("performedBy", "class"),
    ]


def test_ntriples(spark, tmp_path):
    payload = json.dumps(BASE | {"eventId": 'a "q"\n\\', "userId": "!!"})
    judged = heal(parse_events(frame(spark, [("x", payload)]), CONTRACT), None, None, CONTRACT).judged
    triples = graph.to_triples(judged, CONTRACT, checks.values_in())
    path = str(tmp_path / "nt")
    graph.export_ntriples(triples, path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert '<http://example.org/event/aq> <http://example.org/ontology#eventId> "a \\"q\\"\\n\\\\" .' in lines
    assert "<http://example.org/event/aq> <http://example.org/ontology#performedBy> <http://example.org/user/unknown> ." in lines
    assert len(lines) == 9 and all(re.match(r"^<[^>]*> <[^>]*> .* \.$", line) for line in lines)


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_contract_tables_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / "contract")
    save_contract(spark, CONTRACT, path, fmt)
    loaded = load_contract(spark, path, fmt=fmt)
    assert loaded.fields == CONTRACT.fields and set(loaded.constraints) == set(CONTRACT.constraints)


def test_bad_contracts_are_refused():
    field = ("a", True, "a", "string", "E", "a", "")
    with pytest.raises(ContractError):
        make_contract([field], [("S", "E", "a", "pattern", "x")], "E")
    with pytest.raises(ContractError):
        make_contract([field], [("S", "E", "a", "datatype", "decimal")], "E")
    with pytest.raises(ContractError):
        make_contract([("--", True, "a", "string", "E", "a", "")], [], "E")


def test_reference_check_paths_agree(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 5) for i in range(100)] + [(100, None)], "id int, k int")
    parent = spark.createDataFrame([(k,) for k in (0, 1, 2, 4, 6, 6, None)], "pk int")
    expected = sorted(r["id"] for r in rows.collect() if r["k"] in (3, 5))
    for limit in (1000, 3, 0):
        got = checks.reference_violations(rows, "k", parent, "pk", limit)
        assert sorted(r["id"] for r in got.collect()) == expected
