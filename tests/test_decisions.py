import json
from datetime import datetime, timedelta

from contractflow.operators import decisions

T0 = datetime(2026, 1, 1)


def log(spark, levels):
    rows = [((0, 0, i, ""), 0, T0 + timedelta(seconds=i), level, "stage", f"m{i}", {"source": "s"}) for i, level in enumerate(levels)]
    return spark.createDataFrame(rows, decisions.DECISION_SCHEMA)


def test_tail_keeps_the_newest(spark):
    tail = decisions.decision_tail(log(spark, ["INFO"] * 5), 3).collect()
    assert sorted(r["message"] for r in tail) == ["m2", "m3", "m4"]


def test_level_filter(spark):
    table = log(spark, ["ERROR", "WARN", "INFO", "DEBUG"])
    assert [decisions.level_filter(table, level).count() for level in ("error", "WARN", "INFO", "TRACE")] == [1, 2, 3, 4]


def test_lines_round_trip_and_broken_lines(spark):
    lines = decisions.to_lines(log(spark, ["WARN"]))
    line = json.loads(lines.first()["value"])
    assert line == {"ts_ms": 1767225600000, "level": "WARN", "target": "stage", "message": "m0", "fields": {"source": "s"}}
    broken = spark.createDataFrame([("not valid json",), ("[1]",)], "value string")
    rows = decisions.parse_decision_lines(lines.union(broken)).collect()
    assert (rows[0]["level"], rows[0]["message"], rows[0]["fields"]) == ("WARN", "m0", {"source": "s"})
    assert [r["level"] for r in rows[1:]] == ["ERROR", "ERROR"]
    assert rows[1]["message"].endswith("not valid json") and rows[1]["target"] == "console"
