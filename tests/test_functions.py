import pytest
from pyspark.sql import functions as F

from contractflow.functions import json as J
from contractflow.functions import text as T


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.selectExpr("i", f"{expression} as out").orderBy("i").collect()]


def test_text_functions(spark):
    assert column(spark, ["user_id", "User.Id", "USER-ID", "uid", "é1", ""], T.normalize_key("v")) == [
        "userid", "userid", "userid", "uid", "1", "",
    ]
    assert column(spark, ["user_id", "_a1", "user-id", "1a", "a.b", "", "a\n"], T.is_safe_key("v")) == [
        True, True, False, False, False, False, False,
    ]
    assert column(spark, ["a b/c", "!!!", "x-1_2.3", None], T.iri_part("v")) == ["abc", "unknown", "x-1_2.3", None]
    assert column(spark, ['a\\b"c\nd\re', "plain"], T.escape_literal("v")) == ['a\\\\b\\"c\\nd\\re', "plain"]
    assert column(spark, ["e1.json", "a.b.json", ".hidden", "noext", ""], T.file_stem("v")) == [
        "e1", "a.b", ".hidden", "noext", "unknown",
    ]
    assert column(spark, [None, "x"], T.event_key("v", "'fb'")) == ["fb", "x"]
    assert column(spark, [250_000_003, 5], T.wrap_total("v", 100_000_000), "bigint") == [50_000_003, 5]


def test_strict_json(spark):
    J.enable_duplicate_keys(spark)
    cases = {
        '{"a":1}': True, " {} ": True, "1": True, '"x"': True, "null": True, "[1]": True,
        '{"a":1} x': False, "": False, " ": False, "1,2": False, '{"a":1}] x': False, '{"a":1}]': False,
        "{'a':1}": False, '{"a":01}': False, '{"a":': False, '1,"z"': False, '{"a":1,"a":2}': True,
    }
    assert column(spark, list(cases), J.is_valid_json("v")) == list(cases.values())


def test_canonical_json(spark):
    J.enable_duplicate_keys(spark)
    cases = {
        '{"b":1, "a":{"d":1,"c":[2, 3]}}': '{"a":{"c":[2,3],"d":1},"b":1}',
        '{"userId":"first","userId":"second"}': '{"userId":"second"}',
        '{"a":"\\u00e9"}': '{"a":"é"}',
        "nope": None,
    }
    assert column(spark, list(cases), J.canonical_json("v")) == list(cases.values())


@pytest.mark.parametrize(
    "values",
    [
        {
            "1": "1", "-5": "-5", "true": "true", '"s"': "s", "null": None, "[1]": None, '{"a":1}': None,
            "1.0": "1.0", "1.10": "1.1", "1e3": "1000.0", "1e7": "10000000.0", "1e16": "1e16", "0.1": "0.1",
            "1.5e-6": "1.5e-6", "-0.00012": "-0.00012", "18446744073709551615": "18446744073709551615",
            "18446744073709551616": "1.8446744073709552e19", "12345.75": "12345.75", "0.0": "0.0",
        }
    ],
)
def test_scalar_text(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.selectExpr("i", "parse_json(v) as x").selectExpr("i", f"{J.scalar_text('x')} as out").orderBy("i").collect()
    assert [r["out"] for r in rows] == list(values.values())


def test_bigint_text(spark):
    cases = {
        "1000": 1000, "1000.5": 1001, "1e3": 1000, "+5": 5, "-1": -1, "three minutes": None, "": None,
        "-0.5": -1, "9223372036854775807": 9223372036854775807, "9223372036854775808": None,
    }
    assert column(spark, list(cases), J.rounded_bigint("v")) == list(cases.values())


def test_json_string_gives_text_of_nested_values(spark):
    payload = '{"a":{"x":1},"b":null,"x.y":"q","c":"t"}'
    df = spark.createDataFrame([(payload,)], "p string")
    keys = ["a", "b", "x.y", "c", "zz"]
    row = df.selectExpr(*[f"{J.json_string('p', k)} as c{i}" for i, k in enumerate(keys)]).first()
    assert list(row) == ['{"x":1}', None, "q", "t", None]
    with pytest.raises(ValueError):
        J.json_string("p", "it's")


def test_functions_reach_the_planner_as_columns(spark):
    assert spark.range(1).select(F.expr(T.normalize_key("'A-b'")).alias("x")).first()["x"] == "ab"
