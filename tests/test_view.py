import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from sequential import frame, random_events

from contractflow.contract import default_contract
from contractflow.operators import bounded, registry, shim
from contractflow.operators.parse import parse_events
from contractflow.operators.registry import REGISTRY_SCHEMA, Alias, as_aliases
from contractflow.plans.heal import alias_table, heal

CONTRACT = default_contract()


def with_id(events):
    return events.withColumn("id", F.col("ord.seq"))


def test_view_reads_text_of_any_member_through_safe_keys(spark):
    payloads = [
        {"userId": {"id": 1}, "user_id": "u"},
        {"user-id": "u2", "userId": None},
        {"user_id": None, "USERID": "late", "msPlayed": 1000.5},
        {"userId": 7, "user_id": "decoy", "msPlayed": "three minutes"},
        {"trackId": True, "msPlayed": "1e3"},
        [1],
    ]
    raw = with_id(frame(spark, [("x", json.dumps(p)) for p in payloads]))
    aliases = as_aliases(
        [Alias("userId", "user-id", (0, 0, 1, "")), Alias("userId", "user_id", (0, 0, 2, "")), Alias("userId", "USERID", (0, 0, 3, ""))],
        CONTRACT,
    )
    rows = shim.healed_view(raw, aliases, name="streaming_events").orderBy("id").collect()
    assert [r["user_id"] for r in rows] == ['{"id":1}', None, "late", "7", None, None]
    assert [r["ms_played"] for r in rows] == [None, None, 1001, None, 1000, None]
    assert rows[4]["track_id"] == "true"
    assert spark.sql("select user_id from streaming_events where id = 2").first()["user_id"] == "late"
    every = shim.healed_view(raw, aliases, safe_keys_only=False).orderBy("id").collect()
    assert every[1]["user_id"] == "u2"


def test_view_paths_agree(spark, monkeypatch):
    rows = [(o, json.dumps(p)) for o, p in random_events(random.Random(41), 200)]
    raw = with_id(parse_events(frame(spark, rows), CONTRACT))
    aliases = heal(raw, None, None, CONTRACT).aliases
    inline = shim.healed_view(raw, aliases).orderBy("id").collect()
    keys = registry.alias_map(aliases)
    texts = [
        f"{shim.coalesce_aliases(keys[f.name], f.view_type == 'bigint')} as {f.view_column}" for f in CONTRACT.fields
    ]
    assert raw.selectExpr("id", "source", "received_at", *texts).orderBy("id").collect() == inline
    monkeypatch.setattr(bounded, "is_small", lambda *args: False)
    table = spark.createDataFrame(alias_table(spark, aliases).collect(), REGISTRY_SCHEMA)
    assert shim.healed_view(raw, table).orderBy("id").collect() == inline


def test_lookup_is_one_row_or_none(spark):
    rows = [("x", '{"eventId":"a","userId":"1"}'), ("x", '{"eventId":"a","userId":"2"}')]
    view = shim.healed_view(with_id(frame(spark, rows)), as_aliases(None, CONTRACT))
    assert shim.lookup_event(view, "a").count() == 1
    assert shim.lookup_event(view, "b").count() == 0


def test_no_alias_gives_typed_null(spark):
    row = spark.range(1).selectExpr("'{}' as payload").selectExpr(
        f"{shim.coalesce_aliases([])} as a", f"{shim.coalesce_aliases(['x-y'], True)} as b"
    )
    assert row.dtypes == [("a", "string"), ("b", "bigint")] and list(row.first()) == [None, None]


def test_registry_learn_touch_audit_stale(spark):
    t0 = datetime(2026, 1, 1)
    base = registry.default_registry(spark, CONTRACT)
    lesson = registry.alias_rows(spark, [("userId", "user_id", (0, 0, 5, ""), t0, t0)])
    once, fresh = registry.learn(base, lesson)
    assert fresh.count() == 1
    twice, again = registry.learn(once, lesson)
    assert again.count() == 0 and twice.count() == once.count()
    used = spark.createDataFrame(
        [("userId", "user_id", t0 + timedelta(days=d)) for d in (1, 3)] + [("userId", "never_known", t0)],
        "canonical string, raw_key string, used_at timestamp",
    )
    touched = registry.touch(twice, used)
    audit = [tuple(r) for r in registry.alias_audit(touched).collect()]
    assert audit == [("userId", "user_id", "2026-01-01 00:00:00", "2026-01-04 00:00:00")]
    assert registry.stale_aliases(touched, t0 + timedelta(days=8), timedelta(days=5)).count() == 0
    assert registry.stale_aliases(touched, t0 + timedelta(days=8, seconds=1), timedelta(days=5)).count() == 1
    older = registry.touch(touched, used.where("used_at < '2026-01-03'"))
    assert [tuple(r) for r in registry.alias_audit(older).collect()] == audit
