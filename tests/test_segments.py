"""Merged tables, kept totals, batch reports, the early tail and the lookup index."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from sequential import frame

from contractflow.contract import ContractError, make_contract
from contractflow.functions.crypto import generate_keys
from contractflow.operators import lookup, segments
from contractflow.operators.decisions import decision_tail
from contractflow.operators.kept_totals import read_totals, update_totals
from contractflow.operators.metrics import encrypt_metrics, latest_per_event, read_metrics, upsert_metrics
from contractflow.operators.private_sum import user_totals
from contractflow.operators.segments import chosen, merge_segments, read_segments, write_segment
from contractflow.streaming.loop import Store, heal_batch
from contractflow.tables import delete

KEY, SECRET = generate_keys(512)


def numbers(spark, *rows):
    return spark.createDataFrame([(k, v) for k, v in rows], "k string, v bigint").coalesce(1)


def newest(rows):
    return rows.groupBy("k").agg(F.max("v").alias("v")).coalesce(1)


def values(spark, path, before=None):
    rows = newest(read_segments(spark, path, "k string, v bigint", before)).collect()
    return sorted((r["k"], r["v"]) for r in rows)


def test_segments_are_few_and_hold_every_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    assert values(spark, path) == []
    for b in range(30):
        write_segment(numbers(spark, ("all", b), (f"only{b}", b)), path, b)
        merge_segments(spark, path, "k string, v bigint", b, newest, fan=3)
        assert values(spark, path) == sorted([("all", b), *((f"only{i}", i) for i in range(b + 1))])
        assert len(chosen(spark, path)) <= 3 * 3
    assert chosen(spark, path) == [(27, 29), (0, 26)]
    assert values(spark, path, before=29)[0] == ("all", 28)
    # parts of all merges but the last of each tier are gone
    assert len(os.listdir(path)) < 16


def test_a_merge_that_broke_off_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    for b in range(3):
        write_segment(numbers(spark, ("all", b)), path, b)
    merge_segments(spark, path, "k string, v bigint", 2, newest, fan=3)
    assert chosen(spark, path) == [(0, 2)]
    delete(spark, f"{path}/segment=0-2/_SUCCESS")
    assert chosen(spark, path) == [(2, 2), (1, 1), (0, 0)] and values(spark, path) == [("all", 2)]
    # the batch runs again, with the merge half there and with it complete
    for again in (7, 8):
        write_segment(numbers(spark, ("all", again)), path, 2)
        assert chosen(spark, path)[0] == (2, 2)
        merge_segments(spark, path, "k string, v bigint", 2, newest, fan=3)
        assert chosen(spark, path) == [(0, 2)] and values(spark, path) == [("all", again)]


def test_kept_totals_equal_recomputation(spark, tmp_path):
    """Events are overwritten, change owners, come again in the same batch, and one batch runs twice."""
    rng = random.Random(3)
    table, totals = str(tmp_path / "metrics"), str(tmp_path / "totals")
    number, current = 0, {}
    for batch in range(8):
        rows = []
        for _ in range(12):
            number += 1
            event, user, value = f"e{rng.randrange(15)}", f"u{rng.randrange(4)}", rng.randrange(1000)
            rows.append((event, user, value, (batch, 0, number, ""), None))
            current[event] = (user, value)
        clear = spark.createDataFrame(rows, "event_id string, user_id string, ms_played bigint, ord struct<batch:bigint,session:bigint,seq:bigint,tie:string>, received_at timestamp")
        for _ in range(2 if batch == 5 else 1):
            upsert_metrics(encrypt_metrics(latest_per_event(clear), KEY), table, batch, fan=3)
            update_totals(spark, table, totals, batch, KEY, fan=3)
        want = {}
        for user, value in current.values():
            n, total = want.get(user, (0, 0))
            want[user] = (n + 1, total + value)
        kept = {r["user_id"]: (r["n"], r["total"]) for r in user_totals(read_totals(spark, totals), KEY, SECRET).collect()}
        assert kept == want
    again = {r["user_id"]: (r["n"], r["total"]) for r in user_totals(read_metrics(spark, table), KEY, SECRET).collect()}
    assert again == kept
    one = user_totals(read_totals(spark, totals, "u1"), KEY, SECRET).collect()
    assert [(r["n"], r["total"]) for r in one] == [kept["u1"]]
    text = read_totals(spark, totals, "u1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,u1)]" in text


def played(i, **more):
    return {"eventId": f"e{i}", "userId": f"u{i % 3}", "trackId": "t", "timestamp": "2026-01-01T00:00:00", "msPlayed": i} | more


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Five batches; ids under spellings that are learned late, an id of many rows, broken payloads."""
    store = Store(str(tmp_path_factory.mktemp("store")), key=KEY)
    rows = []
    for i in range(50):
        obj = played(i)
        if i % 7 == 0:
            obj["EVENT_ID"] = obj.pop("eventId")
        if i < 10 and i % 2:
            obj.pop("timestamp")
            obj["event-id"] = obj.pop("eventId", "x")
        if i % 11 == 5:
            obj["eventId"] = "same"
        rows.append(("partner-feed", json.dumps(obj) if i % 13 else "{broken"))
    events = frame(spark, rows).cache()
    for b in range(5):
        for _ in range(2 if b == 3 else 1):
            heal_batch(events.where(f"ord.seq div 10 = {b}"), b, store)
    events.unpersist()
    return store


def test_reports_agree_with_the_log(spark, store):
    log = store.decisions(spark)
    counts = {(r["batch_id"], r["stage"]): r["count"] for r in log.groupBy("batch_id", "stage").count().collect()}
    reports = store.reports(spark).orderBy("batch_id").collect()
    assert [r["batch_id"] for r in reports] == list(range(5))
    for r in reports:
        b = r["batch_id"]
        broken = sum(1 for i in range(10 * b, 10 * b + 10) if i % 13 == 0)
        assert (r["rows_in"], r["malformed"]) == (10, broken)
        assert r["conforming"] == counts.get((b, "conforms"), 0) and r["not_conforming"] == counts.get((b, "not_conforming"), 0)
        assert r["healed"] == counts.get((b, "healed"), 0) and r["conforming"] + r["not_conforming"] == 10 - broken
        assert r["decisions"] == sum(n for (x, _), n in counts.items() if x == b)
        assert 0 < r["duration_ms"] < 600_000
    timed = store.timed_decisions(spark).collect()
    assert len(timed) == log.count() and all(r["event_ms"] == r["batch_ms"] / 10 for r in timed)


@pytest.mark.parametrize("n", [1, 5, 25, 1000])
def test_tail_reads_the_newest_batches_only(spark, store, n):
    want = [r[:3] for r in decision_tail(store.decisions(spark).drop("batch_id"), n).collect()]
    tail = store.tail(spark, n)
    assert [r[:3] for r in tail.collect()] == want
    batches = {int(p.split("batch_id=")[1].split("/")[0]) for p in tail.inputFiles()}
    held = {r["batch_id"]: r["count"] for r in store.decisions(spark).groupBy("batch_id").count().collect()}
    needed = next((k for k in range(1, 5) if sum(held[b] for b in range(5 - k, 5)) >= n), 5)
    assert batches == set(range(5 - needed, 5))


def test_tail_with_batches_that_overlap_in_time(spark, store):
    rows = [(0, 10, 0, 100), (1, 10, 50, 60), (2, 10, 90, 95), (3, 5, None, 94), (4, 3, 1, None), (5, 0, None, None)]
    reports = spark.createDataFrame(rows, "batch_id bigint, decisions bigint, first_us bigint, last_us bigint")
    from contractflow.streaming.reports import tail_batches

    assert tail_batches(reports, 1) == [0, 2, 3, 1][:3]
    assert tail_batches(reports, 11) == [0, 2, 3, 1]
    assert tail_batches(reports, 1000) == [0, 2, 3, 1, 4]


def test_lookup_equals_the_view(spark, store):
    view = {}
    for r in store.view(spark).orderBy("id").collect():
        if r["event_id"] is not None:
            view.setdefault(r["event_id"], tuple(r))
    assert len(view) > 30 and "same" in view
    asked = [*list(view)[::6], "same", "e0", "e7", "nobody", "", "x"]
    for event_id in asked:
        got = [tuple(r) for r in store.lookup(spark, event_id).collect()]
        assert got == ([view[event_id]] if event_id in view else [])


def test_lookup_in_steps(spark, store, monkeypatch):
    whole = store.lookup(spark, "same").collect()
    monkeypatch.setattr(lookup, "PLACES", 1)
    assert store.lookup(spark, "same").collect() == whole and store.lookup(spark, "nobody").isEmpty()


def test_lookup_opens_the_files_that_may_hold_the_event(spark, store):
    files = store.raw(spark).inputFiles()
    places = lookup.places_of(spark, store.root, "e20")
    assert [r["batch_id"] for r in places.collect()] == [2]
    opened = [f for f in store.lookup(spark, "e20").inputFiles() if "raw_events" in f]
    assert len(opened) == 1 and len(files) >= 5
    assert "EqualTo(hash" in places._jdf.queryExecution().executedPlan().toString()


def test_lookup_needs_an_event_id(spark, tmp_path):
    nameless = make_contract([("a", True, "a", "string", "T", "a")], [], "T")
    with pytest.raises(ContractError):
        Store(str(tmp_path), nameless).lookup(spark, "x")


def test_totals_of_the_loop(spark, store):
    kept = sorted(tuple(r) for r in user_totals(store.totals(spark), KEY, SECRET).collect())
    assert kept == sorted(tuple(r) for r in user_totals(store.metrics(spark), KEY, SECRET).collect())
    assert segments.chosen(spark, f"{store.root}/totals")
