import json
import os

from sequential import EVENT_SCHEMA

from contractflow.functions.crypto import generate_keys
from contractflow.operators.policy import Policy, load_policy, save_policy
from contractflow.operators.private_sum import user_totals
from contractflow.operators.raw_log import in_ranges, last_id
from contractflow.sources.envelope import from_envelope
from contractflow.sources.files import read_event_files, stream_event_files
from contractflow.storage import checkpoint_dir, cut_lineage, temporary_tables
from contractflow.streaming.loop import Store, heal_batch, run_stream

KEY, SECRET = generate_keys(512)
BASE = {"eventId": "e", "userId": "u", "trackId": "t", "timestamp": "2026-01-01T00:00:00", "msPlayed": 10}


def put(folder, name, content, moment):
    path = folder / name
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    os.utime(path, (moment, moment))


def renamed(**changes):
    obj = dict(BASE)
    for old, new in changes.items():
        obj[new] = obj.pop(old)
    return obj


def run(spark, folder, store, checkpoint):
    run_stream(stream_event_files(spark, str(folder)), store, str(checkpoint), available_now=True).awaitTermination()


def state(spark, store):
    view = store.view(spark).orderBy("id").collect()
    audit = sorted((r["canonical"], r["raw_key"]) for r in store.registry(spark).collect())
    return [(r["id"], r["event_id"], r["user_id"], r["track_id"], r["ms_played"]) for r in view], audit


def test_stream_restart_quarantine_and_retroactive_healing(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    store = Store(str(tmp_path / "store"), policy=Policy(), key=KEY)
    put(inbox, "untrusted.json", BASE | {"eventId": "e1"} , 1000)
    put(inbox, "early.json", {**renamed(userId="user_id"), "eventId": "e2"}, 1001)
    put(inbox, "broken.json", '{"eventId": "e3",', 1002)
    put(inbox, "ignored.txt", BASE, 1003)
    run(spark, inbox, store, tmp_path / "ck")
    rows, audit = state(spark, store)
    assert [r[:3] for r in rows] == [(1, "e1", "u"), (2, "e2", None)] and audit == []
    assert [r["payload"] for r in store.quarantined(spark).collect()] == ['{"eventId": "e3",']

    # a trusted publisher teaches the rename in a later run: the old row heals, the verdict stays
    put(inbox, "partner-feed.json", {**renamed(userId="user_id", trackId="Track-Id"), "eventId": "e4"}, 1004)
    run(spark, inbox, store, tmp_path / "ck")
    rows, audit = state(spark, store)
    assert rows == [(1, "e1", "u", "t", 10), (2, "e2", "u", "t", 10), (3, "e4", "u", None, 10)]
    assert audit == [("trackId", "Track-Id"), ("userId", "user_id")]
    log = store.decisions(spark).orderBy("batch_id", "ord", "seq").collect()
    assert [r["stage"] for r in log] == [
        "conforms", "breach", "denied", "not_conforming", "breach", "healed", "healed", "conforms",
    ]
    totals = user_totals(store.metrics(spark), KEY, SECRET).collect()
    assert [tuple(r) for r in totals] == [("u", 2, 20)]
    assert store.view(spark, safe_keys_only=False).where("event_id = 'e4'").first()["track_id"] == "t"

    # nothing new: a further start changes nothing
    run(spark, inbox, store, tmp_path / "ck")
    assert state(spark, store) == (rows, audit)


def test_running_a_batch_again_changes_nothing(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(12):
        obj = renamed(userId="user_id") if i % 3 == 0 else dict(BASE)
        put(inbox, f"f{i:02d}.json", obj | {"eventId": f"e{i}"}, 1000 + i)
    events = read_event_files(spark, str(inbox))
    store = Store(str(tmp_path / "store"), key=KEY)
    heal_batch(events.where("fallback_id < 'f06'"), 0, store)
    heal_batch(events.where("fallback_id >= 'f06'"), 1, store)
    first = state(spark, store)
    assert [r[0] for r in first[0]] == list(range(1, 13)) and [r[1] for r in first[0]] == [f"e{i}" for i in range(12)]
    assert last_id(spark, store.root) == 12
    heal_batch(events.where("fallback_id >= 'f06'"), 1, store)
    assert state(spark, store) == first
    assert store.decisions(spark).count() == 12 + 2
    assert user_totals(store.metrics(spark), KEY, SECRET).first()["n"] == 12

    # intermediate tables are gone
    with temporary_tables(spark):
        kept = cut_lineage(spark.range(3))
        path = kept.inputFiles()[0]
        before = os.listdir(f"{checkpoint_dir(spark)}/tables")
        heal_batch(events.where("fallback_id >= 'f06'"), 1, store)
        assert os.listdir(f"{checkpoint_dir(spark)}/tables") == before
        assert kept.count() == 3
    assert not os.path.exists(path.removeprefix("file://"))

    unordered = Store(str(tmp_path / "bulk"), arrival_order=False)
    heal_batch(events, 0, unordered)
    assert sorted(r[0] for r in state(spark, unordered)[0]) == list(range(1, 13))


def test_envelopes(spark):
    rows = [
        (bytearray(b'{"a":1}'), "partner-feed", "q", 1),
        (bytearray(b"\xff\xfe"), None, "q", 2),
        (None, None, "q", 3),
    ]
    df = spark.createDataFrame(rows, "body binary, app_id string, queue string, delivery_tag bigint")
    got = from_envelope(df).orderBy("ord.seq").collect()
    assert [(r["source"], r["origin"], r["fallback_id"]) for r in got] == [
        ("amqp:q:1", "partner-feed", "amqp-1"), ("amqp:q:2", "unknown-app", "amqp-2"), ("amqp:q:3", "unknown-app", "amqp-3"),
    ]
    assert got[0]["payload"] == '{"a":1}' and got[1]["payload"].startswith("base64:")
    assert from_envelope(df, "run7").first()["fallback_id"] == "amqp-run7-1"


def test_policy_tables(spark, tmp_path):
    path = str(tmp_path / "policy")
    save_policy(spark, path, ["userId"], ["a", "b"])
    loaded = load_policy(spark, path)
    assert loaded.protected == ("userId",) and sorted(loaded.trusted) == ["a", "b"]
    assert load_policy(spark, str(tmp_path / "nowhere")).deny_all
    save_policy(spark, str(tmp_path / "empty"), [], [])
    assert load_policy(spark, str(tmp_path / "empty")).deny_all


def test_ordered_input_is_written_where_it_is(spark, tmp_path):
    """Ids are those of arrival either way; input whose partitions are ranges is not shuffled, in whatever order they come."""
    rows = [("s", "o", f"f{i}", json.dumps({"eventId": f"e{i}"}) if i % 7 else "{", (0, 0, i, ""), None) for i in range(60)]
    parts = [spark.createDataFrame(rows[lo:hi], EVENT_SCHEMA).coalesce(1) for lo, hi in ((40, 60), (0, 15), (15, 40))]
    ordered = parts[0].unionByName(parts[1]).unionByName(parts[2])
    mixed = spark.createDataFrame(rows, EVENT_SCHEMA).repartition(3)
    assert in_ranges(ordered) and not in_ranges(mixed) and in_ranges(ordered.where("false"))
    found = []
    for name, events in (("a", ordered), ("b", mixed)):
        store = Store(str(tmp_path / name))
        heal_batch(events.where("ord.seq < 50"), 0, store)
        heal_batch(events.where("ord.seq >= 50"), 1, store)
        found.append([(r["id"], r["fallback_id"]) for r in store.raw(spark).orderBy("id").collect()])
    assert found[0] == found[1] == [(k, f"f{i}") for k, i in enumerate((i for i in range(60) if i % 7), 1)]
