"""Sessions of delivery tags: order of arrival across reconnects."""

import json
import random
from datetime import datetime, timedelta

import pytest
from sequential import Engine

from contractflow.sources.envelope import from_envelope
from contractflow.sources.sessions import with_sessions
from contractflow.streaming.loop import Store, heal_envelopes

START = datetime(2026, 1, 1)
SCHEMA = "body binary, app_id string, queue string, delivery_tag bigint, received_at timestamp"


def messages(rng, count, queues=3, restart=0.08):
    """(queue, session, tag, place in the order of arrival) with tags that restart now and then."""
    at = {q: (0, 0) for q in range(queues)}
    out = []
    for i in range(count):
        q = rng.choice([0, 0, 0, *range(queues)])
        session, tag = at[q]
        if tag and rng.random() < restart:
            session, tag = session + 1, 0
        at[q] = (session, tag + rng.choice([1, 1, 1, 3]))
        # a restart is seen if the new tag is not larger
        if at[q][1] > tag and session > 0 and tag == 0:
            at[q] = (session, 1)
        out.append((f"q{q}", *at[q], i))
    return out


def envelopes(spark, rows, body=lambda i: "{}", timed=True):
    data = [(bytearray(body(i).encode()), "partner-feed", q, t, START + timedelta(milliseconds=i)) for q, _, t, i in rows]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    return df if timed else df.drop("received_at")


@pytest.mark.parametrize("seed", range(3))
def test_sessions_over_batches(spark, seed):
    rng = random.Random(seed)
    rows = messages(rng, 400)
    state, got = None, {}
    for lo, hi in ((0, 130), (130, 131), (131, 290), (290, 400)):
        numbered, state = with_sessions(envelopes(spark, rows[lo:hi]), state)
        for r in numbered.collect():
            got[r["received_at"]] = (r["queue"], r["session"], r["delivery_tag"])
    assert [got[START + timedelta(milliseconds=i)] for *_, i in rows] == [r[:3] for r in rows]
    assert {(r["queue"], r["session"], r["tag"]) for r in state.collect()} == {max(r[:3] for r in rows if r[0] == q) for q in ("q0", "q1", "q2")}


def test_without_times_sessions_change_between_batches(spark):
    state, seen = None, []
    for tags in ([1, 2, 3], [4, 5], [1, 2], [2]):
        numbered, state = with_sessions(envelopes(spark, [("q", 0, t, 0) for t in tags], timed=False), state)
        seen.append({r["session"] for r in numbered.collect()})
    assert seen == [{0}, {0}, {1}, {2}]


def test_odd_messages(spark):
    rows = [(None, None, None, 1, START), (None, None, "q", None, START), (None, None, "q", 5, None), (None, None, "q", 2, START), (None, None, "q", 2, START)]
    numbered, state = with_sessions(spark.createDataFrame(rows, SCHEMA))
    assert [r["session"] for r in numbered.collect()] == [0] * 5
    assert [r["tag"] for r in state.collect() if r["queue"] == "q"] == [2]
    nothing, state = with_sessions(spark.createDataFrame([], SCHEMA), state)
    assert nothing.isEmpty() and state.count() >= 1


def test_position_holds_stream_and_session(spark):
    numbered, _ = with_sessions(envelopes(spark, [("q", 0, 3, 0), ("q", 1, 1, 1)]))
    rows = from_envelope(numbered, "s1").orderBy("ord").collect()
    assert [tuple(r["ord"]) for r in rows] == [(0, 0, 3, "s1/q"), (0, 1, 1, "s1/q")]
    assert [r["fallback_id"] for r in rows] == ["amqp-s1-0-3", "amqp-s1-1-1"]


def test_loop_learns_in_order_of_arrival(spark, tmp_path):
    """One queue whose tags restart: what is learned is what one-by-one processing in order of arrival learns."""
    rng = random.Random(6)
    rows = messages(rng, 90, queues=1, restart=0.2)
    objs = []
    for i in range(90):
        obj = {"eventId": f"e{i}", "trackId": "t", "timestamp": "2026-01-01T00:00:00", "msPlayed": 1}
        for k in rng.sample(["user_id", "USERID", "User-Id"], rng.randint(0, 2)):
            obj[k] = rng.choice(["a", "b"])
        objs.append(obj)
    engine = Engine(policy=False)
    for i, obj in enumerate(objs):
        engine.process(i, "partner-feed", obj)
    store = Store(str(tmp_path / "s"))
    for b, (lo, hi) in enumerate(((0, 30), (30, 31), (31, 90))):
        for _ in range(1 + b % 2):
            heal_envelopes(envelopes(spark, rows[lo:hi], lambda i: json.dumps(objs[i])), b, store)
    places = {(s, t): i for _, s, t, i in rows}
    got = [(r["canonical"], r["raw_key"], places[r["learned_pos"]["session"], r["learned_pos"]["seq"]]) for r in store.registry(spark).collect()]
    assert sorted(got) == sorted(engine.learned) and got


def numbered_one_by_one(rows):
    """The session of every message, by going through the queue's messages in their order."""
    known, out = {}, {}
    for at, tag in sorted({(a, t) for a, t in rows}, key=lambda r: (r[0], -1 if r[1] is None else r[1])):
        if tag is not None:
            if "tag" not in known:
                known = {"session": 0}
            elif tag < known["tag"] or (tag == known["tag"] and at > known["at"]):
                known["session"] += 1
            known |= {"tag": tag, "at": at}
        out[at, tag] = known.get("session", 0)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_sessions_with_copies_and_without_tags(spark, seed):
    """Repeated messages, and messages without a tag in between, over several ranges of one queue."""
    rng = random.Random(seed)
    rows = [(START + timedelta(seconds=rng.randrange(150)), rng.choice([None, 1, 1, 2, 3, 4])) for _ in range(400)]
    numbered, state = with_sessions(spark.createDataFrame([(None, None, "q", tag, at) for at, tag in rows], SCHEMA).repartition(4))
    got = numbered.collect()
    expected = numbered_one_by_one(rows)
    assert sorted((r["received_at"], str(r["delivery_tag"]), r["session"]) for r in got) == sorted((at, str(tag), expected[at, tag]) for at, tag in rows)
    assert [r["session"] for r in state.collect()] == [max(expected.values())]


def test_work_per_message_does_not_grow_with_sessions(spark):
    """No message carries the list of its queue's sessions."""
    numbered, _ = with_sessions(envelopes(spark, [("q", 0, 1, i) for i in range(50)]))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "starts" not in plan and "filter(" not in plan
    assert sorted(r["session"] for r in numbered.collect()) == list(range(50))
