"""Fields that share a normal form: the parallel plan against one-by-one processing."""

import json
import random

import pytest
from sequential import Engine, frame
from test_equivalence import learned_rows, same, texts

from contractflow.contract import ContractError, make_contract
from contractflow.operators import shared_forms
from contractflow.operators.parse import parse_events
from contractflow.operators.policy import Policy
from contractflow.operators.registry import _checked, as_aliases
from contractflow.plans.heal import alias_table, heal, judge

FIELDS = [("fooId", True), ("foo_Id", True), ("FOO-ID", False), ("foo.ID", True), ("bar", True), ("b.ar", True), ("lone", True)]
CONTRACT = make_contract([(n, r, f"c{i}", "string", "Thing", n) for i, (n, r) in enumerate(FIELDS)], [], "Thing")
PROTECTED = ("foo_Id", "bar")
POLICY = Policy(PROTECTED)
SPELLINGS = ["fooId", "foo_Id", "FOO-ID", "foo.ID", "foo_id", "fooid", "FooId", "foo-id"]


def trace(rng, count):
    """Few spellings, many conflicts, so that lessons depend on earlier lessons."""
    rows = []
    for _ in range(count):
        obj = {}
        for keys in (SPELLINGS, ["bar", "b.ar", "BAR", "b_ar"], ["lone", "Lone"]):
            base = rng.choice(["a", "b", 7, None, {"z": 1}])
            for k in rng.sample(keys, rng.randint(0, min(4, len(keys)))):
                obj[k] = base if rng.random() < 0.6 else rng.choice(["a", "c", 7, True, None, {"z": 2}])
        rows.append((rng.choice(["partner-feed", "untrusted-source"]), obj))
    return rows


def sequential(rows):
    engine = Engine(fields=[n for n, _ in FIELDS], required=[n for n, r in FIELDS if r], protected=PROTECTED)
    return engine, [engine.process(i, origin, obj) for i, (origin, obj) in enumerate(rows)]


@pytest.mark.parametrize("seed", range(4))
def test_random_traces(spark, seed):
    rows = trace(random.Random(seed), 300)
    engine, want = sequential(rows)
    healed = heal(parse_events(frame(spark, texts(rows)), CONTRACT), None, POLICY, CONTRACT)
    assert learned_rows(spark, healed.learned) == sorted(engine.learned)
    assert {f for f, _, _ in engine.learned} >= {"fooId", "foo_Id", "bar"}
    same(healed.judged, want)


def test_repeated_shape_teaches_after_another_lesson(spark):
    """The first copy is ambiguous for both fields; once one of them knows a key, the second copy teaches the other."""
    two = {"foo_id": "x", "fooid": "y", "foo.ID": "z", "bar": 1, "b.ar": 1, "lone": 1}
    rows = [("partner-feed", o) for o in (two, two, {k: v for k, v in two.items() if k != "fooid"}, two, two)]
    engine, want = sequential(rows)
    assert engine.learned == [("fooId", "foo_id", 2), ("foo_Id", "fooid", 3)]
    healed = heal(parse_events(frame(spark, texts(rows)), CONTRACT), None, POLICY, CONTRACT)
    assert learned_rows(spark, healed.learned) == sorted(engine.learned)
    same(healed.judged, want)


def test_claimed_keys(spark):
    """One key for two fields goes to the first, also when the policy refuses it."""
    rows = [("untrusted-source", {"b_ar": "v"}), ("partner-feed", {"b_ar": "v"})]
    healed = heal(parse_events(frame(spark, texts(rows)), CONTRACT), None, POLICY, CONTRACT)
    first, second = [
        [(x["canonical"], x["outcome"]) for x in r["repairs"] if x["canonical"] in ("bar", "b.ar")] for r in healed.judged.orderBy("ord").collect()
    ]
    assert first == [("bar", "denied"), ("b.ar", "none")]
    assert second == [("bar", "healed"), ("b.ar", "none")]


def test_micro_batches_and_spans(spark, monkeypatch):
    """Batches that go on from each other's aliases, each cut into spans of few shapes."""
    rows = trace(random.Random(9), 240)
    engine, want = sequential(rows)
    events = parse_events(frame(spark, texts(rows)), CONTRACT).cache()
    halved, real = [], shared_forms.halves
    monkeypatch.setattr(shared_forms, "halves", lambda span: halved.append(1) or real(span))
    known, judged = [], []
    for lo, hi in ((0, 70), (70, 150), (150, 240)):
        healed = heal(events.where(f"ord.seq >= {lo} and ord.seq < {hi}"), known, POLICY, CONTRACT, replay_limit=25)
        known = as_aliases(alias_table(spark, healed.aliases), CONTRACT)
        judged += healed.judged.orderBy("ord").collect()
    assert halved
    assert sorted((a.canonical, a.raw_key, a.pos[2]) for a in known if a.canonical != a.raw_key) == sorted(engine.learned)
    assert [r["missing_required"] for r in judged] == [w[4] for w in want]
    events.unpersist()


def test_large_registry(spark):
    """Known aliases as a table: only the keys that occur are read."""
    rows = trace(random.Random(4), 200)
    engine, want = sequential(rows)
    events = parse_events(frame(spark, texts(rows)), CONTRACT)
    half = heal(events.where("ord.seq < 100"), None, POLICY, CONTRACT)
    table = _checked(alias_table(spark, half.aliases), CONTRACT)
    rest = heal(events.where("ord.seq >= 100"), table, POLICY, CONTRACT)
    assert sorted(learned_rows(spark, half.learned) + learned_rows(spark, rest.learned)) == sorted(engine.learned)
    same(judge(events, _checked(alias_table(spark, rest.aliases), CONTRACT), POLICY, CONTRACT), want)


def test_field_names_must_differ():
    for other in ("a", "A"):
        with pytest.raises(ContractError):
            make_contract([("a", True, "a", "string", "T", "a"), (other, True, "b", "string", "T", "a")], [], "T")
    assert json.dumps(CONTRACT.shared_forms) == '{"fooid": ["fooId", "foo_Id", "FOO-ID", "foo.ID"], "bar": ["bar", "b.ar"]}'
