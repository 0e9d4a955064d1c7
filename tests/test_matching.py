"""Single-event scenarios: naming variants, ambiguity, several fields, policy."""

import json

import pytest
from sequential import frame

from contractflow.contract import ContractError, default_contract, make_contract
from contractflow.operators.discover import agreeing, unclaimed
from contractflow.operators.parse import parse_events
from contractflow.operators.policy import Policy
from contractflow.operators.registry import Alias, as_aliases
from contractflow.plans.heal import heal, judge

CONTRACT = default_contract()
BASE = {"eventId": "e", "userId": "u1", "trackId": "t1", "timestamp": "2026-01-01T00:00:00"}


def event(**changes):
    obj = {k: v for k, v in BASE.items() if k not in changes.pop("drop", ())}
    return json.dumps(obj | changes)


def renamed(key, field="userId", value="u9"):
    obj = dict(BASE)
    del obj[field]
    return json.dumps(obj | {key: value})


# name: (payload, expected repairs as (field, outcome, raw key))
CASES = {
    "A1": (renamed("user_id"), [("userId", "healed", "user_id")]),
    "A2a": (renamed("USERID"), [("userId", "healed", "USERID")]),
    "A2b": (renamed("UserID"), [("userId", "healed", "UserID")]),
    "A2c": (renamed("userID"), [("userId", "healed", "userID")]),
    "A3a": (renamed("user-id"), [("userId", "healed", "user-id")]),
    "A3b": (renamed("User.Id"), [("userId", "healed", "User.Id")]),
    "A3c": (renamed("USER_ID"), [("userId", "healed", "USER_ID")]),
    "A4a": (renamed("uid"), [("userId", "none", None)]),
    "A4b": (renamed("usr_id"), [("userId", "none", None)]),
    "B1": ('{"eventId":"e","trackId":"t","timestamp":"x","user_id":"ada","userID":"ada"}', [("userId", "healed", "userID")]),
    "B2": ('{"eventId":"e","trackId":"t","timestamp":"x","user_id":"ada","userID":"bob"}', [("userId", "ambiguous", None)]),
    "C1": ('{"eventId":"e","user_id":"u","track_id":"t","timestamp":"x"}', [("userId", "healed", "user_id"), ("trackId", "healed", "track_id")]),
    "C2": (
        '{"event_id":"e","user_id":"u","track_id":"t","ts":"x"}',
        [("eventId", "healed", "event_id"), ("userId", "healed", "user_id"), ("trackId", "healed", "track_id"), ("timestamp", "none", None)],
    ),
    "C3": ('{"eventId":"e","user_id":"u","timestamp":"x"}', [("userId", "healed", "user_id"), ("trackId", "none", None)]),
    "X1": (event(debugFlag=True, requestId="r", nested={"userId": "no"}), []),
    "null-and-rename": (event(userId=None, user_id="u1"), [("userId", "ambiguous", None)]),
    "lone-nested": (renamed("user_id", value={"id": 1}), [("userId", "healed", "user_id")]),
    "both-null": (event(userId=None, user_id=None), [("userId", "healed", "userId")]),
    "array": ("[1]", [(f, "none", None) for f in ("eventId", "userId", "trackId", "timestamp")]),
    "text": ('"x"', [(f, "none", None) for f in ("eventId", "userId", "trackId", "timestamp")]),
    "null": ("null", [(f, "none", None) for f in ("eventId", "userId", "trackId", "timestamp")]),
}


def test_each_scenario_on_its_own(spark):
    events = parse_events(frame(spark, [("partner-feed", p) for p, _ in CASES.values()]), CONTRACT)
    rows = judge(events, as_aliases(None, CONTRACT), Policy(), CONTRACT).orderBy("ord").collect()
    for name, row in zip(CASES, rows, strict=True):
        got = [(r["canonical"], r["outcome"], r["raw_key"]) for r in row["repairs"]]
        assert got == CASES[name][1], name


def test_canonical_key_beats_learned_decoy(spark):
    aliases = as_aliases([Alias("userId", "user_id", (0, 0, -1, ""))], CONTRACT)
    events = parse_events(frame(spark, [("x", event(user_id="STALE"))]), CONTRACT)
    row = judge(events, aliases, None, CONTRACT).first()
    assert (row["values"]["userId"], row["resolved_via"]["userId"]) == ("u1", "userId")


def test_duplicate_keys_last_wins(spark):
    events = parse_events(frame(spark, [("x", '{"userId":"first","userId":"second"}')]), CONTRACT)
    assert judge(events, as_aliases(None, CONTRACT), None, CONTRACT).first()["values"]["userId"] == "second"


@pytest.mark.parametrize(
    "origin,key,field,policy,outcome",
    [
        ("untrusted-source", "user_id", "userId", Policy(), "denied"),
        ("partner-feed", "user_id", "userId", Policy(), "healed"),
        ("untrusted-source", "track_id", "trackId", Policy(), "healed"),
        ("partner-feed", "track_id", "trackId", Policy(deny_all=True), "denied"),
        ("untrusted-source", "user_id", "userId", None, "healed"),
    ],
)
def test_policy(spark, origin, key, field, policy, outcome):
    events = parse_events(frame(spark, [(origin, renamed(key, field))]), CONTRACT)
    healed = heal(events, None, policy, CONTRACT)
    row = healed.judged.first()
    assert [r["outcome"] for r in row["repairs"]] == [outcome]
    assert (row["values"][field] == "u9") == (outcome == "healed")
    assert [(a.canonical, a.raw_key) for a in healed.learned] == ([(field, key)] if outcome == "healed" else [])


def test_denied_source_benefits_from_a_trusted_lesson(spark):
    rows = [("untrusted-source", renamed("user_id")), ("partner-feed", renamed("user_id")), ("untrusted-source", renamed("user_id"))]
    judged = heal(parse_events(frame(spark, rows), CONTRACT), None, Policy(), CONTRACT).judged.orderBy("ord").collect()
    assert [r["conforms"] for r in judged] == [False, True, True]
    assert [len(r["missing_before"]) for r in judged] == [1, 1, 0]


def test_claimed_keys_do_not_take_part(spark):
    others = "array(named_struct('key', 'fooid', 'text', 'x', 'scalar', true))"
    row = spark.sql(
        f"select size({unclaimed(others, 'array(\"fooid\")')}) as n, {agreeing(others)} as agree"
    ).first()
    assert (row["n"], row["agree"]) == (0, True)
    twins = make_contract(
        [("fooId", True, "a", "string", "E", "a", ""), ("foo_Id", True, "b", "string", "E", "b", "")], [], "E"
    )
    events = parse_events(frame(spark, [("x", '{"fooid":"shared"}')]), twins)
    repairs = heal(events, None, None, twins).judged.first()["repairs"]
    assert [(r["canonical"], r["outcome"], r["raw_key"]) for r in repairs] == [("fooId", "healed", "fooid"), ("foo_Id", "none", None)]


def test_foreign_aliases_are_refused(spark):
    with pytest.raises(ContractError):
        as_aliases([Alias("userId", "uid", (0, 0, 0, ""))], CONTRACT)
