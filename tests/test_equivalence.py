"""The parallel plan against one-by-one processing."""

import json
import random

import pytest
from sequential import START, Engine, frame, random_events

from contractflow.contract import default_contract
from contractflow.operators import bounded, extract, learning
from contractflow.operators.learning import lessons, replay, resolve_by_components, resolve_by_joins
from contractflow.operators.parse import parse_events
from contractflow.operators.policy import Policy, load_policy, save_policy
from contractflow.operators.registry import REGISTRY_SCHEMA, _checked, as_aliases
from contractflow.operators.shim import healed_view
from contractflow.plans.heal import alias_table, heal, judge
from contractflow.sources.identity import ORD_TYPE

CONTRACT = default_contract()


def expected(rows):
    engine = Engine()
    return engine, [engine.process(i, origin, obj) for i, (origin, obj) in enumerate(rows)]


def same(judged, want):
    got = judged.orderBy("ord").collect()
    assert len(got) == len(want)
    for row, (values, via, before, repairs, after) in zip(got, want):
        assert {k: v for k, v in row["values"].asDict().items() if v is not None} == values
        assert {k: v for k, v in row["resolved_via"].asDict().items() if v is not None} == via
        assert row["missing_before"] == before
        assert row["missing_required"] == after
        assert [(r["canonical"], r["outcome"], r["raw_key"], r["candidates"]) for r in row["repairs"]] == repairs


def learned_rows(spark, learned):
    table = alias_table(spark, learned).selectExpr("canonical", "raw_key", "learned_pos.seq as seq")
    return sorted((r["canonical"], r["raw_key"], r["seq"]) for r in table.collect())


def texts(rows):
    return [(origin, json.dumps(obj)) for origin, obj in rows]


@pytest.mark.parametrize("seed", range(4))
def test_one_batch(spark, seed):
    rows = random_events(random.Random(seed), 300)
    engine, want = expected(rows)
    events = parse_events(frame(spark, texts(rows)), CONTRACT)
    healed = heal(events, None, Policy(), CONTRACT)
    assert learned_rows(spark, healed.learned) == sorted(engine.learned)
    same(healed.judged, want)


@pytest.mark.parametrize("seed", [11, 12])
def test_micro_batches(spark, seed):
    rng = random.Random(seed)
    rows = random_events(rng, 240)
    engine, want = expected(rows)
    events = parse_events(frame(spark, texts(rows)), CONTRACT).cache()
    cuts = [0, *sorted(rng.sample(range(1, 240), 4)), 240]
    known, judged = [], []
    for lo, hi in zip(cuts, cuts[1:]):
        healed = heal(events.where(f"ord.seq >= {lo} and ord.seq < {hi}"), known, Policy(), CONTRACT)
        known = healed.aliases
        judged += healed.judged.orderBy("ord").collect()
    assert sorted((a.canonical, a.raw_key, a.pos[2]) for a in known if a.canonical != a.raw_key) == sorted(engine.learned)
    assert [r["missing_required"] for r in judged] == [w[4] for w in want]
    events.unpersist()


@pytest.mark.parametrize("seed", [21, 22])
def test_learning_by_joins(spark, seed):
    rows = random_events(random.Random(seed), 300)
    engine, _ = expected(rows)
    events = parse_events(frame(spark, texts(rows)), CONTRACT)
    first = lessons(events, as_aliases(None, CONTRACT), Policy(), CONTRACT)
    assert learned_rows(spark, resolve_by_joins(first)) == sorted(engine.learned)


def test_large_registry_and_large_policy_paths(spark, tmp_path, monkeypatch):
    """Nothing inlined, nothing broadcast: every lookup is a salted join."""
    rows = random_events(random.Random(31), 200)
    engine, want = expected(rows)
    events = parse_events(frame(spark, texts(rows)), CONTRACT)
    save_policy(spark, str(tmp_path), ["userId"], ["partner-feed", "internal-batch"])
    policy = load_policy(spark, str(tmp_path), limit=0)
    assert not isinstance(policy.trusted, tuple)
    for module in (bounded, extract):
        monkeypatch.setattr(module, "is_small", lambda *args: False)
    healed = heal(events, None, Policy(), CONTRACT)
    table = _checked(spark.createDataFrame(alias_table(spark, healed.learned).collect(), REGISTRY_SCHEMA), CONTRACT)
    same(judge(events, table, policy, CONTRACT), want)
    known = _checked(alias_table(spark, []), CONTRACT)
    again = lessons(events, known, policy, CONTRACT)
    assert learned_rows(spark, resolve_by_joins(again)) == sorted(engine.learned)


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_a_long_chain_in_few_rounds(spark, monkeypatch, order):
    """Key sets that share a key each with the next: replayed in tasks, in a number of steps that hardly grows."""
    rng, n = random.Random(1), 3000
    place = list(range(n))
    if order == "down":
        place.reverse()
    elif order == "mixed":
        rng.shuffle(place)
    rows = [("userId", [f"k{i}", f"k{i + 1}"], (0, 0, p, ""), START) for i, p in enumerate(place)]
    # sets of another component, at positions that others have too
    rows += [("trackId", [f"t{i}"], (0, 0, place[i], ""), START) for i in range(50)]
    first = spark.createDataFrame(rows, f"canonical string, keys array<string>, ord {ORD_TYPE}, at timestamp")
    tables, real = [], learning.cut_lineage
    monkeypatch.setattr(learning, "cut_lineage", lambda df: tables.append(1) or real(df))
    got = sorted((r["canonical"], r["raw_key"], r["learned_pos"]["seq"]) for r in resolve_by_components(first).collect())
    assert got == sorted((a.canonical, a.raw_key, a.pos[2]) for a in replay(rows))
    assert len(tables) < 60


@pytest.mark.parametrize("seed, limit", [(21, 1000), (22, 1)])
def test_learning_by_components(spark, seed, limit):
    """With a limit of one set per component, all larger ones go the way of the joins."""
    rows = random_events(random.Random(seed), 300)
    engine, _ = expected(rows)
    events = parse_events(frame(spark, texts(rows)), CONTRACT)
    first = lessons(events, as_aliases(None, CONTRACT), Policy(), CONTRACT)
    assert learned_rows(spark, resolve_by_components(first, limit)) == sorted(engine.learned)


def test_registry_sent_to_every_task(spark):
    """A registry too large to inline: hits, verdicts and the view as with one-by-one processing."""
    rows = random_events(random.Random(33), 200)
    engine, want = expected(rows)
    events = parse_events(frame(spark, texts(rows)), CONTRACT)
    learned = alias_table(spark, heal(events, None, Policy(), CONTRACT).learned)
    table = _checked(spark.createDataFrame(learned.collect(), REGISTRY_SCHEMA), CONTRACT)
    same(judge(events, table, Policy(), CONTRACT), want)
    raw = events.withColumn("id", events["ord.seq"])
    for safe in (True, False):
        views = [sorted(map(tuple, healed_view(raw, a, CONTRACT, safe).collect())) for a in (table, as_aliases(learned, CONTRACT))]
        assert views[0] == views[1]
