"""Shapes of physical plans that must not get lost."""

import pytest

from contractflow.contract import default_contract
from contractflow.operators.learning import lessons
from contractflow.operators.parse import parse_events
from contractflow.operators.metrics import eligible_metrics, latest_per_event
from contractflow.operators.policy import Policy
from contractflow.operators.registry import as_aliases
from contractflow.operators.shim import healed_view
from contractflow.plans.heal import judge

CONTRACT = default_contract()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from sequential import frame

    path = str(tmp_path_factory.mktemp("plans"))
    parse_events(frame(spark, [("x", '{"eventId":"e"}')]), CONTRACT).write.parquet(f"{path}/slots")
    frame(spark, [("x", '{"eventId":"e"}')]).write.parquet(f"{path}/raw")
    return path


def test_a_payload_is_parsed_once_whatever_is_asked(spark, stored):
    events = parse_events(spark.read.parquet(f"{stored}/raw"), CONTRACT)
    judged = judge(events, as_aliases(None, CONTRACT), Policy(), CONTRACT)
    for df in (judged, judged.where("conforms and values.userId = 'u1'"), eligible_metrics(judged)):
        assert plan(df).count("parseJson") == 1


def test_stored_events_are_judged_without_payload_parse_shuffle_or_python(spark, stored):
    events = spark.read.parquet(f"{stored}/slots")
    text = plan(judge(events, as_aliases(None, CONTRACT), Policy(), CONTRACT))
    for absent in ("parseJson", "Exchange", "Python", "payload"):
        assert absent not in text


def nodes(df) -> list[str]:
    """Names of the operators that the rows pass; subqueries, which run once, are not among them."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        at = todo.pop()
        if at.nodeName() == "AdaptiveSparkPlan":
            at = at.executedPlan()
        found.append(at.nodeName())
        todo += [at.children().apply(i) for i in range(at.children().size())]
    return found


def test_events_do_not_move_for_a_large_registry(spark, stored):
    """50,000 spellings are known: events are judged and read where they are."""
    spellings = spark.range(50_000).selectExpr(
        "'userId' as canonical", "concat('user', repeat('_', cast(id + 1 as int) % 1000), 'i', repeat('-', cast(id div 1000 as int)), 'd') as raw_key",
        "named_struct('batch', 0L, 'session', 0L, 'seq', id, 'tie', '') as learned_pos",
    )
    spellings.write.parquet(f"{stored}/spellings")
    table = as_aliases(spark.read.parquet(f"{stored}/spellings"), CONTRACT)
    assert not isinstance(table, list)
    events = spark.read.parquet(f"{stored}/slots")
    for df in (judge(events, table, Policy(), CONTRACT), healed_view(events.withColumnRenamed("fallback_id", "id"), table, CONTRACT)):
        df.collect()
        assert not [n for n in nodes(df) if "Exchange" in n or "Join" in n or "Sort" in n]


def test_view_prunes_columns_and_needs_no_shuffle(spark, stored):
    raw = spark.read.parquet(f"{stored}/slots").withColumnRenamed("fallback_id", "id")
    view = healed_view(raw, as_aliases(None, CONTRACT), CONTRACT)
    assert "Exchange" not in plan(view)
    assert "payload" not in plan(view)


def test_lessons_and_last_writes_are_reduced_before_the_shuffle(spark, stored):
    events = spark.read.parquet(f"{stored}/slots")
    for df in (
        lessons(events, as_aliases(None, CONTRACT), Policy(), CONTRACT),
        latest_per_event(eligible_metrics(judge(events, as_aliases(None, CONTRACT), None, CONTRACT))),
    ):
        text = plan(df)
        assert text.count("Exchange hashpartitioning") == 1
        assert "partial_m" in text[text.index("Exchange"):]
