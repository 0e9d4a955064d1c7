"""Repeated positions, numbers rounded once, field order and damaged policies."""

import pytest

from contractflow.contract import ContractError, default_contract, load_contract, make_contract, save_contract
from contractflow.functions.json import rounded_bigint
from contractflow.operators.extract import extract_canonical
from contractflow.operators.metrics import METRIC_SCHEMA, read_user_metrics, upsert_metrics
from contractflow.operators.parse import parse_events
from contractflow.operators.policy import load_policy
from contractflow.operators.registry import REGISTRY_SCHEMA, alias_rows, as_aliases, load_registry
from contractflow.sources.envelope import from_envelope
from contractflow.sources.identity import ORD_TYPE
from contractflow.tables import read_version, write_version

CONTRACT = default_contract()


def test_events_that_share_a_position_keep_their_own_values(spark):
    bodies = ['{"user_id":"alice"}', '{"user_id":"bob"}', '{"other":1}', '{"user_id":"bob"}']
    sent = spark.createDataFrame(
        [(bytearray(b.encode()), "partner-feed", "q", 1) for b in bodies],
        "body binary, app_id string, queue string, delivery_tag bigint",
    )
    events = parse_events(from_envelope(sent), CONTRACT)
    learned = spark.createDataFrame([("userId", "user_id", (0, 0, 0, ""))], f"canonical string, raw_key string, learned_pos {ORD_TYPE}")
    found = []
    for aliases in (as_aliases(learned, CONTRACT), as_aliases(learned, CONTRACT, limit=0)):
        rows = extract_canonical(events, aliases, CONTRACT).collect()
        found.append(sorted(str(r["values"].get("userId")) for r in rows))
    assert found == [["None", "alice", "bob", "bob"]] * 2


def test_numbers_are_rounded_once(spark):
    texts = ["1000.49999999999", "0.49999999999", "-0.5", "-1.5000000001", "2.5", "1e3", "1.25e1", " 7.9 ", ".5", "x", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(f"{rounded_bigint('t')} as n").collect()
    assert [r["n"] for r in rows] == [1000, 0, -1, -2, 3, 1000, 13, 8, 1, None, None]


def test_field_order_survives_saving(spark, tmp_path):
    fields = [(n, True, n, "string", "", f"http://example.org/{n}", "") for n in ("zeta", "alpha")]
    contract = make_contract(fields, [], "Thing")
    save_contract(spark, contract, str(tmp_path / "c"))
    assert load_contract(spark, str(tmp_path / "c"), "Thing").names == contract.names


def test_damaged_policy_denies(spark, tmp_path):
    for name in ("protected_fields", "trusted_origins"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0.parquet").write_bytes(b"PAR1 this is no table PAR1")
    assert load_policy(spark, str(tmp_path)).deny_all


def test_newest_complete_version_is_read(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert read_version(spark, path, REGISTRY_SCHEMA) is None
    for version, key in ((3, "user_id"), (12, "userID")):
        write_version(alias_rows(spark, [("userId", key, (0, 0, version, ""), None, None)]), path, version)
    (tmp_path / "registry" / "version=40").mkdir()
    assert read_version(spark, path, REGISTRY_SCHEMA).first()["raw_key"] == "userID"
    assert read_version(spark, path, REGISTRY_SCHEMA, before=12).first()["raw_key"] == "user_id"
    assert read_version(spark, path, REGISTRY_SCHEMA, before=3) is None
    loaded = {r["raw_key"] for r in load_registry(spark, CONTRACT, path).collect()}
    assert loaded == {*CONTRACT.names, "userID"}


def test_one_users_metrics_follow_the_last_write(spark, tmp_path):
    path = str(tmp_path / "metrics")
    writes = [[("e1", "ann", 1), ("e2", "ann", 2), ("e3", "bob", 3)], [("e1", "bob", 4), ("e3", "ann", 5)]]
    for batch, rows in enumerate(writes):
        table = spark.createDataFrame([(e, u, bytearray([c]), None, (batch, 0, c, "")) for e, u, c in rows], METRIC_SCHEMA)
        upsert_metrics(table, path, batch)
    got = read_user_metrics(spark, path, "ann").collect()
    assert sorted((r["event_id"], bytes(r["ciphertext"])) for r in got) == [("e2", b"\x02"), ("e3", b"\x05")]


def test_roles_survive_saving(spark, tmp_path):
    save_contract(spark, CONTRACT, str(tmp_path / "c"))
    loaded = load_contract(spark, str(tmp_path / "c"))
    assert (loaded.event, loaded.owner, loaded.metric) == ("eventId", "userId", "msPlayed")
    with pytest.raises(ContractError):
        make_contract([("a", True, "a", "string", "E", "a", "")], [], "E", owner="b")
