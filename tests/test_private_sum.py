import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from sequential import frame

from contractflow.contract import default_contract
from contractflow.functions import crypto
from contractflow.functions.crypto import MODULUS, encrypt_metric, from_text, generate_keys, reveal, to_text
from contractflow.operators import metrics, private_sum
from contractflow.operators.parse import parse_events
from contractflow.plans.heal import heal

CONTRACT = default_contract()
KEY, SECRET = generate_keys(512)


def test_round_trip_range_and_text_form(spark):
    values = [0, 1, 180000, MODULUS - 1, MODULUS, -1, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v bigint").coalesce(1)
    sealed = df.select("i", encrypt_metric(F.col("v"), KEY).alias("c")).select("i", to_text(F.col("c")).alias("t"))
    rows = sealed.select("i", reveal(from_text(F.col("t")), SECRET).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [0, 1, 180000, MODULUS - 1, None, None, None]


def test_equal_values_have_different_ciphertexts(spark):
    df = spark.range(20).select(encrypt_metric(F.lit(7).cast("bigint"), KEY).alias("c"))
    assert len({bytes(r["c"]) for r in df.collect()}) == 20


def test_totals_of_many_groups_with_one_hot_group(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 600, 1, 5).selectExpr("if(id % 3 = 0, 'hot', concat('u', id % 40)) as user_id", "id * 1000003 % 99999999 as v")
        sealed = df.select("user_id", "v", encrypt_metric(F.col("v"), KEY).alias("ciphertext"))
        got = {r["user_id"]: (r["n"], r["total"]) for r in private_sum.user_totals(sealed, KEY, SECRET).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {
        r["user_id"]: (r["n"], r["total"] % MODULUS)
        for r in df.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("v").alias("total")).collect()
    }
    assert got == want


def test_three_events_of_one_user(spark):
    payloads = [
        json.dumps({"eventId": f"e{i}", "userId": "u", "trackId": "t", "timestamp": "2026-01-01T00:00:00", "msPlayed": ms})
        for i, ms in enumerate([180000, 210000, 195000])
    ]
    events = parse_events(frame(spark, [("x", p) for p in payloads]), CONTRACT)
    rows = metrics.encrypt_metrics(metrics.eligible_metrics(heal(events, None, None, CONTRACT).judged), KEY)
    assert [tuple(r) for r in private_sum.user_total(rows, "u", KEY, SECRET).collect()] == [("u", 3, 585000)]
    assert private_sum.user_total(rows, "nobody", KEY, SECRET).count() == 0
    assert [r["event_id"] for r in metrics.ciphertexts_for_user(rows, "u").collect()] == ["e0", "e1", "e2"]


def test_which_events_carry_a_metric(spark):
    cases = {
        '{"userId":"u","msPlayed":5}': 5, '{"userId":"u","msPlayed":"+5"}': 5, '{"userId":"u","msPlayed":"-0"}': 0,
        '{"userId":"u","msPlayed":-1}': None, '{"userId":"u","msPlayed":1000.5}': None, '{"userId":"u","msPlayed":1.0}': None,
        '{"userId":"u","msPlayed":" 5"}': None, '{"userId":"u","msPlayed":"5\\n"}': None, '{"msPlayed":5}': None,
        '{"userId":"u","msPlayed":"99999999999999999999"}': None, '{"userId":"","msPlayed":7}': 7,
    }
    events = parse_events(frame(spark, [("x", p) for p in cases]), CONTRACT)
    rows = metrics.eligible_metrics(heal(events, None, None, CONTRACT).judged).collect()
    assert {r["ord"]["seq"]: r["ms_played"] for r in rows} == {
        i: v for i, v in enumerate(cases.values()) if v is not None
    }
    assert all(r["event_id"].startswith("fallback-") for r in rows)


def test_last_write_wins(spark, tmp_path):
    now = datetime(2026, 1, 1)

    def batch(rows):
        return spark.createDataFrame([(e, u, bytearray([v]), now, (0, 0, o, "")) for e, u, v, o in rows], metrics.METRIC_SCHEMA)

    path = str(tmp_path / "metrics")
    metrics.upsert_metrics(batch([("a", "u", 1, 1), ("b", "u", 2, 2), ("a", "u", 3, 3)]), path, 0)
    metrics.upsert_metrics(batch([("b", "v", 4, 4)]), path, 1)
    metrics.upsert_metrics(batch([("b", "v", 5, 5)]), path, 1)
    got = sorted((r["event_id"], r["user_id"], r["ciphertext"][0]) for r in metrics.read_metrics(spark, path).collect())
    assert got == [("a", "u", 3), ("b", "v", 5)]


def test_disabled_encryption(spark):
    events = parse_events(frame(spark, [("x", '{"userId":"u","msPlayed":5}')]), CONTRACT)
    rows = metrics.encrypt_metrics(metrics.eligible_metrics(heal(events, None, None, CONTRACT).judged), None)
    assert rows.count() == 0
    with pytest.raises(private_sum.EncryptionDisabled):
        private_sum.encrypted_sum(rows, ["user_id"], None)


def test_batches_of_ciphertexts():
    """Many rows at once give what one-by-one arithmetic gives, for keys of several sizes."""
    for key, secret in ((KEY, SECRET), generate_keys(64, 32)):
        values = [(i * 7919) % MODULUS for i in range(300)] + [0, MODULUS - 1]
        ciphertexts = crypto.encryptor(key).encrypt(values)
        assert len(set(ciphertexts)) == len(values)
        assert crypto._decrypt(ciphertexts, secret) == values
        assert crypto._decrypt(ciphertexts[-2:], secret) == values[-2:]
        square = key.n * key.n
        numbers = [int.from_bytes(c, "big") for c in ciphertexts]
        assert all(c * i % square == 1 for c, i in zip(numbers, crypto._inverses(numbers, square)))
        assert crypto.arithmetic(square).power(numbers[:9], 12345) == [pow(c, 12345, square) for c in numbers[:9]]


WIDE, WIDE_SECRET = generate_keys(1024)


def _product(ciphertexts, key):
    x = 1
    for c in ciphertexts:
        x = x * int.from_bytes(c, "big") % (key.n * key.n)
    return x


def test_totals_are_decrypted_together(monkeypatch):
    """Three totals share an exponentiation; negative ones and bytes that are no total do not disturb their neighbours."""
    values = [(i * 7919) % MODULUS for i in range(40)]
    ciphertexts = crypto.encryptor(WIDE).encrypt(values + [2**63 - 1, 0])
    negative = [x.to_bytes(WIDE.width, "big") for x in crypto._inverses([int.from_bytes(c, "big") for c in ciphertexts[-2:-1]], WIDE.n**2)]
    mixed = [*ciphertexts, b"\xff" * WIDE.width, *negative, bytes(WIDE.width), *ciphertexts[:5]]
    assert crypto._decrypt(mixed, WIDE_SECRET) == crypto._decrypt_whole(mixed, WIDE_SECRET)
    assert crypto._decrypt(mixed[:2], WIDE_SECRET) == values[:2] and crypto._decrypt([], WIDE_SECRET) == []
    rows = []
    powered = crypto.arithmetic(WIDE_SECRET.p**2).powered
    monkeypatch.setattr(crypto.arithmetic(WIDE_SECRET.p**2), "powered", lambda x, *args: rows.append(x[0].shape[1]) or powered(x, *args))
    assert crypto._decrypt(ciphertexts[:36], WIDE_SECRET) == values[:36] and sum(rows) == 12


def test_groups_are_multiplied_at_once(monkeypatch):
    """Runs of all lengths, also ones cut by the step, one ciphertext without its leading zeros and one beyond the modulus."""
    monkeypatch.setattr(crypto, "STEP", 16)
    for key, secret in ((KEY, SECRET), generate_keys(66, 32)):
        ciphertexts = crypto.encryptor(key).encrypt([(i * 104729) % 1000 for i in range(150)])
        odd = [b"\x07", b"\x00" + b"\xff" * (key.width + 3)]
        cuts = [0, 1, 2, 4, 7, 12, 12, 45, 46, 150]
        groups = [ciphertexts[a:b] for a, b in zip(cuts, cuts[1:])] + [[ciphertexts[0], *odd, *ciphertexts[:6]], odd[:1], odd]
        assert crypto.combine(groups, key) == [_product(g, key) for g in groups]


def test_a_users_rows_are_encrypted_together_and_a_hot_user_is_cut(spark):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(0, 1200, 1, 6).selectExpr(
        "concat('e', id * 7919 % 1200) as event_id", "if(id % 2 = 0, 'hot', concat('u', id % 60)) as user_id", "id as ms_played",
        "named_struct('batch', 0L, 'session', 0L, 'seq', id, 'tie', '') as ord", "timestamp'2026-01-01' as received_at",
    )
    made = metrics.encrypt_metrics(rows, KEY).select("user_id", F.spark_partition_id().alias("part")).groupBy("user_id").agg(F.countDistinct("part").alias("parts"))
    parts = {r["user_id"]: r["parts"] for r in made.collect()}
    # neighbours in the order of users share at most the task in which one range ends
    assert parts.pop("hot") >= tasks / 2 and sum(parts.values()) <= len(parts) + tasks
    got = {r["user_id"]: (r["n"], r["total"]) for r in private_sum.user_totals(metrics.encrypt_metrics(rows, KEY), KEY, SECRET).collect()}
    want = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("ms_played").alias("total")).collect()
    assert got == {r["user_id"]: (r["n"], r["total"]) for r in want}


def test_products_of_pairs_stay_exact_over_long_chains():
    """Extreme numbers, many products in a row, for moduli of several sizes."""
    for n in ((1 << 2048) - 1942289, (1 << 61) - 1, 3**700, (1 << 3072) - 1103717):
        m = n * n
        numbers = crypto.arithmetic(m)
        some = [0, 1, 2, m - 1, m - 2, n, n + 1, n - 1, m - n, m // 3]
        assert numbers.numbers(numbers.left(some)) == some
        assert numbers.power(some, (1 << 200) - 1) == [pow(x, (1 << 200) - 1, m) for x in some]
