"""The query catalogue: every operator as a query over the given tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.contract import Contract, default_contract, load_contract, make_contract, save_contract
from contractflow.functions import json as J
from contractflow.functions import text as T
from contractflow.functions.crypto import MODULUS, PublicKey, SecretKey, from_text, generate_keys, reveal, to_text
from contractflow.operators import checks, decisions, discover, extract, graph, kept_totals, metrics, parse, policy
from contractflow.operators import private_sum, raw_log, registry, shim
from contractflow.operators.bounded import over_all_tasks
from contractflow.plans.derived_events import derived_events
from contractflow.plans.heal import Healed, alias_table, heal, used_pairs
from contractflow.sources.envelope import from_envelope
from contractflow.sources.files import stream_event_files
from contractflow.sources.sessions import with_sessions
from contractflow.storage import checkpoint_dir, cut_lineage, ship_package
from contractflow.streaming.loop import Store, heal_batch, heal_envelopes, run_stream

CONTRACT = default_contract()
POLICY = policy.Policy()

Query = Callable[[SparkSession, str], DataFrame]


def _n() -> Column:
    return F.col("ord.seq").alias("n")


@functools.cache
def demo_keys() -> tuple[PublicKey, SecretKey]:
    """One key pair per process, as the keys of the catalogue's metrics."""
    return generate_keys()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_events(derived_events(spark, sf_dir), CONTRACT)


def stored_events(spark: SparkSession, sf_dir: str, payload: bool = False) -> DataFrame:
    """Parsed events as a stored table: learning and judging read them one after the other, and
    reading slots again is far cheaper than parsing payloads again."""
    events = parsed_events(spark, sf_dir)
    return cut_lineage(events if payload else events.drop("payload"))


def healed_events(spark: SparkSession, sf_dir: str) -> Healed:
    return heal(stored_events(spark, sf_dir), None, POLICY, CONTRACT)


def _joined(keys: Column) -> Column:
    return F.array_join(keys, ",")


# ---- extraction ---------------------------------------------------------------------------------


def canonical_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.extract_canonical(parsed_events(spark, sf_dir), registry.as_aliases(None, CONTRACT), CONTRACT)
    return out.select(
        _n(), *[F.try_element_at("values", F.lit(f.name)).alias(f.view_column) for f in CONTRACT.fields]
    )


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stored_events(spark, sf_dir, payload=True)
    return extract.extract_canonical(events, heal(events, None, POLICY, CONTRACT).aliases, CONTRACT, timeless=False)


def resolved_via(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select(
        _n(), *[F.try_element_at("resolved_via", F.lit(f.name)).alias(f"{f.view_column}_via") for f in CONTRACT.fields]
    )


def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return healed_events(spark, sf_dir).judged.select(
        _n(),
        _joined(F.col("missing_before")).alias("missing_before"),
        _joined(F.col("missing_required")).alias("missing_after"),
    )


def used_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = F.array_except(F.expr(J.object_keys("payload")), F.col("used_raw_keys"))
    return _extracted(spark, sf_dir).select(
        _n(),
        _joined(F.sort_array("used_raw_keys")).alias("used"),
        _joined(F.sort_array(free)).alias("unused"),
    )


def normalized_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = parsed_events(spark, sf_dir).select(F.explode(F.expr(J.object_keys("payload"))).alias("raw_key"))
    forms = F.create_map(*[F.lit(x) for name, norm in CONTRACT.normal_forms.items() for x in (norm, name)])
    counted = keys.groupBy("raw_key").agg(F.count("*").alias("n"))
    norm = F.expr(T.normalize_key("raw_key"))
    return counted.select("raw_key", norm.alias("norm"), F.try_element_at(forms, norm).alias("canonical"), "n")


# ---- discovery, policy, learning ----------------------------------------------------------------


def matching_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key that takes part in extraction or discovery."""
    keys = discover.event_keys(parsed_events(spark, sf_dir), CONTRACT)
    return keys.select(_n(), "canonical", "raw_key", "text", "scalar")


def rename_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discover.rename_candidates(parsed_events(spark, sf_dir), registry.as_aliases(None, CONTRACT), CONTRACT)
    return found.select(_n(), "canonical", "outcome", "raw_key", _joined(F.col("candidates")).alias("candidates"))


def ambiguous_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    repairs = healed_events(spark, sf_dir).judged.select(_n(), F.inline("repairs"))
    return repairs.where(F.col("outcome") == discover.AMBIGUOUS).select(
        "n", "canonical", _joined(F.col("candidates")).alias("candidates")
    )


def _candidates_at_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stored_events(spark, sf_dir)
    aliases = heal(events, None, POLICY, CONTRACT).aliases
    found = discover.rename_candidates(events, aliases, CONTRACT, timeless=False)
    return found.where(F.col("outcome") == discover.UNIQUE)


def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = policy.policy_gate(_candidates_at_arrival(spark, sf_dir), POLICY)
    return gated.select(_n(), "origin", "canonical", "raw_key", "allow")


def policy_disabled_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discover.rename_candidates(parsed_events(spark, sf_dir), registry.as_aliases(None, CONTRACT), CONTRACT).where(F.col("outcome") == discover.UNIQUE)
    return policy.policy_gate(found, None).groupBy("origin", "canonical", "raw_key", "allow").agg(F.count("*").alias("n"))


def policy_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions under a policy that was saved and loaded."""
    path = _folder(spark, "policy")
    policy.save_policy(spark, path, list(POLICY.protected), list(POLICY.trusted))
    gated = policy.policy_gate(_candidates_at_arrival(spark, sf_dir), policy.load_policy(spark, path))
    return gated.select(_n(), "origin", "canonical", "raw_key", "allow")


def policy_unreadable_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a readable policy nobody may teach."""
    nowhere = policy.load_policy(spark, _folder(spark, "no-policy"))
    found = discover.rename_candidates(parsed_events(spark, sf_dir), registry.as_aliases(None, CONTRACT), CONTRACT).where(F.col("outcome") == discover.UNIQUE)
    return policy.policy_gate(found, nowhere).groupBy("origin", "canonical", "raw_key", "allow").agg(F.count("*").alias("n"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    healed = healed_events(spark, sf_dir)
    table, _ = registry.learn(registry.default_registry(spark, CONTRACT), alias_table(spark, healed.learned))
    return registry.touch(table, cut_lineage(used_pairs(healed.judged, CONTRACT)))


def learned_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    healed = healed_events(spark, sf_dir)
    return alias_table(spark, healed.learned).select(
        "canonical", "raw_key", F.col("learned_pos.seq").alias("learned_from"), "learned_at"
    )


def learned_aliases_without_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    healed = heal(stored_events(spark, sf_dir), None, None, CONTRACT)
    return alias_table(spark, healed.learned).select(
        "canonical", "raw_key", F.col("learned_pos.seq").alias("learned_from")
    )


def learned_aliases_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result through the path for very many key spellings."""
    healed = heal(stored_events(spark, sf_dir), None, POLICY, CONTRACT, replay_limit=0)
    return alias_table(spark, healed.learned).select(
        "canonical", "raw_key", F.col("learned_pos.seq").alias("learned_from"), "learned_at"
    )


def registry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = alias_table(spark, healed_events(spark, sf_dir).learned)
    merged = registry.merge_registries(registry.default_registry(spark, CONTRACT), learned, learned)
    return merged.select("canonical", "raw_key", (F.col("canonical") == F.col("raw_key")).alias("is_default"))


def alias_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.alias_audit(_registry(spark, sf_dir))


def stale_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases not used during the last second before the newest use of any."""
    table = cut_lineage(_registry(spark, sf_dir))
    newest = table.agg(F.max("last_used_at").alias("at")).first()["at"]
    return registry.stale_aliases(table, F.lit(newest).cast("timestamp"), timedelta(seconds=1))


# ---- healed view --------------------------------------------------------------------------------


def _raw_with_id(spark: SparkSession, sf_dir: str, payload: bool = False) -> DataFrame:
    return stored_events(spark, sf_dir, payload).withColumn("id", F.col("ord.seq"))


def _view(spark: SparkSession, sf_dir: str, safe_keys_only: bool = True) -> DataFrame:
    raw = _raw_with_id(spark, sf_dir)
    return shim.healed_view(raw, heal(raw, None, POLICY, CONTRACT).aliases, CONTRACT, safe_keys_only)


def healed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir)


def healed_view_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, safe_keys_only=False)


def healed_view_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as plain COALESCE expressions over the payload text."""
    raw = _raw_with_id(spark, sf_dir, payload=True)
    keys = registry.alias_map(heal(raw, None, POLICY, CONTRACT).aliases)
    columns = [
        f"{shim.coalesce_aliases(keys[f.name], f.view_type == 'bigint')} as {f.view_column}" for f in CONTRACT.fields
    ]
    return raw.selectExpr("id", "source", "received_at", *columns)


def healed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shim.lookup_event(_view(spark, sf_dir), "evt-24").select(
        "user_id", "track_id", "event_timestamp", "ms_played"
    )


def indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events found through the index of the log, under canonical and learned spellings; one is broken, one is not there."""
    store = Store(_folder(spark, "indexed"), policy=POLICY)
    events = derived_events(spark, sf_dir)
    for batch in (0, 1):
        heal_batch(events.where(f"ord.seq % 34 {'<' if batch else '>='} 17"), batch, store)
    found = [store.lookup(spark, e) for e in ("evt-24", "evt-7", "evt-21", "evt-16", "nobody")]
    return functools.reduce(DataFrame.unionByName, found).select("event_id", "user_id", "track_id", "event_timestamp", "ms_played")


def played_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship report: plays and total time per user over the healed view."""
    return (
        _view(spark, sf_dir)
        .groupBy("user_id")
        .agg(F.count("*").alias("plays"), F.sum("ms_played").alias("ms_played"))
    )


# ---- verdicts and contract checks ---------------------------------------------------------------


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return healed_events(spark, sf_dir).judged.select(_n(), "conforms")


def violation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = healed_events(spark, sf_dir).judged
    return judged.select(_n(), F.inline("violations"))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = healed_events(spark, sf_dir).judged
    return graph.to_triples(
        judged.withColumn("n", F.col("ord.seq")), CONTRACT, checks.values_in("values"), keep=["n"]
    )


def shape_counts_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_node = graph.path_counts(_triples(spark, sf_dir).withColumnRenamed("n", "g"), "g")
    return per_node.groupBy("p").agg(F.count("*").alias("nodes"), F.max("n").alias("most_values"))


def graph_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the checks read the triples more than once, so they are stored first
    return graph.graph_conforms(cut_lineage(_triples(spark, sf_dir)), CONTRACT, graph="n")


def graph_violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = graph.graph_violations(cut_lineage(_triples(spark, sf_dir)), CONTRACT, graph="n")
    return report.groupBy("shape", "path", "constraint").agg(F.count("*").alias("n"))


def _order_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as graphs, some with two ids, a date for a moment, no track, or users of no class or with odd ids."""
    ns, base = graph.vocabulary(), graph.DEFAULT_BASE
    event, user = f"concat('{base}event/', o_orderkey)", f"concat('{base}user/', o_custkey)"
    track = f"concat('{base}track/', o_orderkey % 97)"
    moment = """date_format(o_orderdate, if(o_orderkey % 4 = 0, 'yyyy-MM-dd', "yyyy-MM-dd'T'HH:mm:ss"))"""

    def triple(s: str, p: str, o: str, datatype: str = "null", when: str = "true") -> str:
        kind = "iri" if datatype == "null" else "literal"
        return f"if({when}, named_struct('s', {s}, 'p', '{p}', 'o', {o}, 'o_kind', '{kind}', 'datatype', {datatype}), null)"

    text = f"'{graph.XSD}string'"
    triples = (
        triple(event, graph.RDF_TYPE, f"'{ns}StreamingEvent'"),
        triple(event, f"{ns}eventId", "cast(o_orderkey as string)", text),
        triple(event, f"{ns}eventId", "concat(o_orderkey, '-again')", text, "o_orderkey % 3 = 0"),
        triple(event, f"{ns}eventTimestamp", moment, f"'{graph.XSD}dateTime'"),
        triple(event, f"{ns}performedBy", user),
        triple(user, graph.RDF_TYPE, f"'{ns}User'", when="o_custkey % 5 <> 0"),
        triple(user, f"{ns}userId", "cast(o_custkey as string)", f"if(o_custkey % 7 = 0, '{graph.XSD}integer', {text})"),
        triple(event, f"{ns}involvesTrack", track, when="o_orderkey % 11 <> 0"),
        triple(track, graph.RDF_TYPE, f"'{ns}Track'"),
        triple(track, f"{ns}trackId", "cast(o_orderkey % 97 as string)", text),
    )
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as g", f"inline(array_compact(array({', '.join(triples)})))")


def order_graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples that break maxCount, datatype (string as well), class, node and minCount."""
    report = graph.graph_violations(cut_lineage(_order_triples(spark, sf_dir)), CONTRACT, graph="g")
    return report.select("g", "shape", "path", "constraint")


def event_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(spark, sf_dir)


def ntriples_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ntriples(_triples(spark, sf_dir)).select(F.col("value").alias("line"))


def orders_reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + F.col("o_orderkey") % 3 * 50).alias("o_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return checks.reference_violations(orders, "o_custkey", customers, "c_custkey").select("o_orderkey", "o_custkey")


def nested_reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose nation is missing, or whose nation fails its own check."""
    regions = table(spark, sf_dir, "region").where("r_name <> 'AFRICA'").select("r_regionkey")
    nations = table(spark, sf_dir, "nation")
    faulty = checks.reference_violations(nations, "n_regionkey", regions, "r_regionkey")
    sound = nations.join(faulty.select("n_nationkey"), "n_nationkey", "left_anti")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return checks.reference_violations(customers, "c_nationkey", sound, "n_nationkey").select("c_custkey", "c_nationkey")


ORDERS_CONTRACT = make_contract(
    (
        ("orderKey", True, "order_key", "string", "Order", "orderKey", ""),
        ("status", True, "status", "string", "Order", "status", ""),
        ("priority", True, "priority", "string", "Order", "priority", ""),
        ("placed", True, "placed", "string", "Order", "placed", ""),
    ),
    (
        ("OrderShape", "Order", "orderKey", "datatype", "nonNegativeInteger"),
        ("OrderShape", "Order", "orderKey", "minCount", "1"),
        ("OrderShape", "Order", "status", "minCount", "1"),
        ("OrderShape", "Order", "priority", "minLength", "6"),
        ("OrderShape", "Order", "placed", "datatype", "dateTime"),
    ),
    "Order",
)


def contract_on_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_report(spark, sf_dir, ORDERS_CONTRACT)


def contract_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report under a contract that was saved and loaded."""
    path = _folder(spark, "contract")
    save_contract(spark, ORDERS_CONTRACT, path)
    return _orders_report(spark, sf_dir, load_contract(spark, path, "Order"))


def _orders_report(spark: SparkSession, sf_dir: str, contract: Contract) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        "o_orderpriority",
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
        ).alias("placed"),
    )
    value_of = checks.columns_as_values(
        {"orderKey": "o_orderkey", "status": "status", "priority": "o_orderpriority", "placed": "placed"}
    )
    return checks.violations(orders, contract, value_of, ["o_orderkey"])


def _orders_loop(spark: SparkSession, sf_dir: str) -> Store:
    """Orders as events of a contract of their own, every third under another key, healed in two batches.

    The second batch is run twice, as after a failure, which must not show in any table.
    """
    payload = (
        """concat('{"', if(o_orderkey % 3 = 0, 'order_key', 'orderKey'), '":', o_orderkey, ',"placed":"', """
        """date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss"), '","priority":"', o_orderpriority, '","status":"', o_orderstatus, '"}')"""
    )
    events = table(spark, sf_dir, "orders").selectExpr(
        "concat('orders/', o_orderkey) as source",
        "'partner-feed' as origin",
        "concat('order-', o_orderkey) as fallback_id",
        f"{payload} as payload",
        "named_struct('batch', 0L, 'session', 0L, 'seq', cast(o_orderkey as bigint), 'tie', '') as ord",
        "cast(o_orderdate as timestamp) as received_at",
    )
    store = Store(_folder(spark, "orders-loop"), ORDERS_CONTRACT)
    for batch in (0, 1, 1):
        heal_batch(events.where(F.col("ord.seq") % 2 == batch), batch, store)
    return store


def orders_loop_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_loop(spark, sf_dir).view(spark).select("order_key", "status", "priority", "placed")


def orders_loop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_loop(spark, sf_dir).decisions(spark).groupBy("batch_id", "level", "stage").agg(F.count("*").alias("n"))


def orders_loop_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = _orders_loop(spark, sf_dir).registry(spark)
    return learned.select("canonical", "raw_key", F.col("learned_pos.seq").alias("learned_from"))


def orders_loop_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every batch of the loop reported, and whether the log has a duration for each decision."""
    store = _orders_loop(spark, sf_dir)
    timed = store.timed_decisions(spark).groupBy("batch_id").agg(F.count_if(F.col("event_ms") > 0).alias("timed"))
    reports = store.reports(spark).select("batch_id", "rows_in", "malformed", "conforming", "not_conforming", "healed", "decisions")
    return reports.join(timed, "batch_id")


def orders_loop_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest decisions, read from the batches that can hold them."""
    return _orders_loop(spark, sf_dir).tail(spark, 300).select(_n(), "seq", "stage")


# both fields have the normal form orderkey, so a renamed key could be either
TWIN_CONTRACT = make_contract(
    (("order_key", True, "order_key", "string", "Order", "a"), ("orderKey", True, "customer", "string", "Order", "b")), (), "Order"
)
TWIN_POLICY = policy.Policy(protected=("order_key",))


def _twin_orders(spark: SparkSession, sf_dir: str) -> Healed:
    """Orders in seven forms: keys that suit two fields, agree or not, and are claimed by one of them."""
    order, customer = "concat('o', o_orderkey)", "concat('c', o_custkey)"

    def form(**members: str) -> str:
        return "concat('{', " + ", ',', ".join(f"""'"{k.replace('__', '-')}":"', {v}, '"'""" for k, v in members.items()) + ", '}')"

    forms = (
        form(order_key=order, orderKey=customer),
        form(ORDERKEY=order),
        form(**{"ORDERKEY": order, "Order__Key": order}),
        form(OrderKEY=order, orderkey=customer),
        form(order_key=order, ORDER_KEY=customer),
        form(orderKey=customer),
        form(OrderKEY=order, orderKey=customer),
    )
    whens = " ".join(f"when {i} then {f}" for i, f in enumerate(forms))
    events = table(spark, sf_dir, "orders").selectExpr(
        "concat('orders/', o_orderkey) as source",
        "if(o_orderkey div 7 % 3 = 0, 'unknown-app', 'partner-feed') as origin",
        "concat('order-', o_orderkey) as fallback_id",
        f"case o_orderkey % 7 {whens} end as payload",
        "named_struct('batch', 0L, 'session', 0L, 'seq', cast(o_orderkey as bigint), 'tie', '') as ord",
        "cast(o_orderdate as timestamp) as received_at",
    )
    return heal(cut_lineage(parse.parse_events(events, TWIN_CONTRACT).drop("payload")), None, TWIN_POLICY, TWIN_CONTRACT)


def claimed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches where fields share a normal form: a key goes to the first field, and stays claimed if the policy refuses it."""
    repairs = _twin_orders(spark, sf_dir).judged.select(_n(), F.inline("repairs"))
    return repairs.select("n", "canonical", "outcome", "raw_key")


def claimed_key_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = alias_table(spark, _twin_orders(spark, sf_dir).learned)
    return learned.select("canonical", "raw_key", F.col("learned_pos.seq").alias("learned_from"))


# ---- messages of a broker that reconnects, and files as they come -------------------------------

SESSION = 1000


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of three queues whose delivery tags restart every thousand events."""
    return derived_events(spark, sf_dir).select(
        F.col("payload").cast("binary").alias("body"),
        F.col("origin").alias("app_id"),
        F.concat(F.lit("q"), F.col("ord.seq") % 3).alias("queue"),
        (F.col("ord.seq") % SESSION + 1).alias("delivery_tag"),
        F.timestamp_millis(F.col("ord.seq")).alias("received_at"),
    )


def reconnected_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the loop learns, and from which session and tag; two batches, cut within a session, the second run twice."""
    messages, store = _messages(spark, sf_dir), Store(_folder(spark, "messages"), policy=POLICY)
    ends = messages.agg(F.unix_millis(F.min("received_at")).alias("low"), F.unix_millis(F.max("received_at")).alias("high")).first()
    late = F.col("received_at") > F.timestamp_millis(F.lit(((ends["low"] or 0) + (ends["high"] or 0)) // 2))
    for batch in (0, 1, 1):
        heal_envelopes(messages.where(late if batch else ~late), batch, store, "s1")
    return store.registry(spark).select(
        "canonical", "raw_key", F.col("learned_pos.session").alias("session"), F.col("learned_pos.seq").alias("tag")
    )


def reconnected_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write per track in the order of arrival, which is not that of the tags."""
    numbered, _ = with_sessions(cut_lineage(_messages(spark, sf_dir)))
    events = cut_lineage(parse.parse_events(from_envelope(numbered), CONTRACT).drop("payload"))
    rows = metrics.eligible_metrics(heal(events, None, POLICY, CONTRACT).judged, event="trackId").where("not startswith(event_id, 'amqp')")
    return metrics.latest_per_event(rows).select(
        "event_id", "user_id", "ms_played", F.col("ord.session").alias("session"), F.col("ord.seq").alias("tag")
    )


def _streamed_suppliers(spark: SparkSession, sf_dir: str) -> Store:
    """Suppliers as event files, one each: half of them streamed, the query ended, the rest added and streamed by a second start."""
    root = _folder(spark, "files")
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as eventId",
        "if(s_suppkey % 3 = 0, null, concat('n', s_nationkey)) as userId",
        "if(s_suppkey % 3 = 0, concat('n', s_nationkey), null) as user_id",
        "if(s_suppkey % 2 = 0, null, s_name) as trackId",
        "if(s_suppkey % 2 = 0, s_name, null) as track_id",
        "'2026-01-01T00:00:00' as timestamp",
        "cast(s_suppkey * 10 as bigint) as msPlayed",
    )
    store = Store(f"{root}/store", policy=POLICY)
    for part in (0, 1):
        # files by all tasks, put in place by the task that wrote them and not one after the other by the driver
        some = over_all_tasks(suppliers.where(f"eventId % 4 div 2 = {part}"), "eventId")
        single = some.write.mode("append").option("maxRecordsPerFile", 1)
        single.option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(f"{root}/in")
        run_stream(stream_event_files(spark, f"{root}/in"), store, f"{root}/checkpoint", available_now=True).awaitTermination()
    return store


def streamed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view after both starts: ids go on, rows of the first start are healed by what the second one learned."""
    view = _streamed_suppliers(spark, sf_dir).view(spark)
    return view.selectExpr(
        "event_id", "user_id", "track_id", "ms_played", "id > 0 as numbered",
        "received_at between current_timestamp() - interval 1 hour and current_timestamp() as just_now",
    )


def streamed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _streamed_suppliers(spark, sf_dir).decisions(spark)
    return log.where("stage <> 'breach'").groupBy("stage").agg(F.count("*").alias("n"))


# ---- metrics and private totals -----------------------------------------------------------------


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.eligible_metrics(healed_events(spark, sf_dir).judged)


def metric_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest_per_event(_eligible(spark, sf_dir)).select(
        "event_id", "user_id", "ms_played", F.col("ord.seq").alias("n")
    )


def metric_latest_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins with many writes per key."""
    judged = healed_events(spark, sf_dir).judged
    rows = metrics.eligible_metrics(judged, event="trackId")
    return metrics.latest_per_event(rows).select("event_id", "user_id", "ms_played", F.col("ord.seq").alias("n"))


def _encrypted(spark: SparkSession, sf_dir: str, user_id: str | None = None) -> DataFrame:
    rows = metrics.latest_per_event(_eligible(spark, sf_dir))
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    return metrics.encrypt_metrics(rows, demo_keys()[0])


def encrypted_user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_sum.user_totals(_encrypted(spark, sf_dir), *demo_keys())


def _kept_totals(spark: SparkSession, sf_dir: str) -> str:
    """Where totals are kept over four batches that overwrite the metrics of tracks; the third batch runs twice."""
    rows = cut_lineage(metrics.eligible_metrics(healed_events(spark, sf_dir).judged, event="trackId"))
    high = rows.agg(F.coalesce(F.max("ord.seq"), F.lit(0))).first()[0]
    root = _folder(spark, "totals")
    for batch in (0, 1, 2, 2, 3):
        part = rows.where(f"least(ord.seq * 4 div {high + 1}, 3) = {batch}")
        metrics.upsert_metrics(metrics.encrypt_metrics(metrics.latest_per_event(part), demo_keys()[0]), f"{root}/metrics", batch, fan=2)
        kept_totals.update_totals(spark, f"{root}/metrics", f"{root}/totals", batch, demo_keys()[0], fan=2)
    return f"{root}/totals"


def kept_user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per user from what the batches kept: overwritten metrics are taken out of their owners' totals."""
    return private_sum.user_totals(kept_totals.read_totals(spark, _kept_totals(spark, sf_dir)), *demo_keys())


def kept_one_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's total, from that user's kept rows alone."""
    kept = kept_totals.read_totals(spark, _kept_totals(spark, sf_dir), "u7")
    return private_sum.user_total(kept, "u7", *demo_keys())


def encrypted_one_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_sum.user_total(_encrypted(spark, sf_dir, "u7"), "u7", *demo_keys())


def user_ciphertexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ciphertexts differ with every run, so what they reveal is shown."""
    ship_package(spark)
    rows = metrics.ciphertexts_for_user(_encrypted(spark, sf_dir, "u7"), "u7")
    return rows.select("event_id", reveal(F.col("ciphertext"), demo_keys()[1]).alias("revealed"))


# ---- raw log, identity, quarantine --------------------------------------------------------------


def _stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "raw-log")
    raw_log.append_raw(derived_events(spark, sf_dir), root, 0, CONTRACT)
    return raw_log.raw_log(spark, root, CONTRACT)


def raw_audit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_log(spark, sf_dir).agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))


def raw_log_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_log(spark, sf_dir).select("id", "source", "payload", "received_at")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = parse.split_malformed(derived_events(spark, sf_dir), CONTRACT)
    return bad.select(_n(), "source", "payload")


def canonical_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_events(spark, sf_dir).select(_n(), "payload")


def canonical_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text of the events' own JSON column."""
    J.enable_duplicate_keys(spark)
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.expr(J.canonical_json("props")).alias("props"))


def envelope_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    envelopes = events.select(
        F.col("props").cast("binary").alias("body"),
        F.nullif("event_type", F.lit("error")).alias("app_id"),
        F.concat(F.lit("q"), F.col("user_id") % 3).alias("queue"),
        F.col("event_id").alias("delivery_tag"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )
    return from_envelope(envelopes).select("source", "origin", "fallback_id", "payload", "received_at")


def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    name = "substring_index(url, '/', -1)"
    return pages.selectExpr("page_id", f"{T.file_stem(name)} as stem")


# ---- scalar functions over whole texts ----------------------------------------------------------


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a file may be one row group, which one task would read and work on alone
    docs = over_all_tasks(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return docs.select(
        "doc_id",
        F.md5(F.expr(T.normalize_key("text"))).alias("normal_form"),
        F.md5(F.expr(T.iri_part("text"))).alias("iri_part"),
        F.md5(F.expr(T.escape_literal("text"))).alias("escaped"),
    )


def base64_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as text and back, as ciphertexts are written where only text can be."""
    coded = table(spark, sf_dir, "documents").select("doc_id", to_text(F.col("text").cast("binary")).alias("coded"))
    return coded.select("doc_id", F.md5("coded").alias("coded"), F.md5(from_text(F.col("coded"))).alias("back"))


def wrapped_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per customer in cents, wrapped at the modulus of the encrypted totals."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey", "cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as cents"
    )
    return orders.groupBy("o_custkey").agg(F.expr(f"{T.wrap_total('sum(cents)', MODULUS)} as total"))


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to BIGINT over the price column, as written and with an exponent."""
    cents = "cast(cast(o_totalprice as decimal(18,2)) as string)"
    hundreds = "concat(o_orderkey, 'e2')"
    below = "concat(o_orderkey, '.49999999999999')"
    half = "concat('-', o_orderkey, '.5000000000000001')"
    mixed = "if(o_orderkey % 3 = 0, o_orderpriority, concat(o_orderkey, '.9'))"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        f"{J.rounded_bigint(cents)} as rounded",
        f"{J.rounded_bigint(hundreds)} as hundreds",
        f"{J.rounded_bigint(below)} as below_half",
        f"{J.rounded_bigint(half)} as negative_half",
        f"{J.rounded_bigint(mixed)} as not_always_a_number",
    )


# ---- decision log -------------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decision_log(healed_events(spark, sf_dir).judged)


def decision_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy("level", "stage").agg(F.count("*").alias("n"))


def stored_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as written and read again, the batch written twice."""
    log, path = cut_lineage(_log(spark, sf_dir)), _folder(spark, "decisions")
    for _ in range(2):
        decisions.write_decisions(log, path, 3)
    stored = spark.read.schema(f"{decisions.DECISION_SCHEMA}, batch_id bigint").parquet(path)
    return stored.groupBy("batch_id", "level", "stage").agg(F.count("*").alias("n"))


def decisions_without_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With encryption disabled no metric can fail, and none is stored."""
    judged = healed_events(spark, sf_dir).judged
    log = decisions.decision_log(judged, encrypting=False).select("stage")
    ciphertexts = metrics.encrypt_metrics(metrics.eligible_metrics(judged), None).select(F.lit("ciphertext").alias("stage"))
    return log.unionByName(ciphertexts).groupBy("stage").agg(F.count("*").alias("n"))


def decision_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = decisions.decision_tail(_log(spark, sf_dir), 500)
    return tail.select(_n(), "seq", "level", "stage")


def decision_level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    warned = decisions.level_filter(_log(spark, sf_dir), "WARN")
    return warned.select(_n(), "stage", F.try_element_at("fields", F.lit("missing")).alias("missing"))


def parsed_decision_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision lines made of events, a seventeenth of them broken."""
    raw = derived_events(spark, sf_dir)
    line = F.concat(
        F.lit('{"ts_ms":'), F.col("ord.seq"), F.lit(',"level":"WARN","target":"ingest","message":"seen","fields":{"origin":"'),
        F.col("origin"), F.lit('"}'), F.when(F.col("ord.seq") % 17 == 16, F.lit("")).otherwise(F.lit("}")),
    )
    lines = raw.select(F.col("ord.seq").alias("n"), line.alias("value"))
    parsed = decisions.parse_decision_lines(lines, "timestamp'2024-01-01 00:00:00'")
    return parsed.select("n", "ts_ms", "level", "target", "message", F.try_element_at("fields", F.lit("origin")).alias("origin"))


def catalog() -> dict[str, Query]:
    listed = (
        canonical_extract, resolved_via, missing_required, used_keys, normalized_keys,
        matching_keys, rename_candidates, ambiguous_breaches, policy_decisions, policy_disabled_decisions, policy_from_tables, policy_unreadable_decisions,
        learned_aliases, learned_aliases_without_policy, learned_aliases_by_joins, registry_union,
        alias_audit, stale_aliases,
        healed_view, healed_view_all_keys, healed_view_from_text, healed_lookup, indexed_lookup, played_per_user,
        verdicts, violation_report, shape_counts_graph, graph_verdicts, graph_violation_counts, order_graph_violations,
        event_triples, ntriples_lines, orders_reference_check, nested_reference_check, contract_on_orders, contract_from_tables,
        orders_loop_view, orders_loop_log, orders_loop_registry, orders_loop_reports, orders_loop_tail,
        claimed_keys, claimed_key_aliases, reconnected_registry, reconnected_latest, streamed_view, streamed_log,
        metric_latest, metric_latest_per_track, encrypted_user_totals, encrypted_one_user, kept_user_totals, kept_one_user, user_ciphertexts,
        raw_audit_count, raw_log_ids, quarantine, canonical_payload, canonical_properties,
        envelope_identity, file_identity, text_functions, base64_texts, wrapped_totals, number_texts,
        decision_log_counts, stored_decision_counts, decisions_without_encryption, decision_tail, decision_level_filter, parsed_decision_lines,
    )
    return {q.__name__: q for q in listed}
