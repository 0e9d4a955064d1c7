"""The observe, reason, act loop as a Structured Streaming query.

Every table is written per ``batch_id`` and a batch starts from the newest registry version older
than itself, so running a batch again after a failure gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from contractflow.contract import Contract, default_contract
from contractflow.functions.crypto import PublicKey
from contractflow.operators.decisions import DECISION_SCHEMA, decision_log, decision_tail, write_decisions
from contractflow.operators.kept_totals import TOTAL_SCHEMA, read_totals, update_totals
from contractflow.operators.metrics import (
    METRIC_SCHEMA, eligible_metrics, encrypt_metrics, latest_per_event, read_metrics, read_user_metrics, upsert_metrics,
)
from contractflow.operators.policy import Policy
from contractflow.operators.lookup import find_event, write_index
from contractflow.operators.private_sum import EncryptionDisabled
from contractflow.operators.raw_log import append_raw, batch_rows, quarantine, raw_log
from contractflow.operators.registry import Aliases, REGISTRY_SCHEMA, as_aliases, empty_registry, learn, touch
from contractflow.operators.shim import healed_view
from contractflow.plans.heal import alias_table, heal, used_pairs
from contractflow.sources.envelope import from_envelope
from contractflow.sources.identity import with_batch
from contractflow.sources.sessions import STATE_SCHEMA, with_sessions
from contractflow.storage import cut_lineage, temporary_tables
from contractflow.streaming.reports import BatchReport, read_reports, tail_batches, timed
from contractflow.tables import read_version, write_version


@dataclass(frozen=True)
class Store:
    """Where a running engine keeps its tables, and the options of the loop."""

    root: str
    contract: Contract = field(default_factory=default_contract)
    policy: Policy | None = None
    key: PublicKey | None = None
    arrival_order: bool = True

    def registry(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Learned aliases after the newest batch (older than ``before``)."""
        stored = read_version(spark, f"{self.root}/registry", REGISTRY_SCHEMA, before)
        return empty_registry(spark) if stored is None else stored

    def aliases(self, spark: SparkSession) -> Aliases:
        return as_aliases(self.registry(spark), self.contract)

    def raw(self, spark: SparkSession) -> DataFrame:
        return raw_log(spark, self.root, self.contract)

    def quarantined(self, spark: SparkSession) -> DataFrame:
        return quarantine(spark, self.root, self.contract)

    @property
    def has_metric(self) -> bool:
        return bool(self.contract.owner and self.contract.metric)

    def metrics(self, spark: SparkSession, user_id: str | None = None) -> DataFrame:
        """Current metrics, of one user or of all; empty for a contract without owner or metric."""
        if not self.has_metric:
            return spark.createDataFrame([], METRIC_SCHEMA)
        path = f"{self.root}/metrics"
        return read_metrics(spark, path) if user_id is None else read_user_metrics(spark, path, user_id)

    def totals(self, spark: SparkSession, user_id: str | None = None) -> DataFrame:
        """Encrypted totals as kept, for ``user_totals``: reads no metrics."""
        if self.key is None:
            raise EncryptionDisabled("cannot total encrypted values: no key is configured")
        if not self.has_metric:
            return spark.createDataFrame([], TOTAL_SCHEMA)
        return read_totals(spark, f"{self.root}/totals", user_id)

    def decisions(self, spark: SparkSession) -> DataFrame:
        schema = f"{DECISION_SCHEMA}, batch_id bigint"
        return spark.read.schema(schema).parquet(f"{self.root}/decisions")

    def reports(self, spark: SparkSession) -> DataFrame:
        """One row per batch: what came in, what was decided, how long it took."""
        return read_reports(spark, self.root)

    def timed_decisions(self, spark: SparkSession) -> DataFrame:
        """The decision log with the duration of each row's batch and its share per event."""
        return timed(self.decisions(spark), self.reports(spark))

    def tail(self, spark: SparkSession, n: int = 500) -> DataFrame:
        """The newest ``n`` decisions; batches that cannot hold any of them are not read."""
        batches = tail_batches(self.reports(spark), n)
        paths = [f"{self.root}/decisions/batch_id={b}" for b in batches]
        if not paths:
            return spark.createDataFrame([], DECISION_SCHEMA)
        return decision_tail(spark.read.schema(DECISION_SCHEMA).parquet(*paths), n)

    def view(self, spark: SparkSession, safe_keys_only: bool = True, name: str | None = None) -> DataFrame:
        return healed_view(self.raw(spark), self.aliases(spark), self.contract, safe_keys_only, name)

    def lookup(self, spark: SparkSession, event_id: str, safe_keys_only: bool = True) -> DataFrame:
        """The earliest row of the view with this event id, if any; reads only rows that may be it."""
        return find_event(spark, self.root, event_id, self.aliases(spark), self.contract, safe_keys_only)


def heal_batch(events: DataFrame, batch_id: int, store: Store) -> None:
    """Process one batch of raw events and write all its tables."""
    with temporary_tables(events.sparkSession):
        _heal_batch(events, batch_id, store)


def _heal_batch(events: DataFrame, batch_id: int, store: Store) -> None:
    spark = events.sparkSession
    report = BatchReport(batch_id)
    append_raw(
        with_batch(events, batch_id), store.root, batch_id, store.contract, store.arrival_order, report.of_events
    )
    stored = batch_rows(spark, store.root, batch_id, store.contract)
    if store.contract.event:
        write_index(stored, store.root, batch_id, store.contract.event)

    registry = store.registry(spark, before=batch_id)
    healed = heal(stored, registry, store.policy, store.contract)

    roles = store.contract
    log = decision_log(
        report.of_verdicts(healed.judged), store.key is not None and store.has_metric, owner=roles.owner, metric=roles.metric
    )
    write_decisions(report.of_decisions(log), f"{store.root}/decisions", batch_id)
    if store.has_metric:
        # repeated ids within the batch are dropped before they cost an encryption
        metrics = latest_per_event(eligible_metrics(healed.judged, roles.owner, roles.metric, roles.event))
        upsert_metrics(encrypt_metrics(metrics, store.key), f"{store.root}/metrics", batch_id)
        if store.key is not None:
            update_totals(spark, f"{store.root}/metrics", f"{store.root}/totals", batch_id, store.key)

    widened, _ = learn(registry, alias_table(spark, healed.learned))
    used = cut_lineage(used_pairs(healed.judged, store.contract))
    write_version(touch(widened, used), f"{store.root}/registry", batch_id)
    report.write(spark, store.root)


def heal_envelopes(envelopes: DataFrame, batch_id: int, store: Store, stream_id: str | None = None) -> None:
    """Process one batch of broker messages; sessions of delivery tags go on from the batch before."""
    spark = envelopes.sparkSession
    with temporary_tables(spark):
        stored = cut_lineage(envelopes)
        state = read_version(spark, f"{store.root}/sessions", STATE_SCHEMA, before=batch_id)
        numbered, now = with_sessions(stored, state)
        _heal_batch(from_envelope(numbered, stream_id), batch_id, store)
        write_version(now, f"{store.root}/sessions", batch_id)


def run_stream(
    events: DataFrame, store: Store, checkpoint: str, available_now: bool = False, interval: str = "10 seconds"
) -> StreamingQuery:
    """Start the loop over a streaming DataFrame of raw events."""

    def process(batch: DataFrame, batch_id: int) -> None:
        # a batch may be many small files, so it is read from its source once
        with temporary_tables(batch.sparkSession):
            _heal_batch(cut_lineage(batch), batch_id, store)

    return _start(events, process, checkpoint, available_now, interval)


def run_envelope_stream(
    envelopes: DataFrame,
    store: Store,
    checkpoint: str,
    stream_id: str | None = None,
    available_now: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Start the loop over a streaming DataFrame of broker messages."""

    def process(batch: DataFrame, batch_id: int) -> None:
        heal_envelopes(batch, batch_id, store, stream_id)

    return _start(envelopes, process, checkpoint, available_now, interval)


def _start(
    rows: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool, interval: str
) -> StreamingQuery:
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(process)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
