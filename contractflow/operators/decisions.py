"""The decision log: one row per outcome of every event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractflow.functions.crypto import MODULUS
from contractflow.functions.json import enable_duplicate_keys, is_valid_json
from contractflow.functions.text import lit
from contractflow.operators.metrics import metric_value
from contractflow.sources.identity import ORD_TYPE

# Levels from most to least severe.
LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE")

DECISION_SCHEMA = (
    f"ord {ORD_TYPE}, seq int, ts timestamp, level string, stage string, message string, "
    "fields map<string,string>"
)
LINE_SCHEMA = "ts_ms bigint, level string, target string, message string, fields map<string,string>"


def _entry(level: str, stage: str, message: str, **fields: str) -> str:
    pairs = ", ".join(f"{lit(name)}, {value}" for name, value in fields.items())
    return (
        f"named_struct('level', {lit(level)}, 'stage', {lit(stage)}, 'message', {lit(message)}, 'fields', map({pairs}))"
    )


def _joined(keys: str) -> str:
    return f"array_join({keys}, ',')"


def decision_log(
    judged: DataFrame, encrypting: bool = True, modulus: int = MODULUS, owner: str = "userId", metric: str = "msPlayed"
) -> DataFrame:
    """``ord, seq, ts, level, stage, message, fields`` from the result of the heal plan.

    ``owner`` and ``metric`` are the contract's fields with these roles; with ``encrypting`` off they are not read.

    Stages: breach, healed, denied, ambiguous, metric_failed, conforms, not_conforming.
    """
    breach = _entry("WARN", "breach", "required fields are missing", source="source", missing=_joined("missing_before"))
    field = {"canonical": "r.canonical", "raw_key": "r.raw_key"}
    healed = _entry("INFO", "healed", "renamed field recognised", source="source", **field)
    denied = _entry("WARN", "denied", "policy refused the renamed field", origin="origin", **field)
    ambiguous = _entry(
        "WARN", "ambiguous", "several keys disagree, none taken",
        source="source", canonical="r.canonical", candidates=_joined("r.candidates"),
    )
    repair = (
        f"case r.outcome when 'healed' then {healed} when 'denied' then {denied} when 'ambiguous' then {ambiguous} end"
    )
    value = metric_value(f"values.`{metric}`")
    failed = f"values.`{owner}` is not null and {value} >= {modulus}" if encrypting else "false"
    refused = _entry("WARN", "metric_failed", "value cannot be encrypted", source="source")
    good = _entry("INFO", "conforms", "event conforms to the contract", source="source")
    bad = _entry(
        "WARN", "not_conforming", "event does not conform, kept for audit",
        source="source", missing=_joined("missing_required"),
    )
    entries = (
        f"array_compact(concat(if(size(missing_before) > 0, array({breach}), array()), "
        f"transform(repairs, r -> {repair}), array(if({failed}, {refused}, null), if(conforms, {good}, {bad}))))"
    )
    log = judged.selectExpr("ord", "received_at as ts", f"posexplode({entries}) as (seq, entry)")
    return log.selectExpr("ord", "seq", "ts", "entry.level", "entry.stage", "entry.message", "entry.fields")


def level_filter(log: DataFrame, minimum: str) -> DataFrame:
    """Rows at least as severe as ``minimum``."""
    return log.where(F.col("level").isin(*LEVELS[: LEVELS.index(minimum.upper()) + 1]))


def decision_tail(log: DataFrame, n: int = 500) -> DataFrame:
    """The newest ``n`` rows."""
    return log.orderBy(F.desc("ts"), F.desc("ord"), F.desc("seq")).limit(n)


def write_decisions(log: DataFrame, path: str, batch_id: int) -> None:
    log.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def to_lines(log: DataFrame) -> DataFrame:
    """One JSON line per decision."""
    return log.select(
        F.to_json(
            F.struct(
                F.unix_millis("ts").alias("ts_ms"), "level", F.col("stage").alias("target"), "message", "fields"
            )
        ).alias("value")
    )


def parse_decision_lines(lines: DataFrame, received_at: str = "current_timestamp()") -> DataFrame:
    """Decision rows from text lines; a line that is no JSON object becomes an ERROR row with its text."""
    enable_duplicate_keys(lines.sparkSession)
    good = f"{is_valid_json('value')} and startswith(ltrim(value), '{{')"
    broken = (
        f"named_struct('ts_ms', unix_millis({received_at}), 'level', 'ERROR', 'target', 'console', "
        "'message', concat('unreadable decision line: ', value), 'fields', cast(map() as map<string,string>))"
    )
    keep = [c for c in lines.columns if c != "value"]
    entry = f"if({good}, from_json(value, {lit(LINE_SCHEMA)}), {broken}) as e"
    return lines.selectExpr(*keep, entry).select(*keep, "e.*")
