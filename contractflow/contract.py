"""The event contract: canonical fields plus a table of constraints.

A contract is metadata (a handful of rows), so it is held as plain Python rows and compiled
into Column expressions by the operators.  It can be loaded from, and saved to, two small tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from contractflow.functions.text import normalized

# The canonical fields.
# name, required, view column, view type, node class, path, link path
DEFAULT_FIELDS = (
    ("eventId", True, "event_id", "string", "StreamingEvent", "eventId", ""),
    ("userId", True, "user_id", "string", "User", "userId", "performedBy"),
    ("trackId", True, "track_id", "string", "Track", "trackId", "involvesTrack"),
    ("timestamp", True, "event_timestamp", "string", "StreamingEvent", "eventTimestamp", ""),
    ("msPlayed", False, "ms_played", "bigint", "StreamingEvent", "msPlayed", ""),
)

DEFAULT_ROLES = {"event": "eventId", "owner": "userId", "metric": "msPlayed"}

# The constraints of the default contract.
# shape, target class, path, constraint, value
DEFAULT_CONSTRAINTS = (
    ("StreamingEventShape", "StreamingEvent", "eventId", "datatype", "string"),
    ("StreamingEventShape", "StreamingEvent", "eventId", "minCount", "1"),
    ("StreamingEventShape", "StreamingEvent", "eventId", "maxCount", "1"),
    ("StreamingEventShape", "StreamingEvent", "eventId", "minLength", "1"),
    ("StreamingEventShape", "StreamingEvent", "eventTimestamp", "datatype", "dateTime"),
    ("StreamingEventShape", "StreamingEvent", "eventTimestamp", "minCount", "1"),
    ("StreamingEventShape", "StreamingEvent", "eventTimestamp", "maxCount", "1"),
    ("StreamingEventShape", "StreamingEvent", "msPlayed", "datatype", "nonNegativeInteger"),
    ("StreamingEventShape", "StreamingEvent", "msPlayed", "maxCount", "1"),
    ("StreamingEventShape", "StreamingEvent", "performedBy", "class", "User"),
    ("StreamingEventShape", "StreamingEvent", "performedBy", "node", "UserShape"),
    ("StreamingEventShape", "StreamingEvent", "performedBy", "minCount", "1"),
    ("StreamingEventShape", "StreamingEvent", "performedBy", "maxCount", "1"),
    ("StreamingEventShape", "StreamingEvent", "involvesTrack", "class", "Track"),
    ("StreamingEventShape", "StreamingEvent", "involvesTrack", "node", "TrackShape"),
    ("StreamingEventShape", "StreamingEvent", "involvesTrack", "minCount", "1"),
    ("StreamingEventShape", "StreamingEvent", "involvesTrack", "maxCount", "1"),
    ("UserShape", "User", "userId", "datatype", "string"),
    ("UserShape", "User", "userId", "minCount", "1"),
    ("UserShape", "User", "userId", "maxCount", "1"),
    ("UserShape", "User", "userId", "minLength", "1"),
    ("TrackShape", "Track", "trackId", "datatype", "string"),
    ("TrackShape", "Track", "trackId", "minCount", "1"),
    ("TrackShape", "Track", "trackId", "maxCount", "1"),
    ("TrackShape", "Track", "trackId", "minLength", "1"),
)

KNOWN_CONSTRAINTS = {"minCount", "maxCount", "minLength", "datatype", "class", "node"}
KNOWN_DATATYPES = {"string", "dateTime", "nonNegativeInteger"}

FIELD_SCHEMA = (
    "name string, required boolean, view_column string, view_type string, "
    "node_class string, path string, link_path string, position int, role string"
)
CONSTRAINT_SCHEMA = "shape string, target_class string, path string, `constraint` string, value string"

MAX_CONTRACT_ROWS = 10_000


@dataclass(frozen=True)
class Field:
    name: str
    required: bool
    view_column: str
    view_type: str
    node_class: str
    path: str
    link_path: str = ""


@dataclass(frozen=True)
class Constraint:
    shape: str
    target_class: str
    path: str
    constraint: str
    value: str


class ContractError(ValueError):
    """The contract (or a registry used with it) breaks a precondition."""


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]
    constraints: tuple[Constraint, ...]
    root_class: str
    # fields that name an event, its owner and its metric; empty if the contract has none
    event: str = ""
    owner: str = ""
    metric: str = ""

    def __post_init__(self) -> None:
        for role in (self.event, self.owner, self.metric):
            if role and role not in self.names:
                raise ContractError(f"{role!r} has a role but is no field")
        for f in self.fields:
            if not normalized(f.name):
                raise ContractError(f"field {f.name!r} has an empty normal form")
        # fields are members of structs, whose names Spark compares without regard to case
        if len({n.lower() for n in self.names}) < len(self.names):
            raise ContractError("field names must differ in more than case")
        for c in self.constraints:
            if c.constraint not in KNOWN_CONSTRAINTS:
                raise ContractError(f"unknown constraint {c.constraint!r} on {c.shape}.{c.path}")
            if c.constraint == "datatype" and c.value not in KNOWN_DATATYPES:
                raise ContractError(f"unknown datatype {c.value!r} on {c.shape}.{c.path}")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    @property
    def normal_forms(self) -> dict[str, str]:
        """canonical name -> normal form"""
        return {f.name: normalized(f.name) for f in self.fields}

    @property
    def shared_forms(self) -> dict[str, list[str]]:
        """normal form -> its fields, where there are several and one of them is required

        A renamed key of such a form is claimed by the first of these fields that it suits.
        """
        fields: dict[str, list[str]] = {}
        for name, form in self.normal_forms.items():
            fields.setdefault(form, []).append(name)
        return {f: n for f, n in fields.items() if len(n) > 1 and set(n) & set(self.required)}

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def check_alias(self, canonical: str, raw_key: str) -> None:
        forms = self.normal_forms
        if canonical not in forms or normalized(raw_key) != forms[canonical]:
            raise ContractError(f"alias {raw_key!r} does not belong to field {canonical!r}")

    def of(self, shape_or_class: str, path: str | None = None) -> list[Constraint]:
        return [
            c
            for c in self.constraints
            if shape_or_class in (c.shape, c.target_class) and path in (None, c.path)
        ]


def make_contract(
    fields: Sequence[Sequence], constraints: Sequence[Sequence], root_class: str, **roles: str
) -> Contract:
    return Contract(
        tuple(Field(*f) for f in fields), tuple(Constraint(*c) for c in constraints), root_class, **roles
    )


def default_contract() -> Contract:
    return make_contract(DEFAULT_FIELDS, DEFAULT_CONSTRAINTS, "StreamingEvent", **DEFAULT_ROLES)


def contract_tables(spark: SparkSession, contract: Contract) -> tuple[DataFrame, DataFrame]:
    roles = {getattr(contract, role): role for role in DEFAULT_ROLES}
    fields = spark.createDataFrame(
        [
            (f.name, f.required, f.view_column, f.view_type, f.node_class, f.path, f.link_path, i, roles.get(f.name))
            for i, f in enumerate(contract.fields)
        ],
        FIELD_SCHEMA,
    )
    constraints = spark.createDataFrame(
        [(c.shape, c.target_class, c.path, c.constraint, c.value) for c in contract.constraints],
        CONSTRAINT_SCHEMA,
    )
    return fields, constraints


def save_contract(spark: SparkSession, contract: Contract, path: str, fmt: str = "parquet") -> None:
    fields, constraints = contract_tables(spark, contract)
    fields.coalesce(1).write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/fields")
    constraints.coalesce(1).write.mode("overwrite").format(fmt).option("header", True).save(
        f"{path}/constraints"
    )


def load_contract(
    spark: SparkSession, path: str, root_class: str = "StreamingEvent", fmt: str = "parquet"
) -> Contract:
    """Read ``<path>/fields`` and ``<path>/constraints`` (parquet, json or csv)."""

    def rows(name: str, schema: str):
        table = (
            spark.read.format(fmt).schema(schema).option("header", True).load(f"{path}/{name}")
        )
        found = table.limit(MAX_CONTRACT_ROWS + 1).collect()
        if len(found) > MAX_CONTRACT_ROWS:
            raise ContractError(f"{path}/{name} is not a contract table (too many rows)")
        return found

    # tables without positions: the default fields in their order, then the others by name
    order = {f[0]: i for i, f in enumerate(DEFAULT_FIELDS)}
    found = sorted(
        rows("fields", FIELD_SCHEMA),
        key=lambda r: (order.get(r["name"], len(order)) if r["position"] is None else r["position"], r["name"]),
    )
    fields = [
        (r["name"], r["required"], r["view_column"], r["view_type"], r["node_class"], r["path"], r["link_path"] or "")
        for r in found
    ]
    constraints = [
        (r["shape"], r["target_class"], r["path"], r["constraint"], r["value"])
        for r in rows("constraints", CONSTRAINT_SCHEMA)
    ]
    # tables without roles: those of the default fields, by name
    roles = {r["role"]: r["name"] for r in found if r["role"]}
    if not roles:
        roles = {role: name for role, name in DEFAULT_ROLES.items() if any(name == r["name"] for r in found)}
    return make_contract(fields, sorted(constraints), root_class, **roles)
