"""Plain descriptions handed to the operators: tables, positions, rules, templates.

Nothing here touches Spark; the objects are small, immutable and picklable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# --- Fixed values -----------------------------------------------------------
# Operation codes of a change row.
OP_DELETE = 1
OP_INSERT = 2
OP_BEFORE_IMAGE = 3
OP_UPDATE = 4
APPLIED_OPS = (OP_DELETE, OP_INSERT, OP_UPDATE)

# Columns a change table adds to the data columns.
CHANGE_METADATA = (
    "__$start_lsn",
    "__$end_lsn",
    "__$seqval",
    "__$operation",
    "__$update_mask",
    "__lsn_hex",
)

# Metadata columns of a target table, by capture mode: name -> SQL type.
BROKERED_METADATA = {
    "__sync_timestamp": "timestamp",
    "__source": "string",
    "__source_db": "string",
    "__source_table": "string",
    "__source_ts_ms": "bigint",
    "__cdc_operation": "string",
}
NATIVE_METADATA = {
    "__sync_timestamp": "timestamp",
    "__source": "string",
    "__source_db": "string",
    "__source_table": "string",
    "__source_start_lsn": "binary",
    "__source_seqval": "binary",
    "__cdc_operation": "int",
}
BROKER_METADATA = {
    "__kafka_offset": "bigint",
    "__kafka_partition": "int",
    "__kafka_timestamp": "timestamp",
}

BROKERED_SOURCE = "kafka-cdc"
NATIVE_SOURCE = "mssql_cdc"
SNAPSHOT_SOURCE = "mssql_snapshot"

# Default caps of one pull.
SINGLE_CURSOR_CAP = 100_000
COMPOSITE_CURSOR_CAP = 50_000

TENANT_COLUMN = "customer_id"
DEFAULT_SCHEMA = "dbo"
# --- End of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Position:
    """Names of the two columns that order a change feed.

    Both columns must sort in log order: binary, or hex text of one width.
    """

    lsn: str = "start_lsn"
    seq: str = "seqval"

    @property
    def columns(self) -> tuple[str, str]:
        return (self.lsn, self.seq)


@dataclass(frozen=True)
class Condition:
    """One condition of a rule: a Spark SQL predicate and, maybe, a value expression."""

    when: str
    value: str | None = None


@dataclass(frozen=True)
class Rule:
    """A declarative row rule (see ``operators.rules``)."""

    name: str
    kind: str  # conditional_column | row_multiplier | filter
    conditions: Sequence[Condition]
    output: str | None = None
    output_type: str = "string"
    on_no_match: str = "drop"  # drop | keep | default
    default: str | None = None
    stage: str = "source"  # source | sink


@dataclass(frozen=True)
class Template:
    """A computed column: an expression plus the type it is cast to."""

    name: str
    type: str
    value: str
    kind: str = "expression"  # expression | env | sql | source_ref
    nullable: bool = True
    unique: bool = False


@dataclass(frozen=True)
class TableSpec:
    """Everything the operators need to know about one captured table."""

    table: str
    keys: Sequence[str]
    schema: str = DEFAULT_SCHEMA
    database: str = ""
    topic_prefix: str = ""
    topic_format: str | None = None
    include: Sequence[str] = ()
    ignore: Sequence[str] = ()
    renames: Mapping[str, str] = field(default_factory=dict)
    types: Mapping[str, str] = field(default_factory=dict)
    templates: Sequence[Template] = ()
    rules: Sequence[Rule] = ()
    tenant: str | None = None
    position: Position = Position()
    op: str = "op_code"

    def __post_init__(self) -> None:
        if not self.keys:
            raise ValueError(f"table {self.schema}.{self.table}: at least one key column is required")
