"""Column-level operators: pruning, renaming, casting, stamping, computed columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.functions.expressions import row_hash
from changefeed.functions.types import FALLBACK_TYPE, MSSQL_TO_PG, map_type_name, spark_type
from changefeed.spec import (
    BROKER_METADATA,
    BROKERED_METADATA,
    BROKERED_SOURCE,
    NATIVE_METADATA,
    NATIVE_SOURCE,
    SNAPSHOT_SOURCE,
    OP_INSERT,
    TableSpec,
    Template,
)

# --- Fixed values -----------------------------------------------------------
# Computed columns every installation has. ``meta`` values come from the context.
TEMPLATES = {
    "source_table": Template("_source_table", "string", "meta.table", "meta", nullable=False),
    "source_schema": Template("_source_schema", "string", "meta.schema", "meta", nullable=False),
    "kafka_topic": Template("_kafka_topic", "string", "meta.kafka_topic", "meta", nullable=False),
    "kafka_offset": Template("_kafka_offset", "bigint", "meta.kafka_offset", "meta"),
    "kafka_partition": Template("_kafka_partition", "int", "meta.kafka_partition", "meta"),
    "sync_timestamp": Template("_synced_at", "timestamp_ntz", "now()", "sql", nullable=False),
    "sync_id": Template("_sync_id", "string", "gen_random_uuid()", "sql", nullable=False),
    "cdc_operation": Template("_cdc_operation", "string", "meta.operation", "meta", nullable=False),
    "cdc_lsn": Template("_cdc_lsn", "string", "meta.lsn", "meta"),
    "environment": Template("_environment", "string", "${ENVIRONMENT}", "env", nullable=False),
    "tenant_id": Template("_tenant_id", "string", "${TENANT_ID}", "env", nullable=False),
    "row_hash": Template("_row_hash", "string", "row_hash()", "hash"),
    "ingestion_id": Template("_ingestion_id", "string", "gen_random_uuid()", "sql", nullable=False),
}
EMPTY_VALUES = ("", "none", "null")
# --- End of fixed values ----------------------------------------------------


def dedupe_columns(names: Sequence[str]) -> list[str]:
    """Names without repeats; case does not matter and the first spelling wins."""
    seen: dict[str, str] = {}
    for name in names:
        seen.setdefault(name.casefold(), name)
    return list(seen.values())


def dedupe_frame(df: DataFrame) -> DataFrame:
    """Keep the first of columns whose names differ only in case."""
    kept: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        kept.setdefault(name.casefold(), i)
    if len(kept) == len(df.columns):
        return df
    unique = df.toDF(*[f"__{i}" for i in range(len(df.columns))])
    return unique.select(*[F.col(f"__{i}").alias(df.columns[i]) for i in kept.values()])


def prune_columns(
    df: DataFrame,
    include: Sequence[str] = (),
    ignore: Sequence[str] = (),
    keys: Sequence[str] = (),
    mode: str = "both",
) -> DataFrame:
    """Columns on the include list and not on the ignore list, without case.

    Key columns survive an include list. ``mode='ignore_first'`` takes the ignore list alone
    when both are given; ``both`` applies both.
    """
    wanted = {c.casefold() for c in include}
    dropped = {c.casefold() for c in ignore}
    kept_keys = {c.casefold() for c in keys}
    if mode not in ("both", "ignore_first"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "ignore_first" and dropped:
        wanted = set()

    def keep(name: str) -> bool:
        folded = name.casefold()
        if folded in dropped:
            return False
        return not wanted or folded in wanted or folded in kept_keys

    return df.select(*[c for c in df.columns if keep(c)])


CASE_INSENSITIVE = "UTF8_LCASE"


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Source names to target names; unlisted columns stay as they are."""
    return df.withColumnsRenamed(dict(mapping))


def cast_to_target(
    df: DataFrame,
    source_types: Mapping[str, str],
    mapping: Mapping[str, str] = MSSQL_TO_PG,
    lenient: bool = False,
) -> DataFrame:
    """Cast each listed column to the Spark type its source type maps to.

    ``lenient`` turns values that do not fit into null instead of failing the job. Uuids are
    lower-cased so that they compare equal across engines. Case-insensitive text keeps its spelling and compares
    without case, in merges, unique checks and distinct counts alike.
    """
    out = {}
    for name, type_name in source_types.items():
        column, target = F.col(name), spark_type(type_name, mapping)
        value = column.try_cast(target) if lenient else column.cast(target)
        if map_type_name(type_name, mapping, FALLBACK_TYPE) == "uuid":
            value = F.lower(value)
        if "citext" in (type_name.lower(), map_type_name(type_name, mapping, FALLBACK_TYPE)):
            value = F.collate(value, CASE_INSENSITIVE)
        out[name] = value
    return df.withColumns(out)


def stamp_metadata(
    df: DataFrame,
    mode: str,
    now: Column,
    database: Column | str = "",
    table: Column | str = "",
    op: Column | None = None,
    ts_ms: Column | None = None,
    lsn: Column | None = None,
    seq: Column | None = None,
    broker: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ingestion metadata.

    ``brokered`` adds six columns (and the broker's three when ``broker`` is given),
    ``native`` seven, ``snapshot`` the native seven with the snapshot's source and insert as
    operation. ``now`` is passed in so that a rerun gives the same rows.
    """
    db = F.lit(database) if isinstance(database, str) else database
    tbl = F.lit(table) if isinstance(table, str) else table
    common = {"__sync_timestamp": now, "__source_db": db, "__source_table": tbl}
    if mode == "brokered":
        values = {
            **common,
            "__source": F.lit(BROKERED_SOURCE),
            "__source_ts_ms": ts_ms if ts_ms is not None else F.lit(None),
            "__cdc_operation": op if op is not None else F.lit(None),
        }
        types = {**BROKERED_METADATA, **(BROKER_METADATA if broker else {})}
        values.update(broker or {})
    elif mode in ("native", "snapshot"):
        snapshot = mode == "snapshot"
        values = {
            **common,
            "__source": F.lit(SNAPSHOT_SOURCE if snapshot else NATIVE_SOURCE),
            "__source_start_lsn": lsn if lsn is not None else F.lit(None),
            "__source_seqval": seq if seq is not None else F.lit(None),
            "__cdc_operation": F.lit(OP_INSERT) if snapshot else (op if op is not None else F.lit(None)),
        }
        types = dict(NATIVE_METADATA)
        # Positions may be binary or fixed-width text; keep whichever the feed uses.
        types.pop("__source_start_lsn")
        types.pop("__source_seqval")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    clocks = ("__sync_timestamp", "__kafka_timestamp")
    names = list(BROKERED_METADATA if mode == "brokered" else NATIVE_METADATA)
    names += [n for n in values if n not in names]
    return df.withColumns(
        {n: values[n].cast(types[n]) if n in types and n not in clocks else values[n] for n in names}
    )


def template_value(
    kind: str,
    value: str,
    ctx: Mapping[str, Column],
    env: Mapping[str, str] | None = None,
    hashed: Sequence[str] = (),
) -> Column:
    """The column a template stands for.

    Kinds: ``expression`` (Spark SQL), ``env`` (``${NAME}`` or plain text), ``sql``
    (``now()``, ``gen_random_uuid()`` or plain text), ``meta`` (context), ``hash`` (row
    content), ``source_ref`` (resolved text, which must not be empty).
    """
    if kind == "expression":
        return F.expr(value)
    if kind == "env":
        text = value.strip()
        if text.startswith("${") and text.endswith("}"):
            name = text[2:-1]
            if env is None or name not in env:
                raise ValueError(f"environment variable {name} is not set")
            return F.lit(env[name])
        return F.lit(value)
    if kind == "sql":
        text = value.strip().casefold()
        if text == "now()":
            return ctx["now"] if "now" in ctx else F.current_timestamp()
        if text == "gen_random_uuid()":
            return ctx["uuid"] if "uuid" in ctx else F.uuid()
        return F.lit(value)
    if kind == "meta":
        name = value.removeprefix("meta.")
        if name not in ctx:
            raise ValueError(f"context has no value {name!r}")
        return ctx[name]
    if kind == "hash":
        return row_hash(hashed)
    if kind == "source_ref":
        if value is None or value.strip().casefold() in EMPTY_VALUES:
            raise ValueError("source reference resolved to an empty value")
        return F.lit(value.strip())
    raise ValueError(f"unknown template kind {kind!r}")


def apply_templates(
    df: DataFrame,
    templates: Sequence[str | tuple[str, Mapping[str, str]] | Template],
    ctx: Mapping[str, Column],
    env: Mapping[str, str] | None = None,
    registry: Mapping[str, Template] = TEMPLATES,
) -> DataFrame:
    """Add computed columns by template name, with optional name and value overrides.

    A column that exists already is left alone. The row hash covers the columns present
    before any template was applied.
    """
    content = df.columns
    out: dict[str, Column] = {}
    for item in templates:
        override: Mapping[str, str] = {}
        if isinstance(item, Template):
            template = item
        else:
            key, override = (item, {}) if isinstance(item, str) else item
            if key not in registry:
                raise KeyError(f"unknown template {key!r}; known: {', '.join(sorted(registry))}")
            template = registry[key]
        name = override.get("name", template.name)
        if name in content or name in out:
            continue
        kind, value = template.kind, template.value
        if "value" in override:
            value = override["value"]
            kind = "expression" if kind in ("meta", "hash") else kind
        out[name] = template_value(kind, value, ctx, env, content).cast(template.type)
    return df.withColumns(out)


def to_staging(df: DataFrame, spec: TableSpec, batch_id: Column, pulled_at: Column) -> DataFrame:
    """Rows as they are appended to staging: batch id and pull time, then the captured columns."""
    data = rename_columns(prune_columns(df, spec.include, spec.ignore, spec.keys), spec.renames)
    return dedupe_frame(data.select(batch_id.alias("batch_id"), "*", pulled_at.alias("__pulled_at")))
