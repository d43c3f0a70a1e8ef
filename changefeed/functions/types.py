"""Type names across engines: mapping, normalising, compatibility, Spark casts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from changefeed.functions.expressions import _col, lookup

# --- Fixed values -----------------------------------------------------------
FALLBACK_TYPE = "text"

# SQL Server type -> PostgreSQL type.
MSSQL_TO_PG = {
    "tinyint": "smallint",
    "smallint": "smallint",
    "int": "integer",
    "bigint": "bigint",
    "decimal": "numeric",
    "numeric": "numeric",
    "float": "double precision",
    "real": "real",
    "money": "numeric",
    "smallmoney": "numeric",
    "char": "char",
    "varchar": "varchar",
    "nchar": "char",
    "nvarchar": "varchar",
    "text": "text",
    "ntext": "text",
    "bit": "boolean",
    "date": "date",
    "time": "time",
    "datetime": "timestamp",
    "datetime2": "timestamp",
    "datetimeoffset": "timestamptz",
    "smalldatetime": "timestamp",
    "uniqueidentifier": "uuid",
    "binary": "bytea",
    "varbinary": "bytea",
    "image": "bytea",
    "xml": "xml",
    "sql_variant": "text",
    "hierarchyid": "text",
    "geometry": "text",
    "geography": "text",
    "timestamp": "bytea",
    "rowversion": "bytea",
}

# PostgreSQL type name -> canonical PostgreSQL type name.
PG_TO_PG = {
    "smallint": "smallint",
    "integer": "integer",
    "bigint": "bigint",
    "serial": "serial",
    "bigserial": "bigserial",
    "numeric": "numeric",
    "real": "real",
    "double precision": "double precision",
    "int2": "smallint",
    "int4": "integer",
    "int8": "bigint",
    "float4": "real",
    "float8": "double precision",
    "text": "text",
    "varchar": "varchar",
    "character varying": "varchar",
    "char": "char",
    "character": "char",
    "citext": "citext",
    "name": "text",
    "boolean": "boolean",
    "bool": "boolean",
    "date": "date",
    "time": "time",
    "time without time zone": "time",
    "time with time zone": "timetz",
    "timetz": "timetz",
    "timestamp": "timestamp",
    "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamptz",
    "timestamptz": "timestamptz",
    "interval": "interval",
    "uuid": "uuid",
    "json": "json",
    "jsonb": "jsonb",
    "bytea": "bytea",
    "inet": "inet",
    "cidr": "cidr",
    "macaddr": "macaddr",
    "text[]": "text[]",
    "integer[]": "integer[]",
    "uuid[]": "uuid[]",
    "jsonb[]": "jsonb[]",
    "boolean[]": "boolean[]",
    "bigint[]": "bigint[]",
    "varchar[]": "varchar[]",
    "oid": "oid",
    "money": "money",
    "xml": "xml",
    "USER-DEFINED": "text",
    "ARRAY": "text[]",
}

# PostgreSQL type -> Spark SQL type.
PG_TO_SPARK = {
    "smallint": "smallint",
    "integer": "int",
    "serial": "int",
    "bigint": "bigint",
    "bigserial": "bigint",
    "oid": "bigint",
    "numeric": "decimal(38,10)",
    "money": "decimal(19,4)",
    "double precision": "double",
    "real": "float",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp",
    "bytea": "binary",
    "text[]": "array<string>",
    "varchar[]": "array<string>",
    "uuid[]": "array<string>",
    "jsonb[]": "array<string>",
    "integer[]": "array<int>",
    "bigint[]": "array<bigint>",
    "boolean[]": "array<boolean>",
}
MONEY_TO_SPARK = {"money": "decimal(19,4)", "smallmoney": "decimal(10,4)"}

# Compatibility of SQL Server sources with PostgreSQL sinks.
MSSQL_SOURCE_ALIASES = {"integer": "int"}
PG_SINK_ALIASES = {
    "int2": "smallint",
    "int4": "integer",
    "int8": "bigint",
    "decimal": "numeric",
    "bool": "boolean",
    "varchar": "character varying",
    "char": "character",
    "timestamptz": "timestamp with time zone",
    "timestamp": "timestamp without time zone",
    "float8": "double precision",
    "float4": "real",
}
MSSQL_PG_EXACT = {
    "bigint": "bigint",
    "int": "integer",
    "smallint": "smallint",
    "tinyint": "smallint",
    "bit": "boolean",
    "decimal": "numeric",
    "numeric": "numeric",
    "money": "numeric",
    "smallmoney": "numeric",
    "float": "double precision",
    "real": "real",
    "date": "date",
    "datetime": "timestamp without time zone",
    "datetime2": "timestamp without time zone",
    "smalldatetime": "timestamp without time zone",
    "datetimeoffset": "timestamp with time zone",
    "time": "time without time zone",
    "char": "character",
    "nchar": "character",
    "varchar": "character varying",
    "nvarchar": "character varying",
    "text": "text",
    "ntext": "text",
    "binary": "bytea",
    "varbinary": "bytea",
    "image": "bytea",
    "rowversion": "bytea",
    "timestamp": "bytea",
    "uniqueidentifier": "uuid",
    "xml": "xml",
    "json": "jsonb",
    "sql_variant": "jsonb",
    "geography": "text",
    "geometry": "text",
}
ANY_SOURCE = "*"
MSSQL_PG_CASTABLE = {
    "*": ("text", "character varying", "character"),
    "tinyint": ("smallint", "integer", "bigint", "numeric", "real", "double precision"),
    "int": ("integer", "bigint", "numeric", "real", "double precision"),
    "smallint": ("smallint", "integer", "bigint", "numeric", "real", "double precision"),
    "bigint": ("bigint", "numeric", "real", "double precision"),
    "decimal": ("numeric", "real", "double precision"),
    "numeric": ("numeric", "real", "double precision"),
    "real": ("real", "double precision"),
    "datetime": ("timestamp without time zone", "timestamp with time zone"),
    "datetime2": ("timestamp without time zone", "timestamp with time zone"),
    "smalldatetime": ("timestamp without time zone", "timestamp with time zone"),
    "date": ("date", "timestamp without time zone", "timestamp with time zone"),
}
PG_ALIASES = {
    "int": "integer",
    "int2": "smallint",
    "int4": "integer",
    "int8": "bigint",
    "decimal": "numeric",
    "varchar": "character varying",
    "char": "character",
    "timestamp": "timestamp without time zone",
    "timestamptz": "timestamp with time zone",
    "bool": "boolean",
    "float4": "real",
    "float8": "double precision",
}
PG_BASE_TYPES = (
    "smallint",
    "integer",
    "bigint",
    "numeric",
    "real",
    "double precision",
    "boolean",
    "uuid",
    "text",
    "character",
    "character varying",
    "date",
    "time without time zone",
    "timestamp without time zone",
    "timestamp with time zone",
    "bytea",
    "json",
    "jsonb",
    "xml",
    "user-defined",
)
PG_CASTABLE = {
    "smallint": ("smallint", "integer", "bigint", "numeric", "real", "double precision"),
    "integer": ("integer", "bigint", "numeric", "real", "double precision"),
    "bigint": ("bigint", "numeric", "real", "double precision"),
    "numeric": ("numeric", "real", "double precision"),
    "real": ("real", "double precision"),
    "date": ("date", "timestamp without time zone", "timestamp with time zone"),
    "timestamp without time zone": ("timestamp without time zone", "timestamp with time zone"),
}
TEXT_MARKERS = ("char", "text", "string", "varchar", "nvarchar", "nchar", "citext", "user-defined")
UUID_MARKERS = ("uuid", "uniqueidentifier")
NUMERIC_MARKERS = (
    "int",
    "integer",
    "bigint",
    "smallint",
    "tinyint",
    "numeric",
    "decimal",
    "float",
    "double",
    "real",
    "money",
)
# --- End of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class CompatibilityMap:
    """Which source types a sink type accepts."""

    exact: Mapping[str, str]
    castable: Mapping[str, Sequence[str]] = field(default_factory=dict)
    source_aliases: Mapping[str, str] = field(default_factory=dict)
    sink_aliases: Mapping[str, str] = field(default_factory=dict)


MSSQL_PG = CompatibilityMap(MSSQL_PG_EXACT, MSSQL_PG_CASTABLE, MSSQL_SOURCE_ALIASES, PG_SINK_ALIASES)
# Between PostgreSQL databases every base type accepts itself, and numbers and times widen.
PG_PG = CompatibilityMap({name: name for name in PG_BASE_TYPES}, PG_CASTABLE, PG_ALIASES, PG_ALIASES)


def base_type(col: Column | str) -> Column:
    """Type name without parameters, in lower case: ``NVarChar(50)`` -> ``nvarchar``."""
    plain = F.regexp_replace(_col(col), r"\s*\([^)]*\)", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def reverse_mapping(mapping: Mapping[str, str]) -> dict[str, str]:
    """Swap keys and values; of several keys with one value the first is kept."""
    out: dict[str, str] = {}
    for source, target in mapping.items():
        out.setdefault(target, source)
    return out


def map_type(col: Column | str, mapping: Mapping[str, str] = MSSQL_TO_PG, fallback: str = FALLBACK_TYPE) -> Column:
    """Target type name: exact match, then without case, then without parameters, then fallback."""
    folded: dict[str, str] = {}
    for source, target in mapping.items():
        folded.setdefault(source.lower(), target)
    name = _col(col)
    return F.coalesce(
        lookup(mapping, name),
        lookup(folded, F.lower(name)),
        lookup(folded, base_type(name)),
        F.lit(fallback),
    )


def map_type_name(source_type: str, mapping: Mapping[str, str] = MSSQL_TO_PG, fallback: str = FALLBACK_TYPE) -> str:
    """``map_type`` for one name, used when a plan is built from a table spec."""
    folded: dict[str, str] = {}
    for source, target in mapping.items():
        folded.setdefault(source.lower(), target)
    bare = source_type.split("(")[0].strip().lower()
    return mapping.get(source_type) or folded.get(source_type.lower()) or folded.get(bare, fallback)


def spark_type(source_type: str, mapping: Mapping[str, str] = MSSQL_TO_PG) -> str:
    """Spark SQL type a source column is cast to."""
    bare = source_type.split("(")[0].strip().lower()
    if mapping is MSSQL_TO_PG and bare in MONEY_TO_SPARK:
        return MONEY_TO_SPARK[bare]
    return PG_TO_SPARK.get(map_type_name(source_type, mapping), "string")


def normalize_for_compare(col: Column | str) -> Column:
    """One spelling per type, for comparing a declared type with a catalog's."""
    text = F.trim(F.regexp_replace(F.lower(_col(col)), r"\s+", " "))
    return (
        F.when(text.startswith("varchar"), F.regexp_replace(text, "^varchar", "character varying"))
        .when(text == "timestamp", F.lit("timestamp without time zone"))
        .when(text == "timestamptz", F.lit("timestamp with time zone"))
        .otherwise(text)
    )


def compatible(source: Column | str, sink: Column | str, spec: CompatibilityMap = MSSQL_PG) -> Column:
    """Whether a sink type takes a source type: exact, listed as castable, or open to any source."""
    src, dst = base_type(source), base_type(sink)
    src = F.coalesce(lookup(spec.source_aliases, src), src)
    dst = F.coalesce(lookup(spec.sink_aliases, dst), dst)
    pairs = [f"{s}>{t}" for s, targets in spec.castable.items() for t in targets if s != ANY_SOURCE]
    pairs += [f"{s}>{t}" for s, t in spec.exact.items()]
    accepted = F.concat_ws(">", src, dst).isin(*dict.fromkeys(pairs))
    return accepted | dst.isin(*spec.castable.get(ANY_SOURCE, ("",)))


def has_marker(col: Column | str, markers: Sequence[str]) -> Column:
    """Whether a type name contains any of the markers."""
    return base_type(col).rlike("|".join(markers))


def mapping_accepts(source: Column | str, sink: Column | str, spec: CompatibilityMap = MSSQL_PG) -> Column:
    """``compatible``, and text sinks also take numbers and uuids."""
    to_text = has_marker(sink, TEXT_MARKERS) & (has_marker(source, NUMERIC_MARKERS) | has_marker(source, UUID_MARKERS))
    return to_text | compatible(source, sink, spec)
