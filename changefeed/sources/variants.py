"""Envelopes without a schema: messages parsed to Variant, fields taken by path, and the schema that messages show.

A topic may carry many tables, and a table's columns may change while messages flow. So the payload stays
one Variant column; a table's fields are read from it by name, and what messages hold is compared with the catalog.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.functions.expressions import op_name
from changefeed.spec import BROKERED_SOURCE

# --- Fixed values -----------------------------------------------------------
NUMBERS = ("tinyint", "smallint", "int", "integer", "bigint", "decimal", "numeric", "money", "smallmoney", "float", "real", "double", "double precision")
TRUTH = ("bit", "bool", "boolean")
# --- End of fixed values ----------------------------------------------------


def parse_variant(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add ``payload``, the envelope's payload as a Variant; malformed text and text without one give null."""
    parsed = F.try_parse_json(F.col(value).cast("string"))
    return messages.withColumn("payload", F.try_variant_get(parsed, "$.payload", "variant")).drop(value)


def field(variant: Column, name: str, type_name: str) -> Column:
    """A field of a Variant object as a Spark type; null if absent or if it does not fit."""
    if "'" in name:
        raise ValueError(f"field name {name!r} holds a quote")
    return F.try_variant_get(variant, f"$['{name}']", type_name)


def image() -> Column:
    """The row that a message is about: the before image of a delete, else the after image."""
    payload = F.col("payload")
    before, after = (field(payload, n, "variant") for n in ("before", "after"))
    return F.when(field(payload, "op", "string") == "d", before).otherwise(after)


def source_field(name: str) -> Column:
    """A text of the envelope's source block."""
    return F.try_variant_get(F.col("payload"), f"$.source.{name}", "string")


def unwrap_variant(df: DataFrame, fields: Mapping[str, str], keep: Sequence[str] = (), sync_time: Column | None = None) -> DataFrame:
    """Flat rows of one table: ``fields`` (name -> Spark type) of the image, operation and source metadata."""
    row = df.withColumn("__image", image())
    meta = [
        op_name(field(F.col("payload"), "op", "string")).alias("__cdc_operation"),
        F.lit(BROKERED_SOURCE).alias("__source"),
        source_field("db").alias("__source_db"),
        source_field("table").alias("__source_table"),
        F.try_variant_get(F.col("payload"), "$.source.ts_ms", "long").alias("__source_ts_ms"),
    ]
    if sync_time is not None:
        meta.append(sync_time.alias("__sync_timestamp"))
    return row.select(*keep, *[field(F.col("__image"), n, t).alias(n) for n, t in fields.items()], *meta)


def observed_columns(df: DataFrame) -> DataFrame:
    """table_name, column_name, type_name, n: the columns that the messages of each table hold, with the type they all fit.

    A column seen only as null has the type VOID; one whose values fit no common type has VARIANT. Types are merged within
    each task first, so a table with most of the messages comes to a row a column and task.
    """
    rows = df.select(source_field("table").alias("table_name"), image().alias("__image"))
    rows = rows.where(F.col("table_name").isNotNull() & F.startswith(F.schema_of_variant("__image"), F.lit("OBJECT")))
    spread = df.sparkSession.sql("SELECT table_name, key, value FROM {rows}, LATERAL variant_explode(__image)", rows=rows)
    types = spread.groupBy("table_name", F.col("key").alias("column_name"))
    return types.agg(F.schema_of_variant_agg("value").alias("type_name"), F.count("*").alias("n"))


def _observed_family(type_name: Column) -> Column:
    number = type_name.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return (
        F.when(number, "number")
        .when(type_name == "BOOLEAN", "boolean")
        .when(type_name.rlike("^(OBJECT|ARRAY)"), "nested")
        .when(type_name == "VARIANT", "mixed")
        .when(type_name != "VOID", "text")
    )


def _declared_family(type_name: Column) -> Column:
    base = F.lower(F.trim(F.regexp_replace(type_name, r"\(.*", "")))
    nested = base.isin("json", "jsonb", "xml") | base.endswith("[]")
    return F.when(base.isin(*NUMBERS), "number").when(base.isin(*TRUTH), "boolean").when(nested, "nested").otherwise("text")


def message_drift(observed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Where messages and catalog (table_name, column_name, type_name) differ: table_name, column_name, drift, seen, declared.

    ``undeclared``: only messages have the column. ``absent``: no message of a table that has messages holds it. ``type``:
    its values are of another family (number, text, boolean, nested) than declared, or of several. Names
    compare without case. Nested values may be declared as text, and booleans as numbers (0, 1), or the other way round.
    """
    seen = observed.select(F.lower("table_name").alias("t"), F.lower("column_name").alias("c"), F.col("type_name").alias("seen"), F.struct("table_name", "column_name").alias("at"))
    held = seen.groupBy("t", "c").agg(F.max(F.struct("seen", "at")).alias("s"), F.count_distinct(_observed_family(F.col("seen"))).alias("families"))
    declared = catalog.join(observed.select(F.lower("table_name").alias("t")).distinct(), F.lower("table_name") == F.col("t"), "left_semi")
    declared = declared.groupBy(F.lower("table_name").alias("t"), F.lower("column_name").alias("c")).agg(F.min(F.struct("type_name", "table_name", "column_name")).alias("d"))
    j = held.join(declared, ["t", "c"], "full_outer")
    found, wanted = _observed_family(F.col("s.seen")), _declared_family(F.col("d.type_name"))
    near = (found == wanted) | ((found == "nested") & (wanted == "text")) | (found.isin("boolean", "number") & wanted.isin("boolean", "number"))
    drift = (
        F.when(F.col("d").isNull(), "undeclared")
        .when(F.col("s").isNull(), "absent")
        .when((F.col("families") > 1) | (found.isNotNull() & ~near), "type")
    )
    return j.withColumn("drift", drift).where("drift is not null").select(
        F.coalesce("d.table_name", "s.at.table_name").alias("table_name"),
        F.coalesce("d.column_name", "s.at.column_name").alias("column_name"),
        "drift",
        F.col("s.seen").alias("seen"),
        F.col("d.type_name").alias("declared"),
    )
