"""Change feeds: scanning, bounds, decoding, envelopes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefeed.functions.expressions import decode_op, op_name, position_struct
from changefeed.spec import (
    APPLIED_OPS,
    BROKERED_SOURCE,
    CHANGE_METADATA,
    OP_BEFORE_IMAGE,
    OP_DELETE,
    Position,
    TableSpec,
)


def _after(lsn: Column, seq: Column, after_lsn: Column, after_seq: Column) -> Column:
    """Strictly after a cursor; a cursor without a sequence admits its whole lsn again."""
    return (lsn > after_lsn) | ((lsn == after_lsn) & (after_seq.isNull() | (seq > after_seq)))


def scan_changes(
    df: DataFrame,
    after_lsn: object,
    after_seq: object = None,
    limit: int | None = None,
    composite: bool = True,
    ops: Sequence[int] | None = None,
    whole_transactions: bool = False,
    position: Position = Position(),
    op: str = "op_code",
) -> DataFrame:
    """Changes after a cursor, in log order: all of them, or the first ``limit``.

    ``composite`` uses (lsn, seq) and keeps only the operations that are applied; the
    single-column cursor uses ``lsn > after_lsn`` and keeps every operation. The cursor
    values are literals, so the comparison reaches the scan. With ``whole_transactions``
    the cap never cuts inside one lsn: all changes of the last lsn come along, so nothing
    is lost with a single-column cursor.
    """
    lsn, seq = F.col(position.lsn), F.col(position.seq)
    if composite:
        kept = F.col(op).isin(*(APPLIED_OPS if ops is None else ops))
        after = (lsn >= after_lsn) if after_seq is None else (lsn > after_lsn) | ((lsn == after_lsn) & (seq > after_seq))
        rows = df.filter(kept & after)
    else:
        rows = df.filter(lsn > after_lsn)
        if ops is not None:
            rows = rows.filter(F.col(op).isin(*ops))
    if limit is None:
        return rows.orderBy(lsn, seq)
    if whole_transactions:
        capped = rows.select(lsn.alias("lsn")).orderBy("lsn").limit(limit)
        return rows.filter(lsn <= capped.agg(F.max("lsn")).scalar())
    return rows.orderBy(lsn, seq).limit(limit)


def scan_after_checkpoints(
    df: DataFrame,
    checkpoints: DataFrame,
    keys: Sequence[str],
    position: Position = Position(),
    op: str = "op_code",
) -> DataFrame:
    """Applied changes of many feeds at once, each after its own stored cursor.

    A feed without a checkpoint is read from its beginning. Checkpoints hold one row per
    feed, so adaptive execution broadcasts them when they are small and otherwise splits
    the feeds that dominate the join.
    """
    cursors = checkpoints.select(
        *keys, F.col("last_start_lsn").alias("__after_lsn"), F.col("last_seqval").alias("__after_seq")
    )
    after = _after(F.col(position.lsn), F.col(position.seq), F.col("__after_lsn"), F.col("__after_seq"))
    return (
        df.filter(F.col(op).isin(*APPLIED_OPS))
        .join(cursors, list(keys), "left")
        .filter(F.col("__after_lsn").isNull() | after)
        .drop("__after_lsn", "__after_seq")
    )


def scan_snapshot(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The live base table, limited to the captured columns."""
    from changefeed.operators.columns import prune_columns

    return prune_columns(df, spec.include, spec.ignore, spec.keys)


def feed_bounds(df: DataFrame, keys: Sequence[str] = (), position: Position = Position()) -> DataFrame:
    """Lowest and highest position per feed: (min_lsn, max_lsn, max_seqval)."""
    top = F.max(position_struct(position.lsn, position.seq))
    return (
        df.groupBy(*keys)
        .agg(F.min(position.lsn).alias("min_lsn"), top.alias("__top"))
        .select(*keys, "min_lsn", F.col("__top.lsn").alias("max_lsn"), F.col("__top.seq").alias("max_seqval"))
    )


def last_position(batch: DataFrame, position: Position = Position()) -> DataFrame:
    """One row: the last position of a batch."""
    top = F.max(position_struct(position.lsn, position.seq)).alias("__top")
    return batch.agg(top).select(
        F.col("__top.lsn").alias("last_start_lsn"), F.col("__top.seq").alias("last_seqval")
    )


def union_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    """Many feeds as one; columns a feed lacks are null."""
    if not feeds:
        raise ValueError("at least one feed is required")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def scan_outbox(df: DataFrame, limit: int = 100) -> DataFrame:
    """Outbox rows not processed yet, oldest change first."""
    return df.filter(~F.col("processed")).orderBy("changed_at", "id").limit(limit)


def drop_before_images(df: DataFrame, op: str = "op_code") -> DataFrame:
    """Drop before-images; rows without an operation code stay."""
    code = F.col(op)
    return df.filter(code.isNull() | (code != OP_BEFORE_IMAGE))


def strip_metadata(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Drop the columns a change table adds to the data."""
    return df.drop(*CHANGE_METADATA, *extra)


def require_lsn(df: DataFrame, lsn: str = "max_lsn") -> DataFrame:
    """Drop rows without a log position (null, or the text ``null``)."""
    return df.filter(F.col(lsn).isNotNull() & (F.col(lsn).cast("string") != "null"))


def wrap_envelope(
    df: DataFrame,
    data: Sequence[str],
    spec: TableSpec,
    now_ms: Column,
    version: str = "1.0.0",
    connector: str = "changefeed",
    strict: bool = False,
) -> DataFrame:
    """Add ``payload``: operation, before or after image, source block and time.

    A delete carries its row as ``before``, everything else as ``after``.
    """
    row = F.struct(*[F.col(c) for c in data])
    is_delete = F.col(spec.op) == OP_DELETE
    source = F.struct(
        F.lit(version).alias("version"),
        F.lit(connector).alias("connector"),
        F.lit(spec.topic_prefix).alias("name"),
        now_ms.alias("ts_ms"),
        F.lit(spec.database).alias("db"),
        F.lit(spec.schema).alias("schema"),
        F.lit(spec.table).alias("table"),
    )
    payload = F.struct(
        decode_op(spec.op, strict=strict).alias("op"),
        F.when(is_delete, row).alias("before"),
        F.when(~is_delete | F.col(spec.op).isNull(), row).alias("after"),
        source.alias("source"),
        now_ms.alias("ts_ms"),
    )
    return df.withColumn("payload", payload)


def envelope_schema(data: T.StructType) -> T.StructType:
    """Schema of the JSON envelope around rows of ``data``."""
    source = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("version", "connector", "name")]
        + [T.StructField("ts_ms", T.LongType())]
        + [T.StructField(n, T.StringType()) for n in ("db", "schema", "table")]
    )
    payload = T.StructType(
        [
            T.StructField("op", T.StringType()),
            T.StructField("before", data),
            T.StructField("after", data),
            T.StructField("source", source),
            T.StructField("ts_ms", T.LongType()),
        ]
    )
    return T.StructType([T.StructField("payload", payload)])


def parse_envelope(df: DataFrame, data: T.StructType, value: str = "value") -> DataFrame:
    """Parse JSON envelopes with a fixed schema; malformed text gives a null payload."""
    parsed = F.from_json(F.col(value).cast("string"), envelope_schema(data))
    return df.withColumn("payload", parsed["payload"]).drop(value)


def unwrap_envelope(df: DataFrame, keep: Sequence[str] = (), sync_time: Column | None = None) -> DataFrame:
    """Flatten ``payload`` to data columns plus operation and source metadata.

    A delete takes its before image, anything else its after image.
    """
    p = F.col("payload")
    data = df.schema["payload"].dataType["after"].dataType.names
    is_delete = p["op"] == "d"
    columns = [F.when(is_delete, p["before"][c]).otherwise(p["after"][c]).alias(c) for c in data]
    meta = [
        op_name(p["op"]).alias("__cdc_operation"),
        F.lit(BROKERED_SOURCE).alias("__source"),
        p["source"]["db"].alias("__source_db"),
        p["source"]["table"].alias("__source_table"),
        p["source"]["ts_ms"].alias("__source_ts_ms"),
    ]
    if sync_time is not None:
        meta.append(sync_time.alias("__sync_timestamp"))
    return df.select(*[c for c in keep if c not in data], *columns, *meta)


def derive_route(df: DataFrame, topic: str = "topic", table: Column | None = None) -> DataFrame:
    """Add the route: schema from the topic's second part, table from the envelope.

    Without an envelope the table is the topic's last part.
    """
    parts = F.split(F.col(topic), r"\.")
    if table is None:
        table = F.col("payload.source.table") if "payload" in df.columns else F.element_at(parts, -1)
    return df.withColumns(
        {"__routing_schema": F.try_element_at(parts, F.lit(2)), "__routing_table": table}
    )
