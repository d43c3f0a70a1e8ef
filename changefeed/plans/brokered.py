"""Brokered capture: change rows -> envelopes -> topic; topic -> rows -> rules -> routes -> soft merge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefeed.functions.expressions import message_key, topic_name
from changefeed.operators.apply import apply_changes
from changefeed.operators.routing import flag_routes
from changefeed.operators.rules import run_route_rules, run_rules
from changefeed.sources.feeds import derive_route, drop_before_images, parse_envelope, unwrap_envelope, wrap_envelope
from changefeed.sources.topics import topic_rows
from changefeed.spec import Rule, TableSpec

BROKER_ORDER = ("__source_ts_ms", "__kafka_partition", "__kafka_offset")


def publish(feed: DataFrame, spec: TableSpec, data: Sequence[str], now_ms: Column) -> DataFrame:
    """Topic rows (topic, key, value) of a change feed: before-images dropped, source rules applied."""
    rows = run_rules(drop_before_images(feed, spec.op), spec.rules, "source", spec.keys)
    outputs = [r.output for r in spec.rules if r.stage == "source" and r.output]
    wrapped = wrap_envelope(rows, [*data, *outputs], spec, now_ms)
    topic = topic_name(spec.topic_prefix, F.lit(spec.schema), F.lit(spec.table), spec.topic_format)
    return topic_rows(wrapped, topic, message_key(spec.keys), F.struct("payload"))


def consume(
    messages: DataFrame,
    data: T.StructType,
    sync_time: Column,
    rules: Mapping[tuple[str, str], Sequence[Rule]] | None = None,
    keep: Sequence[str] = ("kafka_partition", "kafka_offset"),
    keys: Mapping[tuple[str, str], Sequence[str]] | None = None,
) -> DataFrame:
    """Flat rows of topic messages with route, operation and broker metadata; sink rules applied."""
    parsed = derive_route(parse_envelope(messages, data))
    broker = {c: f"__{c}" for c in keep}
    rows = unwrap_envelope(
        parsed.withColumnsRenamed(broker), [*broker.values(), "__routing_schema", "__routing_table"], sync_time
    )
    return run_route_rules(rows, rules or {}, keys_by_route=keys)


def merge(target: DataFrame, rows: DataFrame, keys: Sequence[str], stage: bool = True) -> DataFrame:
    """Soft merge: every operation is an upsert, a delete leaves a row that says DELETE. ``stage`` as in the native plan."""
    return apply_changes(target, rows, keys, "soft", order=BROKER_ORDER, op="__cdc_operation", stage=stage)


def routed(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows that have a route, with their target."""
    return flag_routes(rows, routes).filter(F.col("__target").isNotNull())
