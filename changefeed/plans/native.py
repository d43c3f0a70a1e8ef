"""Direct capture: change tables -> tenant -> metadata -> merged target -> checkpoints -> log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.operators.apply import advance_checkpoints, apply_changes, initialise_checkpoints, live, retention_gaps
from changefeed.operators.columns import stamp_metadata
from changefeed.operators.monitor import log_batch
from changefeed.operators.registry import resolve_tenant
from changefeed.operators.rules import run_rules
from changefeed.sources.feeds import feed_bounds, scan_after_checkpoints
from changefeed.sources.layout import PositionedFeed
from changefeed.spec import Position, TableSpec

DELETED = "__deleted"
FEED_KEYS = ["customer_id", "table_name"]


@dataclass(frozen=True)
class Pulled:
    """What one pull yields: rows to merge, and the feeds that lost changes."""

    rows: DataFrame
    lost: DataFrame


def pull(feed: DataFrame, spec: TableSpec, checkpoints: DataFrame, bounds: DataFrame, now: Column) -> Pulled:
    """Changes of all tenants of a table since their checkpoints, stamped and through the source rules.

    ``feed`` carries customer_id and table_name beside the change columns. A feed without a
    checkpoint starts at its lowest valid position; one whose checkpoint is older than that
    has lost changes and is left out.
    """
    p = spec.position
    known = initialise_checkpoints(checkpoints, bounds, FEED_KEYS)
    lost = retention_gaps(known, bounds, FEED_KEYS)
    changes = scan_after_checkpoints(feed, known, FEED_KEYS, p, spec.op)
    changes = changes.join(lost.select(*FEED_KEYS), FEED_KEYS, "left_anti")
    stamped = stamp_metadata(
        changes,
        "native",
        now,
        F.lit(spec.database),
        F.lit(spec.table),
        op=F.col(spec.op),
        lsn=F.col(p.lsn),
        seq=F.col(p.seq),
    )
    return Pulled(run_rules(stamped, spec.rules, "source", target_keys(spec)), lost)


def pull_positioned(feed: PositionedFeed, spec: TableSpec, checkpoints: DataFrame, now: Column) -> Pulled:
    """``pull`` from a feed laid out by position: only ranges from the lowest cursor on are read, once."""
    return pull(feed.after(checkpoints), spec, checkpoints, feed.bounds(), now)


def target_keys(spec: TableSpec) -> list[str]:
    """Keys of the target, led by the tenant."""
    return ["customer_id", *[k for k in spec.keys if k.casefold() != "customer_id"]]


def merge(target: DataFrame, rows: DataFrame, spec: TableSpec, guard: bool = True, stage: bool = True) -> DataFrame:
    """The target after a pull, deletes kept as rows flagged in ``DELETED``; readers take ``current`` of it.

    A target without that column gets it. As a delete keeps its position, changes delivered again cannot bring its row
    back. The pulled rows, one a key, are written to the shared folder first unless ``stage`` is off, so that the
    size they have, not an estimate, decides how they meet the target.
    """
    if DELETED not in target.columns:
        target = target.withColumn(DELETED, F.lit(False))
    order = ("__source_start_lsn", "__source_seqval")
    return apply_changes(target, rows, target_keys(spec), "hard", order, "__cdc_operation", guard=guard, tombstone=DELETED, stage=stage)


def current(target: DataFrame) -> DataFrame:
    """The rows of a merged target that are not deleted."""
    return live(target, DELETED)


def log_rows(rows: DataFrame, schema: str, table: str, now: Column, duration_ms: Column | None = None) -> DataFrame:
    """The processing log of a pull: a row per tenant with the number of its changes and the positions they span."""
    lsn = F.col("__source_start_lsn")
    counts = rows.groupBy("customer_id").agg(F.count("*").alias("records_processed"), F.min(lsn).alias("min_start_lsn"), F.max(lsn).alias("max_start_lsn"))
    return log_batch(counts, schema, table, now, duration_ms)


def checkpoints_after(checkpoints: DataFrame, rows: DataFrame) -> DataFrame:
    """The checkpoints after a pull."""
    return advance_checkpoints(checkpoints, rows, FEED_KEYS, Position("__source_start_lsn", "__source_seqval"))


def with_tenants(feed: DataFrame, instances: DataFrame, customers: DataFrame, registrations: DataFrame, tables: Sequence[str] = ()) -> DataFrame:
    """Change rows with the tenant of their source instance; unregistered and disabled ones drop out."""
    rows = feed.filter(F.col("logical_table_name").isin(*tables)) if tables else feed
    return resolve_tenant(rows, instances, customers, registrations).withColumn("table_name", F.col("logical_table_name"))


def bounds_of(feed: DataFrame, spec: TableSpec) -> DataFrame:
    """Lowest and highest position per tenant and table."""
    return feed_bounds(feed, FEED_KEYS, spec.position)
