"""Snapshot bootstrap end to end: plan -> boundary -> slices -> checkpoints -> states -> feeds switched on.

The boundary of each tenant is fixed, written down, before its snapshot is read, so changes made meanwhile come
again after it and apply on top. Only the partitions of the tenants at hand are rewritten. The frames that a run
returns are what its caller stores; nothing but the target is written here, and a run can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.operators.apply import bootstrap_checkpoints
from changefeed.operators.columns import stamp_metadata
from changefeed.operators.registry import FEED, enable_feeds, record_bootstrap
from changefeed.plans.partitioned import DELETED, PartitionedTarget
from changefeed.session import shared_dir

NO_POSITION = "the source has no position for this table"


@dataclass(frozen=True)
class Bootstrapped:
    """What a run leaves: a result for each feed, and the control tables after it."""

    results: DataFrame  # the feed, tenant, rows_loaded, start_lsn, seqval, error (null: loaded)
    checkpoints: DataFrame
    states: DataFrame
    registrations: DataFrame
    policies: DataFrame


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bootstrap_tables(
    target: PartitionedTarget,
    snapshot: DataFrame,
    plan: DataFrame,
    tenants: DataFrame,
    bounds: DataFrame,
    checkpoints: DataFrame,
    states: DataFrame,
    registrations: DataFrame,
    policies: DataFrame,
    table: str,
    now: Column,
    run_id: str,
    database: str = "",
    enable_after: bool = True,
) -> Bootstrapped:
    """Load the slices of one table for all feeds that ``plan`` (see ``bootstrap_plan``) calls eligible.

    ``target`` is partitioned by one tenant column, which ``snapshot``, ``tenants`` (source_instance_key, tenant) and
    ``bounds`` (tenant, max_lsn, max_seqval) carry too. A feed without a boundary fails and keeps its rows. A
    slice without rows is emptied. Tenants of no feed in the plan are not touched.
    """
    (tenant,) = target.partition
    due = plan.where((F.col("result_status") == "eligible") & (F.lower("logical_table_name") == table.lower())).select(*FEED)
    edges = bounds.groupBy(tenant).agg(F.max(F.struct(F.col("max_lsn").alias("lsn"), F.col("max_seqval").alias("seq"))).alias("edge"))
    slices = due.join(tenants.select("source_instance_key", tenant), "source_instance_key").join(edges, tenant, "left")
    slices = _written(slices.select(*FEED, tenant, F.col("edge.lsn").alias("start_lsn"), F.col("edge.seq").alias("seqval")), "boundaries")
    ready = slices.where(F.col("start_lsn").isNotNull()).select(tenant, "start_lsn", "seqval").distinct()
    loaded = stamp_metadata(snapshot.join(ready, tenant), "snapshot", now, database, table, lsn=F.col("start_lsn"), seq=F.col("seqval"))
    columns = [(F.col(c) if c in loaded.columns else F.lit(None).cast(target.schema[c].dataType)).alias(c) for c in target.schema.names]
    target.replace(loaded.select(*columns), target.parts_of(ready), run_id)
    counts = target.stored().where(~F.col(DELETED)).join(ready.select(tenant), tenant, "left_semi").groupBy(tenant).agg(F.count("*").alias("n"))
    failed = F.col("start_lsn").isNull()
    results = slices.join(counts, tenant, "left").select(
        *FEED,
        tenant,
        F.when(~failed, F.coalesce("n", F.lit(0))).otherwise(0).alias("rows_loaded"),
        "start_lsn",
        "seqval",
        F.when(failed, NO_POSITION).alias("error"),
    )
    results = _written(results, "bootstrapped")
    done = results.where(F.col("error").isNull())
    switched = (enable_feeds(registrations, done), enable_feeds(policies, done)) if enable_after else (registrations, policies)
    after = bootstrap_checkpoints(checkpoints, done.select(tenant, "start_lsn", "seqval").distinct(), tenant, table)
    return Bootstrapped(results, after, record_bootstrap(states, results, now), *switched)
