"""Streams into keyed targets: one target, or one for each kind of table that a stream carries rows of.

A micro-batch is merged into every target it has rows for, each merge repeatable by itself. After a crash between two
targets the engine repeats the batch: targets that have it already keep their rows, the others get it. Positions and
log rows of a batch are written to a folder of its number, so a repeated batch replaces its own.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from changefeed.functions.expressions import position_struct
from changefeed.operators.routing import ROUTE, flag_routes
from changefeed.plans.files import SharedFiles
from changefeed.plans.partitioned import PartitionedTarget
from changefeed.spec import Position

ROUTE_COUNTS = "routes"
MERGES_AT_ONCE = 8
SINK_PERIOD = "5 seconds"


def _trigger(period: str | None) -> dict[str, object]:
    return {"processingTime": period} if period else {"availableNow": True}


class BatchLog:
    """What each batch leaves beside the targets: the positions it reached and its log rows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), SharedFiles(spark, root)

    def put(self, kind: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{kind}/batch={batch_id}")

    def get(self, kind: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{kind}") if self.files.names(kind) else None

    def put_positions(self, batch: DataFrame, feed: Sequence[str], position: Position, batch_id: int) -> None:
        top = batch.groupBy(*feed).agg(F.max(position_struct(*position.columns)).alias("p"))
        self.put("positions", top.select(*feed, F.col("p.lsn").alias("last_start_lsn"), F.col("p.seq").alias("last_seqval")), batch_id)

    def checkpoints(self, feed: Sequence[str]) -> DataFrame | None:
        """The highest position of each feed in all batches."""
        rows = self.get("positions")
        if rows is None:
            return None
        top = rows.groupBy(*feed).agg(F.max(position_struct("last_start_lsn", "last_seqval")).alias("p"))
        return top.select(*feed, F.col("p.lsn").alias("last_start_lsn"), F.col("p.seq").alias("last_seqval"))


def _persisted(work: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A batch is read several times; it is kept meanwhile, so that its source and its counts run once."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                work(batch, batch_id)
        finally:
            batch.unpersist()

    return one_batch


def stream_apply(
    stream: DataFrame,
    target: PartitionedTarget,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    mode: str = "hard",
    order: Sequence[str] = Position().columns,
    op: str = "op_code",
    feed: Sequence[str] = (),
    log: Callable[[DataFrame], DataFrame] | None = None,
    period: str | None = SINK_PERIOD,
) -> StreamingQuery:
    """Keep a target up to date with a stream of changes; ``batch_log(target)`` has its positions and log rows.

    Without a period everything available is applied and the query ends.
    """
    notes = batch_log(target)

    def work(batch: DataFrame, batch_id: int) -> None:
        target.merge(prepare(batch), batch_id, mode, order, op)
        if feed:
            notes.put_positions(batch, feed, Position(*order), batch_id)
        if log:
            notes.put("log", log(batch), batch_id)
        target.forget(batch_id - 1)

    return stream.writeStream.foreachBatch(_persisted(work)).option("checkpointLocation", checkpoint).trigger(**_trigger(period)).start()


def batch_log(target: PartitionedTarget) -> BatchLog:
    return BatchLog(target.spark, f"{target.root}/batches")


@dataclass(frozen=True)
class RoutedTable:
    """Where rows of one kind of table go, whichever schema they are routed to."""

    target: PartitionedTarget
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df


def routed_apply(
    stream: DataFrame,
    routes: DataFrame,
    tables: Mapping[str, RoutedTable],
    checkpoint: str,
    mode: str = "soft",
    order: Sequence[str] = ("__source_ts_ms", "__kafka_partition", "__kafka_offset"),
    op: str = "__cdc_operation",
    period: str | None = SINK_PERIOD,
) -> StreamingQuery:
    """Keep many targets up to date with one stream of routed rows (see ``sources.feeds.derive_route``).

    ``routes`` (schema_name, table_name, target) says which routes exist; ``tables`` names the target of each table.
    All schemas that have a table share its target, whose partitions are the schemas, or groups of them that
    ``prepare`` adds where schemas are many and small, so a micro-batch takes one merge for each table and not one for
    each route. Rows without a route, or whose table has no
    target, are dropped and counted: see ``RouteCounts``.
    """
    served = routes.where(F.col("table_name").isin(list(tables)))

    def work(batch: DataFrame, batch_id: int) -> None:
        known = batch.where(F.col("__target").isNotNull())
        present = {r[0] for r in known.select(ROUTE[1]).distinct().collect()}  # at most the tables named above

        def merge(name: str) -> None:
            table = tables[name]
            table.target.merge(table.prepare(known.where(F.col(ROUTE[1]) == name)), batch_id, mode, order, op)

        # Tables do not depend on each other, so their jobs run side by side; any failure fails the batch.
        with ThreadPoolExecutor(MERGES_AT_ONCE) as pool:
            list(pool.map(merge, sorted(present)))
        for name in present:
            tables[name].target.forget(batch_id - 1)

    flagged = flag_routes(stream, served, ROUTE_COUNTS)
    return flagged.writeStream.foreachBatch(_persisted(work)).option("checkpointLocation", checkpoint).trigger(**_trigger(period)).start()


class RouteCounts(StreamingQueryListener):
    """Adds up how many rows streams routed and dropped; ``warn`` is called with the number a batch dropped."""

    def __init__(self, warn: Callable[[int], None] = lambda n: None) -> None:
        self.routed = self.dropped = 0
        self.warn, self._lock = warn, threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        counts = event.progress.observedMetrics.get(ROUTE_COUNTS)
        if counts is None:
            return
        with self._lock:
            self.routed += counts["routed"] or 0
            self.dropped += counts["dropped"] or 0
        if counts["dropped"]:
            self.warn(counts["dropped"])

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass

