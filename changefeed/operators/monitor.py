"""Operational questions answered as queries: lag, gaps, health, latency, retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changefeed.functions.expressions import position_struct
from changefeed.operators.neighbours import next_row, previous_row

# --- Fixed values -----------------------------------------------------------
RECENT_ERRORS = 100
LAG_WARNING_MS = 5 * 60 * 1000
LAG_CRITICAL_MS = 15 * 60 * 1000
FEED_WARNING_ROWS = 100_000
FEED_CRITICAL_ROWS = 500_000
MERGE_QUIET_SECONDS = 5
TRACE_RETENTION_HOURS = 48
TRACE_STAGES = {
    "lag_capture_ms": "capture",
    "lag_kafka_produce_ms": "produce",
    "lag_kafka_consume_ms": "consume",
    "lag_sink_write_ms": "sink",
    "lag_merge_ms": "merge",
}
TRACE_TIMES = (
    "source_modified_at",
    "source_captured_at",
    "kafka_produced_at",
    "kafka_consumed_at",
    "staging_inserted_at",
    "target_merged_at",
)
PERCENTILES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
SLO_REPORTED_TOTAL_MS = 5000
SLO_LIMITS_MS = {
    "lag_capture_ms": ("capture > 1s", 1000),
    "lag_kafka_produce_ms": ("produce > 500ms", 500),
    "lag_kafka_consume_ms": ("consume > 2s", 2000),
    "lag_sink_write_ms": ("sink > 5s", 5000),
    "lag_merge_ms": ("merge > 3s", 3000),
    "lag_total_ms": ("total > 10s", 10000),
}
# --- End of fixed values ----------------------------------------------------


def batch_stats(batch: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Size and ranges of a merged batch (per key, if keys are given)."""
    return batch.groupBy(*keys).agg(
        F.count("*").alias("records_processed"),
        F.min("__source_ts_ms").alias("min_source_ts_ms"),
        F.max("__source_ts_ms").alias("max_source_ts_ms"),
        F.min("__kafka_offset").alias("min_kafka_offset"),
        F.max("__kafka_offset").alias("max_kafka_offset"),
        F.min("__kafka_partition").alias("kafka_partition"),
    )


def batch_counts(staging: DataFrame, batch_id: str = "batch_id") -> DataFrame:
    """Rows per staged batch."""
    return staging.groupBy(batch_id).agg(F.count("*").alias("rows_inserted"))


def log_batch(stats: DataFrame, schema: str, table: str, processed_at: Column, duration_ms: Column | None = None) -> DataFrame:
    """The processing-log row of a merged batch."""
    duration = duration_ms if duration_ms is not None else F.lit(None).cast("int")
    return stats.select(
        F.lit(schema).alias("schema_name"),
        F.lower(F.lit(table)).alias("table_name"),
        "*",
        duration.alias("merge_duration_ms"),
        processed_at.alias("processed_at"),
    )


def sync_health(log: DataFrame, now: Column) -> DataFrame:
    """Per tenant, table and topic: last activity, lag and silence, most delayed first."""
    epoch_ms = F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), now)
    return (
        log.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "table_name", "kafka_topic")
        .agg(
            F.max("max_source_ts_ms").alias("last_source_ts_ms"),
            F.max("processed_at").alias("last_processed_at"),
            F.sum("records_processed").alias("total_records"),
        )
        .withColumn("lag_ms", epoch_ms - F.col("last_source_ts_ms"))
        .withColumn("silence_seconds", F.timestamp_diff("SECOND", F.col("last_processed_at"), now))
        .orderBy(F.desc_nulls_last("lag_ms"))
    )


def activity_rollup(pulls: DataFrame, cap: Column | int, bucket: Column | None = None) -> DataFrame:
    """Hourly pull counters per feed.

    A failed pull counts as a pull and a failure, neither empty nor non-empty. ``cap`` is the
    size at which a batch counts as full.
    """
    rows, failed = F.col("rows_pulled"), F.col("failed")
    full = F.lit(cap) if isinstance(cap, int) else cap
    hour = F.date_trunc("hour", F.col("pulled_at")) if bucket is None else bucket
    return pulls.groupBy("source_instance_key", "logical_table_name", hour.alias("bucket_start")).agg(
        F.count("*").alias("pulls_total"),
        F.count_if(~failed & (rows == 0)).alias("empty_pulls_total"),
        F.count_if(~failed & (rows > 0)).alias("nonempty_pulls_total"),
        F.count_if(~failed & (rows >= full)).alias("full_batches_total"),
        F.sum(F.when(~failed, rows).otherwise(F.lit(0))).alias("rows_total"),
        F.count_if(failed).alias("failures_total"),
        F.max(F.when(~failed & (rows > 0), F.col("pulled_at"))).alias("last_nonempty_at"),
    )


def offset_gaps(log: DataFrame, bucket_width: int = 1_000_000) -> DataFrame:
    """Each logged batch with the start of the next one and the offsets missing in between.

    Batches follow each other per table, tenant and partition. A tenant may own a large
    share of the log, so the look-ahead works in ranges of ``bucket_width`` offsets.
    """
    tracked = log.filter(F.col("kafka_partition").isNotNull())
    linked = next_row(
        tracked,
        ["table_name", "customer_id", "kafka_partition"],
        ["min_kafka_offset"],
        [],
        F.floor(F.col("min_kafka_offset") / bucket_width),
        "__next",
    )
    following = F.col("__next.min_kafka_offset")
    return (
        linked.withColumn("batch_end_offset", F.col("max_kafka_offset"))
        .withColumn("next_batch_start", following)
        .withColumn("gap_size", following - F.col("max_kafka_offset") - 1)
        .drop("__next")
    )


def gap_alerts(log: DataFrame, bucket_width: int = 1_000_000) -> DataFrame:
    """Only the batches that are followed by missing offsets."""
    return offset_gaps(log, bucket_width).filter(F.col("gap_size") > 0)


def position_regressions(
    log: DataFrame, feed: Sequence[str], lsn: str = "start_lsn", seq: str = "seqval", tie: Sequence[str] = (), width: str = "hour"
) -> DataFrame:
    """Batches of a feed that ended below the batch before them, as after a lost cursor.

    ``tie`` orders batches of one time; without it their positions do. A feed is sorted in pieces of ``width``.
    """
    linked = previous_row(
        log, feed, ["processed_at", *(tie or [lsn, seq])], [lsn, seq], F.date_trunc(width, F.col("processed_at")), "__previous"
    )
    before = position_struct(F.col(f"__previous.{lsn}"), F.col(f"__previous.{seq}"))
    fell = F.col("__previous").isNotNull() & (before > position_struct(lsn, seq))
    return (
        linked.filter(fell)
        .withColumns({f"previous_{lsn}": F.col(f"__previous.{lsn}"), f"previous_{seq}": F.col(f"__previous.{seq}")})
        .drop("__previous")
    )


def with_total(df: DataFrame, name: str = "total_count") -> DataFrame:
    """Every row with the number of all rows.

    The total is a scalar subquery: one partial count, no window over the whole input.
    """
    return df.withColumn(name, df.agg(F.count("*")).scalar())


def recent_errors(log: DataFrame, n: int = RECENT_ERRORS) -> DataFrame:
    """The newest errors."""
    return log.orderBy(F.desc("occurred_at"), F.desc("id")).limit(n)


def merge_status(control: DataFrame) -> DataFrame:
    """Merge control rows with a status, latest change first and never-changed last."""
    status = F.when(F.col("is_merging"), "MERGING").when(F.col("has_changes"), "PENDING").otherwise("IDLE")
    return control.withColumn("status", status).orderBy(F.desc_nulls_last("last_change_at"))


def pending_merges(control: DataFrame, now: Column, window_s: int = MERGE_QUIET_SECONDS) -> DataFrame:
    """Tables with changes, not being merged, quiet for longer than the window; oldest first."""
    quiet = F.timestamp_diff("SECOND", F.col("last_change_at"), now)
    before = F.col("last_change_at") < now - F.make_interval(secs=F.lit(window_s))
    return (
        control.filter(F.col("has_changes") & ~F.col("is_merging") & before)
        .withColumn("seconds_pending", quiet)
        .orderBy("last_change_at")
    )


def merge_performance(control: DataFrame, now: Column) -> DataFrame:
    """Milliseconds per merged row, merges per minute and seconds pending per table."""
    active = F.timestamp_diff("SECOND", F.col("created_at"), now)
    return (
        control.filter(F.col("last_merge_at").isNotNull())
        .withColumns(
            {
                "ms_per_row": F.round(F.try_divide("last_merge_duration_ms", "last_merge_rows"), 2),
                "merges_per_minute": F.round(F.try_divide(F.col("merge_count") * F.lit(60.0), active), 2),
                "seconds_pending": F.when(
                    F.col("has_changes"), F.timestamp_diff("SECOND", F.col("last_change_at"), now)
                ),
            }
        )
        .orderBy(F.desc_nulls_last("last_merge_duration_ms"))
    )


def replication_lag(log: DataFrame, now: Column) -> DataFrame:
    """Lag of every logged batch with its alert level."""
    epoch_ms = F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), now)
    lag = epoch_ms - F.col("max_source_ts_ms")
    level = F.when(lag > LAG_CRITICAL_MS, "critical").when(lag > LAG_WARNING_MS, "warning").otherwise("ok")
    return (
        log.filter(F.col("max_source_ts_ms").isNotNull())
        .withColumns({"lag_ms": lag, "alert_level": level})
        .orderBy(F.desc("processed_at"))
    )


def feed_sizes(feeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per feed with a level once it grows large; largest first."""
    n = F.col("row_count")
    level = F.when(n > FEED_CRITICAL_ROWS, "critical").when(n > FEED_WARNING_ROWS, "warning").otherwise("ok")
    return feeds.groupBy(*keys).agg(F.count("*").alias("row_count")).withColumn("level", level).orderBy(F.desc("row_count"))


def stamp_trace(df: DataFrame, stage: str, at: Column, trace_id: Column | None = None) -> DataFrame:
    """Add the time a row passed a stage; the first stamp of a stage stays.

    ``trace_id`` names rows that have no trace yet.
    """
    if stage not in TRACE_TIMES:
        raise ValueError(f"unknown stage {stage!r}; known: {', '.join(TRACE_TIMES)}")
    stamped = df.withColumn(stage, F.coalesce(F.col(stage), at) if stage in df.columns else at)
    if trace_id is not None:
        known = "trace_id" in df.columns
        stamped = stamped.withColumn("trace_id", F.coalesce(F.col("trace_id"), trace_id) if known else trace_id)
    return stamped


def trace_lags(df: DataFrame) -> DataFrame:
    """Milliseconds between the six trace times, and in total."""
    steps = {
        name: F.timestamp_diff("MILLISECOND", F.col(a), F.col(b))
        for name, a, b in zip(TRACE_STAGES, TRACE_TIMES, TRACE_TIMES[1:])
    }
    steps["lag_total_ms"] = F.timestamp_diff("MILLISECOND", F.col(TRACE_TIMES[0]), F.col(TRACE_TIMES[-1]))
    return df.withColumns(steps)


def sample_traces(df: DataFrame, pct: int, trace_id: str = "trace_id") -> DataFrame:
    """About ``pct`` percent of the traces, the same ones on every run.

    A hash of the id replaces a random number, so a retried task keeps the same rows.
    """
    number = F.conv(F.substring(F.md5(F.col(trace_id)), 1, 8), 16, 10).cast("bigint")
    return df.filter(F.pmod(number, F.lit(100)) < pct)


def bottleneck(traces: DataFrame, since: Column) -> DataFrame:
    """Average latency per stage and the name of the slowest stage; slowest table first."""
    means = {c: f"avg_{c.removeprefix('lag_')}" for c in [*TRACE_STAGES, "lag_total_ms"]}
    avg = (
        traces.filter(F.col("created_at") > since)
        .groupBy("table_name")
        .agg(F.count("*").alias("events"), *[F.avg(c).alias(f"__{c}") for c in means])
    )
    slowest = F.greatest(*[F.col(f"__{c}") for c in TRACE_STAGES])
    name = None
    for c, stage in TRACE_STAGES.items():
        name = (F.when if name is None else name.when)(F.col(f"__{c}") == slowest, stage)
    return (
        avg.select("table_name", "events", *[F.round(f"__{c}", 1).alias(n) for c, n in means.items()], name.alias("bottleneck"))
        .orderBy(F.desc("avg_total_ms"))
    )


def latency_percentiles(
    traces: DataFrame,
    since: Column,
    lag: str = "lag_total_ms",
    percents: Mapping[str, float] = PERCENTILES,
    bucket_ms: float = 100.0,
) -> DataFrame:
    """Exact interpolated percentiles and the maximum of a lag per table; slowest table first.

    Two passes select the values without gathering a table's lags. Counts per bucket of
    ``bucket_ms`` tell in which bucket each wanted rank lies; only those buckets are then
    counted value by value. Both windows run over counts, not over traces.
    """
    recent = traces.filter(F.col("created_at") > since).select("table_name", F.col(lag).alias("v"))
    recent = recent.filter(F.col("v").isNotNull()).withColumn("b", F.floor(F.col("v") / bucket_ms))

    in_table = W.partitionBy("table_name")
    upto = in_table.orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)
    buckets = (
        recent.groupBy("table_name", "b")
        .agg(F.count("*").alias("n"), F.max("v").alias("top"))
        .withColumns({"end": F.sum("n").over(upto), "total": F.sum("n").over(in_table), "top": F.max("top").over(in_table)})
    )
    # Ranks count from 0; a percentile lies between the two ranks around (total - 1) * p.
    ranks = []
    for name, p in percents.items():
        at = (F.col("total") - 1) * F.lit(p)
        low, high = F.floor(at), F.least(F.floor(at) + 1, F.col("total") - 1)
        for side, rank in (("low", low), ("high", high)):
            parts = {"name": F.lit(name), "side": F.lit(side), "rank": rank.cast("bigint"), "share": at - low}
            ranks.append(F.struct(*[c.alias(n) for n, c in parts.items()]))
    wanted = (
        buckets.select("table_name", "b", "total", "top", (F.col("end") - F.col("n")).alias("start"), "end", F.inline(F.array(*ranks)))
        .filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end")))
        .withColumn("rank", F.col("rank") - F.col("start"))
    )
    in_bucket = W.partitionBy("table_name", "b").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    values = (
        recent.join(wanted.select(F.col("table_name").alias("t"), F.col("b").alias("c")).distinct(), F.col("table_name").eqNullSafe(F.col("t")) & (F.col("b") == F.col("c")))
        .groupBy("table_name", "b", "v")
        .agg(F.count("*").alias("m"))
        .withColumn("upto", F.sum("m").over(in_bucket))
    )
    hit = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("m"))
    values = values.withColumnsRenamed({"table_name": "t", "b": "c"})
    picked = wanted.join(values, F.col("table_name").eqNullSafe(F.col("t")) & (F.col("b") == F.col("c"))).filter(hit)

    def interpolated(name: str) -> Column:
        low, high = (F.max(F.when((F.col("name") == name) & (F.col("side") == x), F.col("v"))) for x in ("low", "high"))
        share = F.max(F.when(F.col("name") == name, F.col("share")))
        return F.round(low + (high - low) * share, 1).alias(name)

    return (
        picked.groupBy("table_name")
        .agg(
            F.max("total").alias("events"),
            *[interpolated(n) for n in percents],
            F.round(F.max("top"), 1).alias("max_ms"),
        )
        .orderBy(F.desc("p95_ms") if "p95_ms" in percents else F.desc("max_ms"))
    )


def slo_alerts(traces: DataFrame, since: Column, limits: Mapping[str, tuple[str, int]] = SLO_LIMITS_MS) -> DataFrame:
    """Slow traces with the first limit they break, slowest first."""
    alert = None
    for c, (name, limit) in limits.items():
        alert = (F.when if alert is None else alert.when)(F.col(c) > limit, name)
    return (
        traces.filter((F.col("created_at") > since) & (F.col("lag_total_ms") > SLO_REPORTED_TOTAL_MS))
        .select("trace_id", "table_name", F.round("lag_total_ms", 0).alias("total_ms"), alert.alias("alert"))
        .orderBy(F.desc("total_ms"))
    )


def expire_traces(traces: DataFrame, now: Column, hours: int = TRACE_RETENTION_HOURS) -> DataFrame:
    """Traces young enough to keep."""
    return traces.filter(F.col("created_at") >= now - F.make_interval(hours=F.lit(hours)))
