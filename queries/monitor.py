"""Monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.operators import monitor as M
from queries.base import Tables, moment, query

NOW = "2024-02-01 00:00:00"
NOW_MS = 1706745600000
SINCE = "1998-01-01 00:00:00"


def _staged(t: Tables) -> DataFrame:
    return t("topic_feed").select(
        "topic",
        F.col("source_ts_ms").alias("__source_ts_ms"),
        F.col("kafka_offset").alias("__kafka_offset"),
        F.col("kafka_partition").alias("__kafka_partition"),
    )


_STATS = """count(*) as records_processed, min(source_ts_ms) as min_source_ts_ms, max(source_ts_ms) as max_source_ts_ms,
    min(kafka_offset) as min_kafka_offset, max(kafka_offset) as max_kafka_offset, min(kafka_partition) as kafka_partition"""


@query("d1_batch_stats", f"select topic, {_STATS} from {{topic_feed}} group by topic")
def _(t: Tables) -> DataFrame:
    return M.batch_stats(_staged(t), ["topic"])


@query(
    "h13_log_batch",
    f"""select 'sales' as schema_name, 'events' as table_name, topic, {_STATS}, cast(null as integer) as merge_duration_ms,
    cast('{NOW}' as timestamp) as processed_at from {{topic_feed}} group by topic""",
)
def _(t: Tables) -> DataFrame:
    return M.log_batch(M.batch_stats(_staged(t), ["topic"]), "sales", "Events", moment())


@query("d2_batch_counts", "select start_lsn as batch_id, count(*) as rows_inserted from {change_feed} group by start_lsn")
def _(t: Tables) -> DataFrame:
    return M.batch_counts(t("change_feed").withColumnRenamed("start_lsn", "batch_id"))


@query(
    "d3_sync_health",
    f"""select customer_id, table_name, kafka_topic, max(max_source_ts_ms) as last_source_ts_ms, max(processed_at) as last_processed_at,
    cast(sum(records_processed) as bigint) as total_records, {NOW_MS} - max(max_source_ts_ms) as lag_ms,
    cast(floor(epoch_us(timestamp '{NOW}' - max(processed_at)) / 1000000) as bigint) as silence_seconds
    from {{processing_log}} where customer_id is not null group by customer_id, table_name, kafka_topic""",
)
def _(t: Tables) -> DataFrame:
    return M.sync_health(t("processing_log"), moment())


_ROLLUP = """select source_instance_key, logical_table_name, date_trunc('hour', pulled_at) as bucket_start, count(*) as pulls_total,
    count(*) filter (where not failed and rows_pulled = 0) as empty_pulls_total, count(*) filter (where not failed and rows_pulled > 0) as nonempty_pulls_total,
    count(*) filter (where not failed and rows_pulled >= 900) as full_batches_total,
    cast(sum(case when failed then 0 else rows_pulled end) as bigint) as rows_total, count(*) filter (where failed) as failures_total,
    max(case when not failed and rows_pulled > 0 then pulled_at end) as last_nonempty_at
    from {pull_log} group by source_instance_key, logical_table_name, date_trunc('hour', pulled_at)"""


@query("d4_activity_rollup", _ROLLUP)
def _(t: Tables) -> DataFrame:
    return M.activity_rollup(t("pull_log"), 900)


_GAPS = """(select *, max_kafka_offset as batch_end_offset,
    lead(min_kafka_offset) over (partition by table_name, customer_id, kafka_partition order by min_kafka_offset) as next_batch_start from {processing_log})"""
_GAP_COLUMNS = "customer_id, kafka_topic, kafka_partition, batch_end_offset, next_batch_start, next_batch_start - max_kafka_offset - 1 as gap_size"
_GAP_NAMES = ["customer_id", "kafka_topic", "kafka_partition", "batch_end_offset", "next_batch_start", "gap_size"]


@query("e3_offset_gaps", f"select {_GAP_COLUMNS} from {_GAPS}")
def _(t: Tables) -> DataFrame:
    return M.offset_gaps(t("processing_log"), bucket_width=1000).select(*_GAP_NAMES)


@query("e4_gap_alerts", f"select {_GAP_COLUMNS} from {_GAPS} where next_batch_start - max_kafka_offset - 1 > 0")
def _(t: Tables) -> DataFrame:
    return M.gap_alerts(t("processing_log")).select(*_GAP_NAMES)


@query("e5_with_total", "select event_id, event_type, count(*) over () as total_count from {events}")
def _(t: Tables) -> DataFrame:
    return M.with_total(t("events").select("event_id", "event_type"))


@query(
    "e6_position_regressions",
    """select table_name, batch_no, start_lsn, seqval, previous_start_lsn, previous_seqval from
    (select *, lag(start_lsn) over (partition by table_name order by processed_at) as previous_start_lsn,
      lag(seqval) over (partition by table_name order by processed_at) as previous_seqval from {processing_log})
    where previous_start_lsn > start_lsn or (previous_start_lsn = start_lsn and previous_seqval > seqval)""",
)
def _(t: Tables) -> DataFrame:
    found = M.position_regressions(t("processing_log"), ["table_name"])
    return found.select("table_name", "batch_no", "start_lsn", "seqval", "previous_start_lsn", "previous_seqval")


@query("f4_recent_errors", "select * from {error_log} order by occurred_at desc, id desc limit 100")
def _(t: Tables) -> DataFrame:
    return M.recent_errors(t("error_log"))


_STATUS = "case when is_merging then 'MERGING' when has_changes then 'PENDING' else 'IDLE' end"


@query("h12_merge_status", f"select schema_name, table_name, {_STATUS} as status, last_change_at from {{merge_control}} order by last_change_at desc nulls last")
def _(t: Tables) -> DataFrame:
    return M.merge_status(t("merge_control")).select("schema_name", "table_name", "status", "last_change_at")


@query("f5_status_nulls_last", f"select table_name, {_STATUS} as status from {{merge_control}} order by last_change_at desc nulls last")
def _(t: Tables) -> DataFrame:
    return M.merge_status(t("merge_control")).select("table_name", "status")


@query(
    "h12_pending_merges",
    """select table_name, cast(floor(epoch_us(timestamp '2001-01-01 00:00:00' - last_change_at) / 1000000) as bigint) as seconds_pending from {merge_control}
    where has_changes and not is_merging and last_change_at < timestamp '2001-01-01 00:00:00' - interval 5 second""",
)
def _(t: Tables) -> DataFrame:
    return M.pending_merges(t("merge_control"), moment("2001-01-01 00:00:00")).select("table_name", "seconds_pending")


@query(
    "d17_merge_performance",
    """select table_name, case when last_merge_rows <> 0 then round(last_merge_duration_ms / last_merge_rows, 2) end as ms_per_row,
    round(merge_count * 60.0::double / floor(epoch_us(timestamp '2010-01-01 00:00:00' - created_at) / 1000000), 2) as merges_per_minute,
    case when has_changes then cast(floor(epoch_us(timestamp '2010-01-01 00:00:00' - last_change_at) / 1000000) as bigint) end as seconds_pending
    from {merge_control} where last_merge_at is not null""",
)
def _(t: Tables) -> DataFrame:
    out = M.merge_performance(t("merge_control"), moment("2010-01-01 00:00:00"))
    return out.select("table_name", "ms_per_row", "merges_per_minute", "seconds_pending")


@query(
    "h14_replication_lag",
    """select table_name, batch_no, 1704499200000 - max_source_ts_ms as lag_ms, case when 1704499200000 - max_source_ts_ms > 900000 then 'critical'
    when 1704499200000 - max_source_ts_ms > 300000 then 'warning' else 'ok' end as alert_level from {processing_log} where max_source_ts_ms is not null""",
)
def _(t: Tables) -> DataFrame:
    out = M.replication_lag(t("processing_log"), moment("2024-01-06 00:00:00"))
    return out.select("table_name", "batch_no", "lag_ms", "alert_level")


@query(
    "h17_stamp_trace",
    """select event_id, concat('evt-', cast(event_id as varchar)) as trace_id, ts as source_modified_at, ts + interval 2 second as source_captured_at from {events}""",
)
def _(t: Tables) -> DataFrame:
    rows = t("events").select("event_id", F.col("ts").alias("source_modified_at"))
    captured = F.col("source_modified_at") + F.make_dt_interval(secs=F.lit(2))
    out = M.stamp_trace(rows, "source_captured_at", captured, F.concat(F.lit("evt-"), F.col("event_id")))
    return M.stamp_trace(out, "source_modified_at", moment())  # stamped before, so unchanged


@query(
    "h17_trace_lags",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 1300 as lag_capture_ms, cast(10 as bigint) as lag_kafka_produce_ms, l_suppkey % 90 as lag_kafka_consume_ms,
    cast(l_linenumber * 100 as bigint) as lag_sink_write_ms, cast(5 as bigint) as lag_merge_ms, l_partkey % 1300 + 10 + l_suppkey % 90 + l_linenumber * 100 + 5 as lag_total_ms from {lineitem}""",
)
def _(t: Tables) -> DataFrame:
    out = M.trace_lags(t("trace_times"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *M.TRACE_STAGES, "lag_total_ms")


@query("h18_sample_traces", "select trace_id, table_name from {trace_log} where ('0x' || substring(md5(trace_id), 1, 8))::bigint % 100 < 3")
def _(t: Tables) -> DataFrame:
    return M.sample_traces(t("trace_log"), 3).select("trace_id", "table_name")


@query(
    "d11_bottleneck",
    f"""select table_name, events, round(a, 1) as avg_capture_ms, round(b, 1) as avg_kafka_produce_ms, round(c, 1) as avg_kafka_consume_ms, round(d, 1) as avg_sink_write_ms,
    round(e, 1) as avg_merge_ms, round(f, 1) as avg_total_ms,
    case greatest(a, b, c, d, e) when a then 'capture' when b then 'produce' when c then 'consume' when d then 'sink' when e then 'merge' end as bottleneck
    from (select table_name, count(*) as events, avg(lag_capture_ms) as a, avg(lag_kafka_produce_ms) as b, avg(lag_kafka_consume_ms) as c,
      avg(lag_sink_write_ms) as d, avg(lag_merge_ms) as e, avg(lag_total_ms) as f from {{trace_log}} where created_at > timestamp '{SINCE}' group by table_name)""",
)
def _(t: Tables) -> DataFrame:
    return M.bottleneck(t("trace_log"), moment(SINCE))


@query(
    "d12_latency_percentiles",
    f"""select table_name, count(*) as events, round(quantile_cont(lag_total_ms, 0.5), 1) as p50_ms, round(quantile_cont(lag_total_ms, 0.95), 1) as p95_ms,
    round(quantile_cont(lag_total_ms, 0.99), 1) as p99_ms, round(max(lag_total_ms), 1) as max_ms from {{trace_log}} where created_at > timestamp '{SINCE}' group by table_name""",
)
def _(t: Tables) -> DataFrame:
    return M.latency_percentiles(t("trace_log"), moment(SINCE))


@query(
    "h19_slo_alerts",
    f"""select trace_id, table_name, round(lag_total_ms, 0) as total_ms, case when lag_capture_ms > 1000 then 'capture > 1s' when lag_kafka_produce_ms > 500 then 'produce > 500ms'
    when lag_kafka_consume_ms > 2000 then 'consume > 2s' when lag_sink_write_ms > 5000 then 'sink > 5s' when lag_merge_ms > 3000 then 'merge > 3s' when lag_total_ms > 10000 then 'total > 10s' end as alert
    from {{trace_log}} where created_at > timestamp '{SINCE}' and lag_total_ms > 5000""",
)
def _(t: Tables) -> DataFrame:
    return M.slo_alerts(t("trace_log"), moment(SINCE))


@query("h20_expire_traces", "select trace_id, created_at from {trace_log} where created_at >= timestamp '2000-01-03 00:00:00' - interval 48 hour")
def _(t: Tables) -> DataFrame:
    return M.expire_traces(t("trace_log"), moment("2000-01-03 00:00:00")).select("trace_id", "created_at")
