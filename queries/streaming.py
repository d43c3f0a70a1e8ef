"""Streaming (I1-I5, I7): the given events as a stream, run until everything is consumed.

Each query writes below the cluster's shared folder and reads the result back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.operators import apply as A
from changefeed.plans.partitioned import PartitionedTarget
from changefeed.session import shared_dir
from changefeed.spec import APPLIED_OPS, OP_DELETE
from changefeed.streaming import sinks as SK
from changefeed.streaming import stateful as ST
from changefeed.streaming import streams as S
from queries.base import Tables, moment, query
from queries.monitor import _ROLLUP
from queries.views import VIEWS


def _stream(t: Tables, view: str) -> DataFrame:
    events = S.stream_changes(t.spark, t.path("events"), t("events").schema)
    return t.sql(VIEWS[view], events=events)


def _emitted(t: Tables, stream: DataFrame, mode: str = "append") -> str:
    root = shared_dir(t.spark, "stream")
    S.stream_to_files(stream, f"{root}/out", f"{root}/state", mode).awaitTermination()
    return f"{root}/out"


@query("i1_stream_changes", "select event_id, op_code, start_lsn, seqval from {change_feed} where op_code <> 3")
def _(t: Tables) -> DataFrame:
    rows = _stream(t, "change_feed").filter(F.col("op_code") != 3).select("event_id", "op_code", "start_lsn", "seqval")
    return t.spark.read.parquet(_emitted(t, rows) + "/batch_*").drop("__batch")


def _in_parts(t: Tables, view: str, parts: int = 6) -> DataFrame:
    """A view as a stream of ``parts`` micro-batches or more: its rows, laid out by position, come a few files at a time."""
    folder = shared_dir(t.spark, "arriving")
    rows = t(view)
    rows.repartitionByRange(parts, "start_lsn", "seqval").write.parquet(folder)
    return S.stream_changes(t.spark, folder, rows.schema, max_per_trigger=1)


def _grouped(tenant: str) -> Callable[[DataFrame], DataFrame]:
    """Many small tenants share a partition: a folder each would cost more than the rows in it."""
    return lambda rows: rows.withColumn("tenant_group", F.pmod(F.hash(tenant), F.lit(16)))


def _applied(t: Tables) -> PartitionedTarget:
    root = shared_dir(t.spark, "target")
    feed = _in_parts(t, "change_feed", 3)
    schema = "tenant_group int, customer_id string, pk long, event_type string, value double, start_lsn string, seqval string"
    target = PartitionedTarget(t.spark, f"{root}/table", schema, ["customer_id", "pk"], ["tenant_group"])

    def log(batch: DataFrame) -> DataFrame:
        counts = batch.groupBy("customer_id", "table_name").agg(F.count("*").alias("records_processed"))
        return counts.withColumn("processed_at", moment())

    SK.stream_apply(feed, target, f"{root}/state", _grouped("customer_id"), feed=["customer_id", "table_name"], log=log, period=None).awaitTermination()
    return target


@query(
    "i3_stream_apply",
    """select pk, customer_id, event_type, value, start_lsn, seqval from
    (select *, row_number() over (partition by pk order by start_lsn desc, seqval desc) as rn from {change_feed} where op_code in (1, 2, 4)) where rn = 1 and op_code <> 1""",
)
def _(t: Tables) -> DataFrame:
    return _applied(t).read().drop("tenant_group")


@query(
    "i2_stream_checkpoints",
    """select customer_id, table_name, max(start_lsn) as last_start_lsn, arg_max(seqval, start_lsn || seqval) as last_seqval from {change_feed} group by customer_id, table_name""",
)
def _(t: Tables) -> DataFrame:
    return SK.batch_log(_applied(t)).checkpoints(["customer_id", "table_name"])


@query("h13_stream_log", "select customer_id, table_name, count(*) as records_processed from {change_feed} group by customer_id, table_name")
def _(t: Tables) -> DataFrame:
    # A row a batch and feed; the batches of a feed add up to its changes.
    log = SK.batch_log(_applied(t)).get("log")
    return log.groupBy("customer_id", "table_name").agg(F.sum("records_processed").alias("records_processed"))


@query(
    "i3_routed_apply",
    """with m as (select 'tenant' || (pk // 10) as __routing_schema, event_type, pk, value, 1704067200000 + event_id * 60000 as __source_ts_ms, event_id as __kafka_offset,
      case event_id % 7 when 0 then 'DELETE' when 1 then 'INSERT' else 'UPDATE' end as __cdc_operation
      from {change_feed} where event_type <> 'error' and not ((pk // 10) % 5 = 3 and event_type = 'view')),
    w as (select *, row_number() over (partition by __routing_schema, event_type, pk order by __source_ts_ms desc, __kafka_offset desc) as rn from m)
    select event_type as table_name, __routing_schema, pk, case when event_type <> 'click' then value end as value, __cdc_operation from w where rn = 1""",
)
def _(t: Tables) -> DataFrame:
    root = shared_dir(t.spark, "routed")
    rows = _in_parts(t, "change_feed", 3).select(
        "pk", "value", "event_id", F.col("event_type").alias("__routing_table"), F.concat(F.lit("tenant"), F.floor(F.col("pk") / 10)).alias("__routing_schema"),
        F.when(F.col("event_id") % 7 == 0, "DELETE").when(F.col("event_id") % 7 == 1, "INSERT").otherwise("UPDATE").alias("__cdc_operation"),
        (F.lit(1704067200000) + F.col("event_id") * 60000).alias("__source_ts_ms"), F.lit(0).alias("__kafka_partition"), F.col("event_id").alias("__kafka_offset"),
    )
    # Routes of all tenants but for some; nothing takes errors. Clicks have another shape.
    pairs = t("change_feed").select(F.floor(F.col("pk") / 10).alias("no"), F.col("event_type").alias("table_name")).distinct()
    pairs = pairs.where("not (no % 5 = 3 and table_name = 'view')").withColumn("schema_name", F.concat(F.lit("tenant"), "no"))
    meta = "__cdc_operation string, __source_ts_ms long, __kafka_partition int, __kafka_offset long"
    shapes = {n: f"tenant_group int, __routing_schema string, pk long, {'' if n == 'click' else 'value double, '}{meta}" for n in ("view", "signup", "click", "purchase")}
    target = lambda n: PartitionedTarget(t.spark, f"{root}/{n}", shapes[n], ["__routing_schema", "pk"], ["tenant_group"])
    tables = {n: SK.RoutedTable(target(n), _grouped("__routing_schema")) for n in shapes}
    routes = pairs.select("schema_name", "table_name", F.col("schema_name").alias("target"))
    SK.routed_apply(rows, routes, tables, f"{root}/state", period=None).awaitTermination()
    out = [x.target.read().withColumn("table_name", F.lit(n)) for n, x in tables.items()]
    columns = ["table_name", "__routing_schema", "pk", "value", "__cdc_operation"]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out).select(*columns)


@query(
    "i4_debounced_merges",
    """with f as (select customer_id as schema_name, event_type as table_name, pk, value, op_code, changed_at, start_lsn, seqval from {change_feed}),
    w as (select * from (select *, row_number() over (partition by schema_name, table_name, pk order by start_lsn desc, seqval desc) as rn
      from f where op_code in (1, 2, 4)) where rn = 1 and op_code <> 1)
    select f.schema_name, f.table_name, count(*) as changes, max(changed_at) as last_change_at,
      (select count(*) from w where w.schema_name = f.schema_name and w.table_name = f.table_name) as merged_rows from f group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    root, named = shared_dir(t.spark, "quiet"), {"customer_id": "schema_name", "event_type": "table_name"}
    staged = t("change_feed").drop("table_name").withColumnsRenamed(named)

    def merge(tables: DataFrame, batch_id: int) -> None:
        # The staged changes of the quiet tables, a row per key, replace what an earlier burst left of them: of a table's
        # rows those of its last report count. A folder a table would cost more than the rows in it.
        tables.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/reports/batch_{batch_id}")
        due = staged.join(tables.select(*ST.TABLE), ST.TABLE)
        last = A.latest_per_key(due.where(F.col("op_code").isin(*APPLIED_OPS)), [*ST.TABLE, "pk"], ["start_lsn", "seqval"])
        merged = last.where(F.col("op_code") != OP_DELETE).withColumn("__batch", F.lit(batch_id))
        merged.write.mode("overwrite").parquet(f"{root}/tables/batch_{batch_id}")

    changes = _in_parts(t, "change_feed").drop("table_name").withColumnsRenamed(named)
    ST.await_read(ST.merge_when_quiet(changes, merge, f"{root}/state", quiet_s=3, period="0 seconds"), emptied=True)
    # On a slow machine a table may fall quiet more than once; its bursts add up.
    sums = [F.sum("changes").alias("changes"), F.max("last_change_at").alias("last_change_at"), F.max("__batch").alias("__batch")]
    reports = t.spark.read.parquet(f"{root}/reports/batch_*").groupBy(*ST.TABLE).agg(*sums)
    tables = t.spark.read.parquet(f"{root}/tables/batch_*").groupBy(*ST.TABLE, "__batch").agg(F.count("*").alias("merged_rows"))
    merged = F.coalesce("merged_rows", F.lit(0).cast("long")).alias("merged_rows")
    return reports.join(tables, [*ST.TABLE, "__batch"], "left").select(*ST.TABLE, "changes", F.col("last_change_at").cast("timestamp_ntz"), merged)


@query("i5_stream_rollup", _ROLLUP)
def _(t: Tables) -> DataFrame:
    # The whole log arrives at once, so hours before the watermark of a later batch are not late.
    rolled = S.stream_rollup(_stream(t, "pull_log"), 900)
    keys = ["source_instance_key", "logical_table_name", "bucket_start"]
    out = S.latest_output(t.spark, _emitted(t, rolled, "update"), keys)
    plain = {c: F.col(c).cast("timestamp_ntz") for c in ("bucket_start", "last_nonempty_at")}
    return out.withColumns(plain)


@query("i6_dedupe_stream", "select event_id, pk, event_type from {change_feed}")
def _(t: Tables) -> DataFrame:
    feed = _stream(t, "change_feed").select("event_id", "pk", "event_type", "changed_at")
    twice = feed.unionByName(_stream(t, "change_feed").select("event_id", "pk", "event_type", "changed_at"))
    rows = S.dedupe_stream(twice, ["event_id"], "changed_at").drop("changed_at")
    return t.spark.read.parquet(_emitted(t, rows) + "/batch_*").drop("__batch")


@query(
    "i7_latest_state",
    """select pk, event_id, op_code, value from (select *, row_number() over (partition by pk order by start_lsn desc, seqval desc) as rn from {change_feed}) where rn = 1""",
)
def _(t: Tables) -> DataFrame:
    feed = _stream(t, "change_feed").select("pk", "event_id", "op_code", "value", "start_lsn", "seqval")
    latest = S.latest_state(feed, ["pk"], ["start_lsn", "seqval"])
    out = S.latest_output(t.spark, _emitted(t, latest, "update"), ["pk"])
    return out.select("pk", "event_id", "op_code", "value")


@query(
    "i7_live_state",
    """select pk, event_id, op_code, value from (select *, row_number() over (partition by pk order by start_lsn desc, seqval desc) as rn
    from {change_feed} where op_code in (1, 2, 4)) where rn = 1 and op_code <> 1""",
)
def _(t: Tables) -> DataFrame:
    root = shared_dir(t.spark, "live")
    feed = _in_parts(t, "change_feed").select("pk", "event_id", "op_code", "value", "start_lsn", "seqval")
    ST.await_read(ST.keep_live(feed, ["pk"], ["start_lsn", "seqval"], f"{root}/state", "0 seconds"))
    return ST.live_rows(t.spark, f"{root}/state").select("pk", "event_id", "op_code", "value")
