"""Applying changes, positions and bootstraps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.functions.expressions import op_name
from changefeed.operators import apply as A
from changefeed.operators import registry as R
from changefeed.operators.columns import cast_to_target
from changefeed.plans import brokered, native
from changefeed.plans.bootstrap import bootstrap_tables
from changefeed.plans.partitioned import PartitionedTarget
from changefeed.session import shared_dir
from changefeed.sources.feeds import derive_route, feed_bounds
from changefeed.sources.layout import PositionedFeed
from changefeed.spec import TableSpec
from queries.base import Tables, moment, query

FEED = ["customer_id", "table_name"]
ORDER = ["start_lsn", "seqval"]


@query(
    "e1_latest_per_key_brokered",
    """select kafka_offset, kafka_partition, pk, event_type, value, source_ts_ms from
    (select *, row_number() over (partition by pk order by source_ts_ms desc, kafka_partition desc, kafka_offset desc) as rn from {topic_feed}) where rn = 1""",
)
def _(t: Tables) -> DataFrame:
    rows = t("topic_feed").drop("topic", "op")
    return A.latest_per_key(rows, ["pk"], ["source_ts_ms", "kafka_partition", "kafka_offset"])


@query(
    "e2_latest_per_key_native",
    """select event_id, pk, customer_id, op_code, start_lsn, seqval, value from
    (select *, row_number() over (partition by customer_id, pk order by start_lsn desc, seqval desc) as rn from {change_feed} where op_code in (2, 4)) where rn = 1""",
)
def _(t: Tables) -> DataFrame:
    rows = t("change_feed").filter(F.col("op_code").isin(2, 4))
    rows = rows.select("event_id", "pk", "customer_id", "op_code", "start_lsn", "seqval", "value")
    return A.latest_per_key(rows, ["customer_id", "pk"], ORDER)


@query(
    "h1_current_state",
    """select pk, customer_id, event_type, value, start_lsn, seqval from
    (select *, row_number() over (partition by pk order by start_lsn desc, seqval desc) as rn from {change_feed} where op_code in (1, 2, 4)) where rn = 1 and op_code <> 1""",
)
def _(t: Tables) -> DataFrame:
    feed = t("change_feed")
    columns = ["pk", "customer_id", "event_type", "value", "start_lsn", "seqval"]
    return A.apply_changes(feed.select(*columns).limit(0), feed, ["pk"])


_LAST = """(select * from (select *, row_number() over (partition by o_orderkey order by start_lsn desc, seqval desc) as rn
  from {order_changes} where op_code in (1, 2, 4)) where rn = 1)"""


QUERY_H1 = f"""with b as {_LAST}
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice, start_lsn, seqval from {{order_target}} t where not exists (select 1 from b where b.o_orderkey = t.o_orderkey)
    union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice, start_lsn, seqval from b where op_code <> 1"""


@query("h1_apply_changes_hard", QUERY_H1)
def _(t: Tables) -> DataFrame:
    return A.apply_changes(t("order_target"), t("order_changes"), ["o_orderkey"])


_SPELT = "case when {n} % 3 = 0 then 'ORD-' when {n} % 3 = 1 then 'ord-' else 'Ord-' end"


@query(
    "h1_apply_changes_case_insensitive",
    f"""with c as (select *, {_SPELT.format(n='o_custkey')} || o_orderkey as code from {{order_changes}}),
    b as (select * from (select *, row_number() over (partition by lower(code) order by start_lsn desc, seqval desc) as rn from c where op_code in (1, 2, 4)) where rn = 1)
    select code, o_orderstatus, o_totalprice, start_lsn, seqval from (select *, 'Ord-' || o_orderkey as code from {{order_target}}) t
      where not exists (select 1 from b where lower(b.code) = lower(t.code))
    union all select code, o_orderstatus, o_totalprice, start_lsn, seqval from b where op_code <> 1""",
)
def _(t: Tables) -> DataFrame:
    # Keys are case-insensitive text: one order is spelt in three ways, and stays one row.
    columns = ["code", "o_orderstatus", "o_totalprice", "start_lsn", "seqval"]
    target = t("order_target").withColumn("code", F.concat(F.lit("Ord-"), "o_orderkey")).select(*columns)
    changes = t("order_changes").withColumn("code", F.concat(F.expr(_SPELT.format(n="o_custkey")), "o_orderkey")).select(*columns, "op_code")
    target, changes = (cast_to_target(df, {"code": "citext"}) for df in (target, changes))
    merged = A.apply_changes(target, changes, ["code"])
    return merged.withColumn("code", F.collate("code", "UTF8_BINARY"))


@query(
    "h1_apply_changes_any_delete",
    """with c as (select * from {order_changes} where op_code in (1, 2, 4)),
    u as (select * from (select *, row_number() over (partition by o_orderkey order by start_lsn desc, seqval desc) as rn from c where op_code in (2, 4)) where rn = 1),
    d as (select distinct o_orderkey from c where op_code = 1)
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice, start_lsn, seqval from {order_target} t
      where o_orderkey not in (select o_orderkey from u) and o_orderkey not in (select o_orderkey from d)
    union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice, start_lsn, seqval from u where o_orderkey not in (select o_orderkey from d)""",
)
def _(t: Tables) -> DataFrame:
    return A.apply_changes(t("order_target"), t("order_changes"), ["o_orderkey"], delete_order="any")


QUERY_H16 = f"""with b as (select b.* from {_LAST} b left join {{order_target}} t on t.o_orderkey = b.o_orderkey
      where t.o_orderkey is null or b.start_lsn > t.start_lsn or (b.start_lsn = t.start_lsn and b.seqval > t.seqval))
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice, start_lsn, seqval from {{order_target}} t where not exists (select 1 from b where b.o_orderkey = t.o_orderkey)
    union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice, start_lsn, seqval from b where op_code <> 1"""


@query("h16_apply_changes_guarded", QUERY_H16)
def _(t: Tables) -> DataFrame:
    return A.apply_changes(t("order_target"), t("order_changes"), ["o_orderkey"], guard=True)


@query(
    "h2_apply_changes_soft",
    """with b as (select * from (select *, row_number() over (partition by pk order by source_ts_ms desc, kafka_partition desc, kafka_offset desc) as rn from {topic_feed}) where rn = 1)
    select c_custkey as pk, c_mktsegment as event_type, c_acctbal as value, 'INSERT' as __cdc_operation from {customer} where c_custkey not in (select pk from b)
    union all select pk, event_type, value, case op when 'd' then 'DELETE' when 'c' then 'INSERT' when 'u' then 'UPDATE' else 'UNKNOWN' end from b""",
)
def _(t: Tables) -> DataFrame:
    target = t("customer").select(
        F.col("c_custkey").alias("pk"),
        F.col("c_mktsegment").alias("event_type"),
        F.col("c_acctbal").alias("value"),
        F.lit("INSERT").alias("__cdc_operation"),
    )
    rows = t("topic_feed").select(
        "pk",
        "event_type",
        "value",
        op_name("op").alias("__cdc_operation"),
        F.col("source_ts_ms").alias("__source_ts_ms"),
        F.col("kafka_partition").alias("__kafka_partition"),
        F.col("kafka_offset").alias("__kafka_offset"),
    )
    return brokered.merge(target, rows, ["pk"])


# Checkpoints of which some are ahead of every change, and some belong to feeds that are gone.
_AHEAD = "(select customer_id, table_name, case when customer_id like '%1' then 'FFFFFFFFFFFFFFFFFFFF' else last_start_lsn end as last_start_lsn, last_seqval from {feed_checkpoints})"
_SOME = "(select case when customer_id like '%7' then concat('old_', customer_id) else customer_id end as customer_id, table_name, last_start_lsn, last_seqval from {feed_checkpoints})"


@query(
    "h3_advance_checkpoints",
    f"""with p as (select customer_id, table_name, last_start_lsn as lsn, last_seqval as seq from {_AHEAD}
      union all select customer_id, table_name, start_lsn, seqval from {{change_feed}})
    select customer_id, table_name, lsn as last_start_lsn, seq as last_seqval from
    (select *, row_number() over (partition by customer_id, table_name order by lsn desc, seq desc nulls last) as rn from p) where rn = 1""",
)
def _(t: Tables) -> DataFrame:
    return A.advance_checkpoints(t.sql(f"select * from {_AHEAD}"), t("change_feed"), FEED)


@query(
    "h3_initialise_checkpoints",
    f"""with c as {_SOME} select * from c union all select customer_id, table_name, min(start_lsn), cast(null as varchar) from {{change_feed}} f
    where not exists (select 1 from c where c.customer_id = f.customer_id and c.table_name = f.table_name) group by customer_id, table_name""",
)
def _(t: Tables) -> DataFrame:
    return A.initialise_checkpoints(t.sql(f"select * from {_SOME}"), feed_bounds(t("change_feed"), FEED), FEED)


_KEPT_BOUNDS = """(select customer_id, table_name, min(start_lsn) as min_lsn from {change_feed} where changed_at >= timestamp '2024-01-20 00:00:00' group by customer_id, table_name)"""


@query(
    "h4_retention_gaps",
    f"""select c.customer_id, c.table_name, c.last_start_lsn, b.min_lsn from {{feed_checkpoints}} c
    join {_KEPT_BOUNDS} b on b.customer_id = c.customer_id and b.table_name = c.table_name where c.last_start_lsn < b.min_lsn""",
)
def _(t: Tables) -> DataFrame:
    kept = t("change_feed").filter(F.col("changed_at") >= moment("2024-01-20 00:00:00"))
    return A.retention_gaps(t("feed_checkpoints"), feed_bounds(kept, FEED), FEED)


@query(
    "h5_bootstrap",
    """with b as (select customer_id, max(start_lsn) as start_lsn, arg_max(seqval, start_lsn || seqval) as seqval from {change_feed} where customer_id like '%3' group by customer_id)
    select event_id, customer_id, pk, value, start_lsn as __source_start_lsn, seqval as __source_seqval, op_code as __cdc_operation, 'mssql_cdc' as __source
      from {change_feed} where customer_id not in (select customer_id from b)
    union all select f.event_id, f.customer_id, f.pk, f.value * 2, b.start_lsn, b.seqval, 2, 'mssql_snapshot' from {change_feed} f join b on b.customer_id = f.customer_id""",
)
def _(t: Tables) -> DataFrame:
    feed = t("change_feed")
    target = feed.select(
        "event_id",
        "customer_id",
        "pk",
        "value",
        F.col("start_lsn").alias("__source_start_lsn"),
        F.col("seqval").alias("__source_seqval"),
        F.col("op_code").alias("__cdc_operation"),
        F.lit("mssql_cdc").alias("__source"),
    )
    fresh = feed.filter(F.col("customer_id").endswith("3"))
    bounds = feed_bounds(fresh, ["customer_id"]).select(
        "customer_id", F.col("max_lsn").alias("start_lsn"), F.col("max_seqval").alias("seqval")
    )
    snapshot = fresh.select("event_id", "customer_id", "pk", (F.col("value") * 2).alias("value"))
    return A.bootstrap(target, snapshot, bounds, "customer_id", moment(), "appdb", "events")


@query(
    "h5_bootstrap_checkpoints",
    """with b as (select customer_id, max(start_lsn) as l, arg_max(seqval, start_lsn || seqval) as s from {change_feed} where customer_id like '%3' group by customer_id)
    select customer_id, table_name, last_start_lsn, last_seqval from {feed_checkpoints} where customer_id not in (select customer_id from b)
    union all select customer_id, 'events', l, s from b""",
)
def _(t: Tables) -> DataFrame:
    fresh = t("change_feed").filter(F.col("customer_id").endswith("3"))
    bounds = feed_bounds(fresh, ["customer_id"]).select(
        "customer_id", F.col("max_lsn").alias("start_lsn"), F.col("max_seqval").alias("seqval")
    )
    return A.bootstrap_checkpoints(t("feed_checkpoints"), bounds, "customer_id", "events")


@query(
    "h15_expire_changes",
    """with m as (select customer_id, table_name, max(case when changed_at <= timestamp '2024-01-10 00:00:00' then start_lsn end) as mark from {change_feed} group by customer_id, table_name)
    select f.event_id, f.customer_id, f.start_lsn from {change_feed} f join m on m.customer_id = f.customer_id and m.table_name = f.table_name
    where mark is null or f.start_lsn >= mark""",
)
def _(t: Tables) -> DataFrame:
    kept = A.expire_changes(t("change_feed"), FEED, moment("2024-02-09 00:00:00") - F.make_dt_interval(days=F.lit(30)))
    return kept.select("event_id", "customer_id", "start_lsn")


@query(
    "h15_expire_changes_low_water",
    """with m as (select customer_id, table_name, max(case when changed_at <= timestamp '2024-01-10 00:00:00' then start_lsn end) as mark from {change_feed} group by customer_id, table_name),
    w as (select m.customer_id, m.table_name, case when mark is null then c.last_start_lsn when c.last_start_lsn is null then mark else greatest(mark, c.last_start_lsn) end as mark
      from m left join {feed_checkpoints} c on c.customer_id = m.customer_id and c.table_name = m.table_name)
    select f.event_id, f.customer_id, f.start_lsn from {change_feed} f join w on w.customer_id = f.customer_id and w.table_name = f.table_name
    where mark is null or f.start_lsn >= mark""",
)
def _(t: Tables) -> DataFrame:
    marks = t("feed_checkpoints").select(*FEED, F.col("last_start_lsn").alias("low_lsn"))
    kept = A.expire_changes(t("change_feed"), FEED, moment("2024-01-10 00:00:00"), low_water=marks)
    return kept.select("event_id", "customer_id", "start_lsn")


_CURSOR = """select b.customer_id, b.table_name, coalesce(c.last_start_lsn, b.{lsn}) as start_lsn,
    case when c.last_start_lsn is not null then c.last_seqval else {seq} end as seqval,
    case when c.last_start_lsn is not null then 'checkpoint' else '{mode}' end as origin
    from (select customer_id, table_name, min(start_lsn) as min_lsn, max(start_lsn) as max_lsn, arg_max(seqval, start_lsn || seqval) as max_seqval
      from {{change_feed}} group by customer_id, table_name) b
    left join {some} c on c.customer_id = b.customer_id and c.table_name = b.table_name"""


def _cursor(t: Tables, mode: str) -> DataFrame:
    return A.initial_cursor(feed_bounds(t("change_feed"), FEED), t.sql(f"select * from {_SOME}"), FEED, mode)


@query("h21_initial_cursor_beginning", _CURSOR.format(lsn="min_lsn", seq="cast(null as varchar)", mode="beginning", some=_SOME))
def _(t: Tables) -> DataFrame:
    return _cursor(t, "beginning")


@query("h21_initial_cursor_current", _CURSOR.format(lsn="max_lsn", seq="b.max_seqval", mode="current", some=_SOME))
def _(t: Tables) -> DataFrame:
    return _cursor(t, "current")


@query(
    "i6_dedupe_batch",
    "select distinct on (kafka_offset, kafka_partition) kafka_offset, kafka_partition, pk from {topic_feed}",
)
def _(t: Tables) -> DataFrame:
    rows = t("topic_feed").select("kafka_offset", "kafka_partition", "pk")
    return A.dedupe_batch(rows.unionByName(rows), ["kafka_offset", "kafka_partition"])


SPEC = TableSpec("events", ["pk"], database="appdb")


_PULLED = """with f as (select f.*, c.last_start_lsn as l, c.last_seqval as s from {change_feed} f
      left join {feed_checkpoints} c on c.customer_id = f.customer_id and c.table_name = f.table_name),
    p as (select * from f where op_code in (1, 2, 4) and (l is null or start_lsn > l or (start_lsn = l and (s is null or seqval > s)))),
    w as (select * from (select *, row_number() over (partition by customer_id, pk order by start_lsn desc, seqval desc) as rn from p) where rn = 1)
    select concat('tenant', cast(cast(floor(c_custkey / 10) as bigint) as varchar)) as customer_id, c_custkey as pk, c_mktsegment as event_type, c_acctbal as value, lpad(hex(cast(1 as bigint)), 20, '0') as __source_start_lsn, lpad(hex(cast(0 as bigint)), 20, '0') as __source_seqval, 2 as __cdc_operation
      from {customer} where not exists (select 1 from w where w.pk = c_custkey and w.customer_id = concat('tenant', cast(cast(floor(c_custkey / 10) as bigint) as varchar)))
    union all select customer_id, pk, event_type, value, start_lsn, seqval, op_code from w where op_code <> 1"""


def _native_target(t: Tables) -> DataFrame:
    return t.sql(
        """select concat('tenant', cast(cast(floor(c_custkey / 10) as bigint) as varchar(20))) as customer_id, c_custkey as pk, c_mktsegment as event_type,
        c_acctbal as value, lpad(hex(1L), 20, '0') as __source_start_lsn, lpad(hex(0L), 20, '0') as __source_seqval, 2 as __cdc_operation from {customer}"""
    )


@query("native_pull_and_merge", _PULLED)
def _(t: Tables) -> DataFrame:
    feed = t("change_feed")
    pulled = native.pull(feed, SPEC, t("feed_checkpoints"), native.bounds_of(feed, SPEC), moment())
    return native.current(native.merge(_native_target(t), pulled.rows, SPEC))


@query("native_pull_and_merge_positioned", _PULLED)
def _(t: Tables) -> DataFrame:
    rows = t("change_feed")
    feed = PositionedFeed(t.spark, shared_dir(t.spark, "feed"), rows.schema, native.FEED_KEYS)
    feed.append(rows)
    pulled = native.pull_positioned(feed, SPEC, t("feed_checkpoints"), moment())
    return native.current(native.merge(_native_target(t), pulled.rows, SPEC))


@query(
    "native_replay_after_delete",
    """with l as (select * from (select *, row_number() over (partition by customer_id, pk order by start_lsn desc, seqval desc) as rn
      from {change_feed} where op_code in (1, 2, 4)) where rn = 1 and op_code <> 1)
    select customer_id, pk, value, start_lsn as __source_start_lsn, seqval as __source_seqval, op_code as __cdc_operation from l""",
)
def _(t: Tables) -> DataFrame:
    # Three batches: everything, then its inserts and updates again, then all of it.
    feed = t("change_feed")
    target = t.sql("select '' as customer_id, 0L as pk, 0.0D as value, '' as __source_start_lsn, '' as __source_seqval, 0 as __cdc_operation where false")
    pulled = native.pull(feed, SPEC, t("feed_checkpoints").limit(0), native.bounds_of(feed, SPEC), moment()).rows
    for batch in (pulled, pulled.where("__cdc_operation <> 1"), pulled):
        target = native.merge(target, batch, SPEC)
    return native.current(target)


@query(
    "h13_native_log",
    """select 'sales' as schema_name, 'events' as table_name, customer_id, count(*) as records_processed, min(start_lsn) as min_start_lsn, max(start_lsn) as max_start_lsn
    from {change_feed} where op_code in (1, 2, 4) group by customer_id""",
)
def _(t: Tables) -> DataFrame:
    feed = t("change_feed")
    pulled = native.pull(feed, SPEC, t("feed_checkpoints").limit(0), native.bounds_of(feed, SPEC), moment()).rows
    return native.log_rows(pulled, "sales", "Events", moment()).drop("processed_at", "merge_duration_ms")


@query(
    "native_checkpoints_after_pull",
    """select customer_id, table_name, max(start_lsn) as last_start_lsn, arg_max(seqval, start_lsn || seqval) as last_seqval
    from {change_feed} where op_code in (1, 2, 4) group by customer_id, table_name""",
)
def _(t: Tables) -> DataFrame:
    feed = t("change_feed")
    bounds = native.bounds_of(feed, SPEC)
    none = t("feed_checkpoints").limit(0)
    return native.checkpoints_after(none, native.pull(feed, SPEC, none, bounds, moment()).rows)


@query(
    "brokered_merge",
    """with b as (select *, split_part(topic, '.', 2) as s from (select *, row_number() over (partition by split_part(topic, '.', 2), pk
        order by source_ts_ms desc, kafka_partition desc, kafka_offset desc) as rn from {topic_feed} where split_part(topic, '.', 5) = 'Events') where rn = 1)
    select s as __routing_schema, pk, event_type, value, case op when 'd' then 'DELETE' when 'c' then 'INSERT' when 'u' then 'UPDATE' else 'UNKNOWN' end as __cdc_operation from b""",
)
def _(t: Tables) -> DataFrame:
    rows = derive_route(t("topic_feed"))
    routes = rows.select(
        F.col("__routing_schema").alias("schema_name"), F.lit("Events").alias("table_name"), F.col("__routing_schema").alias("target")
    ).distinct()
    flat = brokered.routed(rows, routes).select(
        "__routing_schema",
        "pk",
        "event_type",
        "value",
        op_name("op").alias("__cdc_operation"),
        F.col("source_ts_ms").alias("__source_ts_ms"),
        F.col("kafka_partition").alias("__kafka_partition"),
        F.col("kafka_offset").alias("__kafka_offset"),
    )
    target = flat.select("__routing_schema", "pk", "event_type", "value", "__cdc_operation").limit(0)
    return brokered.merge(target, flat, ["__routing_schema", "pk"])


@query("h1_apply_changes_small_batch", QUERY_H1)
def _(t: Tables) -> DataFrame:
    return A.apply_changes(t("order_target"), t("order_changes"), ["o_orderkey"], stage=True)


@query("h16_apply_changes_guarded_small_batch", QUERY_H16)
def _(t: Tables) -> DataFrame:
    return A.apply_changes(t("order_target"), t("order_changes"), ["o_orderkey"], guard=True, stage=True)


@query("h16_replay_after_delete", QUERY_H16)
def _(t: Tables) -> DataFrame:
    # The inserts and updates of a batch come again after its deletes: nothing may change.
    target, batch = t("order_target").withColumn("deleted", F.lit(False)), t("order_changes")
    once = A.apply_changes(target, batch, ["o_orderkey"], guard=True, tombstone="deleted")
    again = A.apply_changes(once, batch.filter("op_code <> 1"), ["o_orderkey"], guard=True, tombstone="deleted")
    return A.live(again, "deleted")


# Every third tenant is due; of these every third has no rows in the snapshot. The others are switched on or were loaded before.
_TENANTS = """(select customer_id, concat('src_', customer_id) as source_instance_key, 'Events' as logical_table_name, tenant_no, tenant_no % 3 = 1 as enabled
  from (select distinct customer_id, cast(floor(pk / 10) as bigint) as tenant_no from {change_feed}) d)"""


@query(
    "h5_bootstrap_end_to_end",
    f"""with t as (select * from {_TENANTS} x),
    b as (select customer_id, max(start_lsn) as lsn, arg_max(seqval, start_lsn || seqval) as seq from {{change_feed}} group by customer_id),
    r as (select t.customer_id, t.tenant_no, case when tenant_no % 3 <> 0 then f.value else f.value * 2 end as value from {{change_feed}} f join t on t.customer_id = f.customer_id
      where tenant_no % 9 <> 0),
    c as (select customer_id, count(*) as n, sum(value) as total from r group by customer_id)
    select t.customer_id, coalesce(n, 0)::bigint as target_rows, round(coalesce(total, 0), 4) as total_value,
      case when tenant_no % 3 = 0 then coalesce(n, 0)::bigint end as rows_loaded, case when tenant_no % 3 = 0 then lsn end as captured_start_lsn,
      case when tenant_no % 3 = 0 then seq end as captured_seqval, case tenant_no % 3 when 0 then 'completed' when 1 then 'pending' else 'completed' end as bootstrap_status,
      case when tenant_no % 3 = 0 then lsn else '00' end as checkpoint_lsn, tenant_no % 3 <> 2 as enabled, case when tenant_no % 3 = 0 then 2 else 1 end as config_version
    from t join b on b.customer_id = t.customer_id left join c on c.customer_id = t.customer_id""",
)
def _(t: Tables) -> DataFrame:
    feed, named = t("change_feed"), t.sql(f"select * from {_TENANTS} x")
    columns = "event_id long, customer_id string, pk long, value double, __source_start_lsn string, __source_seqval string, __cdc_operation int, __source string"
    target = PartitionedTarget(t.spark, shared_dir(t.spark, "bootstrapped"), columns, ["event_id"], ["customer_id"])
    rows = feed.select(
        "event_id", "customer_id", "pk", "value", F.col("start_lsn").alias("__source_start_lsn"), F.col("seqval").alias("__source_seqval"),
        F.col("op_code").alias("__cdc_operation"), F.lit("mssql_cdc").alias("__source"),
    )
    empty = named.where("tenant_no % 9 = 0").select("customer_id")
    target.replace(rows.join(named.where("tenant_no % 9 <> 0").select("customer_id"), "customer_id", "left_semi"), target.parts_of(feed), "before")
    target.merge(rows.join(empty, "customer_id", "left_semi"), "old", order=("__source_start_lsn", "__source_seqval"), op="__cdc_operation")
    registered = named.select(*R.FEED, F.lit("sales").alias("target_schema_name"), F.lit("events").alias("target_table_name"), "enabled")
    policies = named.select(*R.FEED, "enabled", F.lit(1).alias("config_version"))
    instances = named.select("source_instance_key", F.lit(True).alias("enabled"))
    none = {c: F.lit(None).cast("string") for c in ("last_captured_start_lsn", "last_captured_seqval", "last_error")}
    times = {c: F.lit(None).cast("timestamp_ntz") for c in ("last_started_at", "last_completed_at", "last_failed_at")}
    status = F.when(F.col("tenant_no") % 3 == 2, "completed").otherwise("pending").alias("bootstrap_status")
    states = named.select(*R.FEED, status).withColumns({**none, **times, "last_rows_loaded": F.lit(None).cast("long")})
    checkpoints = named.select("customer_id", F.lit("events").alias("table_name"), F.lit("00").alias("last_start_lsn"), F.lit(None).cast("string").alias("last_seqval"))
    run = bootstrap_tables(
        target, feed.join(empty, "customer_id", "left_anti").select("event_id", "customer_id", "pk", (F.col("value") * 2).alias("value")),
        R.bootstrap_plan(registered, policies, instances, states), named, feed_bounds(feed, ["customer_id"]), checkpoints, states, registered, policies,
        "events", moment(), "load", "appdb",
    )
    sums = target.read().groupBy("customer_id").agg(F.count("*").alias("target_rows"), F.round(F.sum("value"), 4).alias("total_value"))
    return (
        named.select(*R.FEED, "customer_id")
        .join(sums, "customer_id", "left")
        .join(run.states.select(*R.FEED, "bootstrap_status", "last_rows_loaded", "last_captured_start_lsn", "last_captured_seqval"), R.FEED)
        .join(run.policies, R.FEED)
        .join(run.checkpoints, "customer_id")
        .select(
            "customer_id", F.coalesce("target_rows", F.lit(0).cast("long")).alias("target_rows"), F.coalesce("total_value", F.lit(0.0)).alias("total_value"),
            F.col("last_rows_loaded").alias("rows_loaded"), F.col("last_captured_start_lsn").alias("captured_start_lsn"), F.col("last_captured_seqval").alias("captured_seqval"),
            "bootstrap_status", F.col("last_start_lsn").alias("checkpoint_lsn"), "enabled", "config_version",
        )
    )
