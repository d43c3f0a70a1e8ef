"""Sources, scans and sinks (A), decoding and envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.functions.expressions import decode_op, message_key, op_name, topic_name
from changefeed.operators.apply import delete_keys, upsert
from changefeed.operators.columns import stamp_metadata, to_staging
from changefeed.operators.monitor import feed_sizes
from changefeed.operators.routing import fan_out, flag_errors, flag_routes, route_by, split_dead_letters
from changefeed.plans.brokered import consume, publish
from changefeed.session import shared_dir
from changefeed.sources import catalogs, feeds, variants
from changefeed.sources.topics import topic_rows
from changefeed.spec import TableSpec
from queries.base import Tables, moment, query

START_LSN = "00000000000000000064"
DATA = ["event_id", "pk", "event_type", "value"]
EVENTS = TableSpec("events", ["pk"], database="appdb", topic_prefix="dev.tenant1", ignore=["PROPS"])


@query(
    "a1_scan_changes_single_cursor",
    f"""select event_id, op_code, start_lsn, seqval from {{change_feed}}
    where start_lsn > '{START_LSN}' order by start_lsn, seqval""",
)
def _(t: Tables) -> DataFrame:
    rows = feeds.scan_changes(t("change_feed"), START_LSN, composite=False)
    return rows.select("event_id", "op_code", "start_lsn", "seqval")


@query(
    "a1_scan_whole_transactions",
    f"""with f as (select * from {{change_feed}} where start_lsn > '{START_LSN}'),
    cut as (select max(start_lsn) as lsn from (select start_lsn from f order by start_lsn limit 1000))
    select event_id, op_code, start_lsn, seqval from f where start_lsn <= (select lsn from cut)""",
)
def _(t: Tables) -> DataFrame:
    rows = feeds.scan_changes(t("change_feed"), START_LSN, composite=False, limit=1000, whole_transactions=True)
    return rows.select("event_id", "op_code", "start_lsn", "seqval")


@query(
    "a2_scan_changes_composite_cursor",
    f"""select event_id, op_code, start_lsn, seqval from {{change_feed}}
    where op_code in (1, 2, 4) and (start_lsn > '{START_LSN}' or (start_lsn = '{START_LSN}' and seqval > '{1:020X}'))
    order by start_lsn, seqval""",
)
def _(t: Tables) -> DataFrame:
    rows = feeds.scan_changes(t("change_feed"), START_LSN, f"{1:020X}")
    return rows.select("event_id", "op_code", "start_lsn", "seqval")


@query(
    "a2_scan_after_checkpoints",
    """select f.event_id, f.customer_id, f.start_lsn, f.seqval
    from {change_feed} f left join {feed_checkpoints} c on c.customer_id = f.customer_id and c.table_name = f.table_name
    where f.op_code in (1, 2, 4) and (c.last_start_lsn is null or f.start_lsn > c.last_start_lsn
      or (f.start_lsn = c.last_start_lsn and (c.last_seqval is null or f.seqval > c.last_seqval)))""",
)
def _(t: Tables) -> DataFrame:
    rows = feeds.scan_after_checkpoints(t("change_feed"), t("feed_checkpoints"), ["customer_id", "table_name"])
    return rows.select("event_id", "customer_id", "start_lsn", "seqval")


@query("a3_scan_snapshot", "select o_orderkey, o_custkey, o_orderstatus, o_orderdate from {orders}")
def _(t: Tables) -> DataFrame:
    spec = TableSpec("orders", ["o_orderkey"], ignore=["O_TOTALPRICE", "o_orderpriority"])
    return feeds.scan_snapshot(t("orders"), spec)


@query(
    "a4_feed_bounds",
    """select customer_id, table_name, min(start_lsn) as min_lsn, max(start_lsn) as max_lsn,
    arg_max(seqval, start_lsn || seqval) as max_seqval from {change_feed} group by customer_id, table_name""",
)
def _(t: Tables) -> DataFrame:
    return feeds.feed_bounds(t("change_feed"), ["customer_id", "table_name"])


@query(
    "a5_read_topics",
    """select kafka_offset, split_part(topic, '.', 2) as __routing_schema, 'events' as __routing_table, pk, event_type,
    case op when 'd' then 'DELETE' when 'c' then 'INSERT' when 'u' then 'UPDATE' else 'UNKNOWN' end as __cdc_operation,
    'kafka-cdc' as __source, source_ts_ms as __source_ts_ms from {topic_feed}""",
)
def _(t: Tables) -> DataFrame:
    # The JSON messages a broker would hold, then the subscriber's own code.
    rows = t("topic_feed")
    data = rows.select("pk", "event_type", "value").schema
    row = F.struct("pk", "event_type", "value")
    payload = F.struct(
        "op",
        F.when(F.col("op") == "d", row).alias("before"),
        F.when(F.col("op") != "d", row).alias("after"),
        F.struct(F.lit("appdb").alias("db"), F.lit("events").alias("table"), F.col("source_ts_ms").alias("ts_ms")).alias("source"),
    )
    messages = rows.select(
        "topic", "kafka_partition", "kafka_offset", F.to_json(F.struct(payload.alias("payload"))).alias("value")
    )
    flat = consume(messages, data, moment()).withColumnRenamed("__kafka_offset", "kafka_offset")
    return flat.select("kafka_offset", "__routing_schema", "__routing_table", "pk", "event_type", "__cdc_operation", "__source", "__source_ts_ms")


@query(
    "a6_union_feeds",
    """select event_id as id, 'events' as feed, event_type as detail, cast(null as double) as amount from {events}
    union all select o_orderkey, 'orders', cast(null as varchar), o_totalprice from {orders}""",
)
def _(t: Tables) -> DataFrame:
    events = t("events").select(F.col("event_id").alias("id"), F.lit("events").alias("feed"), F.col("event_type").alias("detail"))
    orders = t("orders").select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("feed"), F.col("o_totalprice").alias("amount"))
    return feeds.union_feeds([events, orders])


@query(
    "a7_inventory",
    """select server, db_name, count(distinct case when not regexp_matches(schema_name, '(?i)^sys_') then schema_name end) as schema_count,
    count(*) filter (where not regexp_matches(schema_name, '(?i)^sys_') and table_type = 'BASE TABLE' and not contains(lower(table_name), 'widget')) as table_count
    from {db_tables} where lower(db_name) not in ('master', 'tempdb', 'model', 'msdb', 'postgres', 'template0', 'template1')
    and not regexp_matches(db_name, '(?i)_tmp$') group by server, db_name""",
)
def _(t: Tables) -> DataFrame:
    filters = catalogs.InventoryFilters(
        databases_ignored=["_TMP$"], database_glob="db_*", schemas_excluded=["^sys_"], tables_excluded=["Widget"]
    )
    return catalogs.inventory(t("db_tables"), filters)


@query(
    "a8_column_catalog",
    """select c.schema_name, c.table_name, c.ordinal, c.column_name, c.type_name, c.nullable, k.column_name is not null as primary_key
    from {catalog_before} c left join (select distinct schema_name, table_name, column_name from {constraints} where constraint_type = 'PRIMARY KEY') k
    on k.schema_name = c.schema_name and k.table_name = c.table_name and k.column_name = c.column_name""",
)
def _(t: Tables) -> DataFrame:
    columns = t("catalog_before").drop("primary_key", "default_value")
    return catalogs.column_catalog(columns, t("constraints"))


@query("a9_scan_outbox", "select * from {outbox} where not processed order by changed_at, id limit 100")
def _(t: Tables) -> DataFrame:
    return feeds.scan_outbox(t("outbox"))


@query(
    "a10_write_topics",
    """select concat('dev.tenant1.dbo.', event_type) as topic, concat_ws('|', cast(pk as varchar), coalesce(customer_id, '')) as key,
    event_id as value_event_id, event_type as value_event_type from {change_feed}""",
)
def _(t: Tables) -> DataFrame:
    topic = topic_name("dev.tenant1", F.lit("dbo"), F.col("event_type"))
    value = F.struct("event_id", "event_type")
    rows = topic_rows(t("change_feed"), topic, message_key(["pk", "customer_id"]), value)
    # JSON text differs in spacing between engines, so the fields are compared.
    parsed = F.from_json("value", "event_id bigint, event_type string")
    return rows.select(
        "topic", "key", parsed["event_id"].alias("value_event_id"), parsed["event_type"].alias("value_event_type")
    )


@query(
    "a11_to_staging",
    """select customer_id as batch_id, pk as user_ref, event_id, event_type, value, op_code, start_lsn, seqval,
    cast('2024-02-01 00:00:00' as timestamp) as __pulled_at from {change_feed}""",
)
def _(t: Tables) -> DataFrame:
    spec = TableSpec("events", ["pk"], ignore=["PROPS", "table_name", "changed_at", "customer_id"], renames={"pk": "user_ref"})
    rows = t("change_feed").withColumn("__batch", F.col("customer_id"))
    return to_staging(rows, spec, F.col("__batch"), moment()).drop("__batch")


_LAST_CHANGE = """(select * from (select *, row_number() over (partition by o_orderkey order by start_lsn desc, seqval desc) as rn
  from {order_changes}) where rn = 1)"""


@query(
    "a12_upsert",
    f"""with b as {_LAST_CHANGE}
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice from {{order_target}} t where not exists (select 1 from b where b.o_orderkey = t.o_orderkey)
    union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice from b""",
)
def _(t: Tables) -> DataFrame:
    target = t("order_target").drop("start_lsn", "seqval")
    return upsert(target, t("order_changes"), ["o_orderkey"], ["start_lsn", "seqval"])


@query(
    "a13_delete_keys",
    """select o_orderkey, o_custkey, o_orderstatus, o_totalprice from {order_target} t
    where not exists (select 1 from {order_changes} c where c.o_orderkey = t.o_orderkey and c.o_custkey = t.o_custkey)""",
)
def _(t: Tables) -> DataFrame:
    target = t("order_target").drop("start_lsn", "seqval")
    return delete_keys(target, t("order_changes"), ["o_orderkey", "o_custkey"])


_ROUTED = """select f.kafka_offset, split_part(f.topic, '.', 2) as __routing_schema, split_part(f.topic, '.', 5) as __routing_table,
  r.target from {topic_feed} f left join
  (select distinct split_part(topic, '.', 2) as s, 'Events' as tbl, concat(split_part(topic, '.', 2), '.stg_events') as target from {topic_feed}) r
  on r.s = split_part(f.topic, '.', 2) and r.tbl = split_part(f.topic, '.', 5)"""


def _routed(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = feeds.derive_route(t("topic_feed"))
    routes = rows.select(
        F.col("__routing_schema").alias("schema_name"),
        F.lit("Events").alias("table_name"),
        F.concat("__routing_schema", F.lit(".stg_events")).alias("target"),
    ).distinct()
    return rows, routes


@query("a14_split_routes", f"select kafka_offset, __routing_schema, __routing_table, coalesce(target, 'dropped') as target from ({_ROUTED})")
def _(t: Tables) -> DataFrame:
    rows, routes = _routed(t)
    return flag_routes(rows, routes).select(
        "kafka_offset", "__routing_schema", "__routing_table", F.coalesce("__target", F.lit("dropped")).alias("target")
    )


@query(
    "a15_split_dead_letters",
    """with f as (select event_id, case when not (value >= 5) then 'connection lost: value too small'
        when event_type = 'error' then 'bad event type' when user_id % 10 = 3 then 'timeout waiting for user' end as error from {events})
    select event_id, error, case when error is null then 'good' when regexp_matches(error, 'timeout|connection') then 'retry' else 'dead' end as queue from f""",
)
def _(t: Tables) -> DataFrame:
    checks = {
        "connection lost: value too small": "value >= 5",
        "bad event type": "event_type <> 'error'",
        "timeout waiting for user": "user_id % 10 <> 3",
    }
    good, retry, dead = split_dead_letters(t("events"), checks, moment())
    shapes = (("good", good.withColumn("error", F.lit(None).cast("string"))), ("retry", retry), ("dead", dead))
    return feeds.union_feeds([df.select("event_id", "error", F.lit(q).alias("queue")) for q, df in shapes])


@query(
    "a16_fan_out",
    """select 'full' as output, count(*) as n, count(distinct event_type) as types, max(event_id) as top from {events}
    union all select 'slim', count(*), count(distinct event_type), max(event_id) from {events}
    union all select 'archive', count(*), count(distinct event_type), max(event_id) from {events}""",
)
def _(t: Tables) -> DataFrame:
    root = shared_dir(t.spark, "fan-out")
    outputs = {"full": ([], []), "slim": (["event_id", "event_type", "ts"], []), "archive": ([], ["event_type"])}
    fan_out(t("events"), outputs, root)
    return feeds.union_feeds(
        [
            t.spark.read.parquet(f"{root}/{name}").agg(
                F.lit(name).alias("output"),
                F.count("*").alias("n"),
                F.count_distinct("event_type").alias("types"),
                F.max("event_id").alias("top"),
            )
            for name in outputs
        ]
    )


@query("b1_drop_before_images", "select event_id, op_code from {change_feed} where op_code <> 3")
def _(t: Tables) -> DataFrame:
    return feeds.drop_before_images(t("change_feed")).select("event_id", "op_code")


@query(
    "b2_decode_op",
    """select event_id, case op_code when 1 then 'd' when 4 then 'u' else 'c' end as op,
    case op_code when 1 then 'DELETE' when 4 then 'UPDATE' else 'INSERT' end as operation,
    case op_code when 1 then 'd' when 2 then 'c' when 4 then 'u' end as strict_op from {change_feed}""",
)
def _(t: Tables) -> DataFrame:
    return t("change_feed").select(
        "event_id",
        decode_op("op_code").alias("op"),
        op_name(decode_op("op_code")).alias("operation"),
        decode_op("op_code", strict=True).alias("strict_op"),
    )


@query("b3_strip_metadata", "select event_id, user_id, value from {events}")
def _(t: Tables) -> DataFrame:
    raw = t("events").select(
        F.lit("x").alias("__$start_lsn"), "event_id", F.lit(1).alias("__$operation"), "user_id", F.lit("").alias("__$update_mask"), "value"
    )
    return feeds.strip_metadata(raw)


@query(
    "b4_wrap_envelope",
    """select event_id, case op_code when 1 then 'd' when 4 then 'u' else 'c' end as op,
    case when op_code = 1 then pk end as before_pk, case when op_code <> 1 then pk end as after_pk,
    'appdb' as db, 'events' as source_table, 1706745600000 as ts_ms from {change_feed}""",
)
def _(t: Tables) -> DataFrame:
    rows = feeds.wrap_envelope(t("change_feed"), DATA, EVENTS, F.lit(1706745600000))
    return rows.select(
        "event_id",
        F.col("payload.op").alias("op"),
        F.col("payload.before.pk").alias("before_pk"),
        F.col("payload.after.pk").alias("after_pk"),
        F.col("payload.source.db").alias("db"),
        F.col("payload.source.table").alias("source_table"),
        F.col("payload.ts_ms").alias("ts_ms"),
    )


@query(
    "b4_envelope_round_trip",
    """select event_id, pk, event_type, value, case op_code when 1 then 'DELETE' when 4 then 'UPDATE' else 'INSERT' end as __cdc_operation,
    'appdb' as __source_db, 'tenant1' as __routing_schema, 'events' as __routing_table from {change_feed} where op_code <> 3""",
)
def _(t: Tables) -> DataFrame:
    feed = t("change_feed")
    messages = publish(feed, EVENTS, DATA, F.lit(1706745600000))
    rows = consume(messages, feed.select(*DATA).schema, moment(), keep=())
    return rows.select(*DATA, "__cdc_operation", "__source_db", "__routing_schema", "__routing_table")


@query(
    "b4_variant_round_trip",
    """select event_id, pk, event_type, value, case op_code when 1 then 'DELETE' when 4 then 'UPDATE' else 'INSERT' end as __cdc_operation,
    'appdb' as __source_db, 'tenant1' as __routing_schema, 'events' as __routing_table from {change_feed} where op_code <> 3""",
)
def _(t: Tables) -> DataFrame:
    messages = publish(t("change_feed"), EVENTS, DATA, F.lit(1706745600000))
    parsed = feeds.derive_route(variants.parse_variant(messages), table=variants.source_field("table"))
    fields = {"event_id": "long", "pk": "long", "event_type": "string", "value": "double"}
    rows = variants.unwrap_variant(parsed, fields, ["__routing_schema", "__routing_table"])
    return rows.select(*DATA, "__cdc_operation", "__source_db", "__routing_schema", "__routing_table")


@query(
    "j5_message_drift",
    """with e as (select distinct event_type as t from {change_feed})
    select t as table_name, 'gone' as column_name, 'absent' as drift, null as seen, 'nvarchar(20)' as declared from e
    union all select event_type, 'extra', 'undeclared', 'BOOLEAN', null from {change_feed} where event_id % 3 = 0 group by event_type
    union all select t, 'VALUE', 'type', case t when 'error' then 'STRING' else 'VARIANT' end, 'money' from e where t in ('error', 'click')""",
)
def _(t: Tables) -> DataFrame:
    # Messages of one table a type of event: errors write their value as text, clicks now so, now so.
    kind, texts = F.col("event_type"), (F.col("event_type") == "error") | ((F.col("event_type") == "click") & (F.col("event_id") % 20 < 10))
    source = F.struct(kind.alias("table"))
    extra = F.when(F.col("event_id") % 3 == 0, F.lit(True)).alias("extra")

    def message(value: Column) -> Column:
        row = F.struct("event_id", "pk", value.alias("value"), extra, F.struct("start_lsn").alias("Props"))
        return F.to_json(F.struct(F.struct(F.lit("u").alias("op"), row.alias("after"), source.alias("source")).alias("payload")))

    text, number = F.concat(F.lit("v"), F.col("event_id").cast("string")), F.coalesce(F.col("value"), F.lit(0.5))
    messages = t("change_feed").select(F.when(texts, message(text)).otherwise(message(number)).alias("value"))
    declared = "explode(array(struct('EVENT_ID', 'bigint'), struct('pk', 'int'), struct('VALUE', 'money'), struct('props', 'nvarchar(max)'), struct('gone', 'nvarchar(20)'))) as d"
    catalog = t("change_feed").select(kind.alias("table_name")).distinct().selectExpr("table_name", declared)
    catalog = catalog.select("table_name", F.col("d.col1").alias("column_name"), F.col("d.col2").alias("type_name"))
    return variants.message_drift(variants.observed_columns(variants.parse_variant(messages)), catalog)


@query("b5_require_lsn", "select event_id, max_lsn from (select event_id, case event_id % 4 when 0 then cast(null as varchar) when 1 then 'null' else start_lsn end as max_lsn from {change_feed}) where max_lsn is not null and max_lsn <> 'null'")
def _(t: Tables) -> DataFrame:
    rows = t("change_feed").withColumn(
        "max_lsn", F.expr("case event_id % 4 when 0 then null when 1 then 'null' else start_lsn end")
    )
    return feeds.require_lsn(rows).select("event_id", "max_lsn")


@query("b6_derive_route", "select kafka_offset, split_part(topic, '.', 2) as __routing_schema, split_part(topic, '.', 5) as __routing_table from {topic_feed}")
def _(t: Tables) -> DataFrame:
    return feeds.derive_route(t("topic_feed")).select("kafka_offset", "__routing_schema", "__routing_table")


@query(
    "b7_stamp_metadata_brokered",
    """select kafka_offset, pk, cast('2024-02-01 00:00:00' as timestamp) as __sync_timestamp, 'kafka-cdc' as __source, 'appdb' as __source_db,
    'Events' as __source_table, source_ts_ms as __source_ts_ms, op as __cdc_operation, kafka_offset as __kafka_offset,
    kafka_partition as __kafka_partition, cast('2024-02-01 00:00:00' as timestamp) as __kafka_timestamp from {topic_feed}""",
)
def _(t: Tables) -> DataFrame:
    rows = t("topic_feed")
    broker = {"__kafka_offset": F.col("kafka_offset"), "__kafka_partition": F.col("kafka_partition"), "__kafka_timestamp": moment()}
    out = stamp_metadata(rows, "brokered", moment(), "appdb", "Events", F.col("op"), F.col("source_ts_ms"), broker=broker)
    return out.drop("kafka_partition", "topic", "op", "source_ts_ms", "event_type", "value")


@query(
    "b7_stamp_metadata_native",
    """select event_id, cast('2024-02-01 00:00:00' as timestamp) as __sync_timestamp, 'mssql_cdc' as __source, 'appdb' as __source_db,
    'events' as __source_table, start_lsn as __source_start_lsn, seqval as __source_seqval, op_code as __cdc_operation from {change_feed}""",
)
def _(t: Tables) -> DataFrame:
    rows = t("change_feed").select("event_id", "start_lsn", "seqval", "op_code")
    out = stamp_metadata(
        rows, "native", moment(), "appdb", "events", op=F.col("op_code"), lsn=F.col("start_lsn"), seq=F.col("seqval")
    )
    return out.drop("start_lsn", "seqval", "op_code")


@query("b8_message_key", "select event_id, concat(cast(pk as varchar), '|', coalesce(case when event_id % 3 = 0 then event_type end, ''), '|', table_name) as message_key from {change_feed}")
def _(t: Tables) -> DataFrame:
    maybe = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    return t("change_feed").select("event_id", message_key(["pk", maybe, "table_name"]).alias("message_key"))


@query(
    "b9_topic_name",
    "select event_id, concat('dev.', customer_id, '.dbo.', event_type) as topic, concat('cdc-dbo-', event_type) as custom_topic from {change_feed}",
)
def _(t: Tables) -> DataFrame:
    prefix = F.concat(F.lit("dev."), F.col("customer_id"))
    return t("change_feed").select(
        "event_id",
        topic_name(prefix, F.lit("dbo"), F.col("event_type")).alias("topic"),
        topic_name(prefix, F.lit("dbo"), F.col("event_type"), "cdc-{schema}-{table}").alias("custom_topic"),
    )


@query(
    "d18_feed_sizes",
    """select event_type, count(*) as row_count, case when count(*) > 500000 then 'critical' when count(*) > 100000 then 'warning' else 'ok' end as level
    from {change_feed} group by event_type""",
)
def _(t: Tables) -> DataFrame:
    return feed_sizes(t("change_feed"), ["event_type"])


@query("f1_bounded_batch", f"select event_id, start_lsn, seqval from {{change_feed}} where start_lsn >= '{START_LSN}' and op_code in (1, 2, 4) order by start_lsn, seqval limit 2000")
def _(t: Tables) -> DataFrame:
    # The cap of one pull of a busy feed; the rest is the next pull's.
    return feeds.scan_changes(t("change_feed"), START_LSN, limit=2000).select("event_id", "start_lsn", "seqval")


@query("f2_last_position", "select start_lsn as last_start_lsn, seqval as last_seqval from {change_feed} order by start_lsn desc, seqval desc limit 1")
def _(t: Tables) -> DataFrame:
    return feeds.last_position(t("change_feed"))


@query(
    "k2_route_by",
    """select event_id, case when value >= 90 then 'urgent-queue' when event_type = 'signup' then 'notifications' else 'general-events' end as route from {events}""",
)
def _(t: Tables) -> DataFrame:
    cases = [("value >= 90", "urgent-queue"), ("event_type = 'signup'", "notifications")]
    return route_by(t("events"), cases, "general-events").select("event_id", "route")


@query("a15_flag_errors", "select event_id, case when event_type = 'view' then 'not a change' when value < 1 then 'value missing' end as error from {events}")
def _(t: Tables) -> DataFrame:
    return flag_errors(t("events"), {"not a change": "event_type <> 'view'", "value missing": "value >= 1"}).select("event_id", "error")
