"""Inputs of the queries, derived from the given tables by SQL both engines understand.

The given tables hold no change data, so these views give their rows the roles the
operators expect: events as changes, messages and pulls, line items as traces, customers as
feeds and databases, parts as catalog columns. Every view grows with its table. ``VIEWS``
reads the same in Spark and DuckDB; the few that cannot have one text per engine.
"""

VIEWS: dict[str, str] = {}
SPARK_VIEWS: dict[str, str] = {}
SQL_VIEWS: dict[str, str] = {}

# --- Feeds ------------------------------------------------------------------

VIEWS["change_feed"] = """
select event_id, user_id as pk, concat('tenant', cast(cast(floor(user_id / 10) as bigint) as varchar(20))) as customer_id,
  'events' as table_name,
  case event_id % 5 when 0 then 1 when 1 then 2 when 2 then 3 else 4 end as op_code,
  lpad(hex(cast(floor(event_id / 3) as bigint) + 1), 20, '0') as start_lsn,
  lpad(hex(event_id % 3), 20, '0') as seqval,
  ts as changed_at, event_type, value, props
from {events}
"""

VIEWS["topic_feed"] = """
select event_id as kafka_offset, cast(user_id % 2 as int) as kafka_partition,
  concat('dev.tenant', cast(cast(floor(user_id / 10) as bigint) as varchar(20)), '.appdb.dbo.',
         case when event_id % 10 = 9 then 'Unknown' else 'Events' end) as topic,
  case event_id % 7 when 0 then 'd' when 1 then 'c' when 6 then 'x' else 'u' end as op,
  1704067200000 + event_id * 60000 as source_ts_ms,
  user_id as pk, event_type, value
from {events}
"""

VIEWS["feed_checkpoints"] = """
select concat('tenant', cast(tenant_no as varchar(20))) as customer_id, 'events' as table_name,
  lpad(hex(mid), 20, '0') as last_start_lsn,
  case when tenant_no % 3 = 0 then cast(null as varchar(20)) else lpad(hex(cast(1 as bigint)), 20, '0') end as last_seqval
from (select cast(floor(user_id / 10) as bigint) as tenant_no,
             cast(floor(avg(event_id) / 3) as bigint) + 1 as mid
      from {events} group by cast(floor(user_id / 10) as bigint)) x
"""

VIEWS["outbox"] = """
select event_id as id, props as data, event_type as operation, ts as changed_at, event_id % 4 = 0 as processed
from {events}
"""

VIEWS["pull_log"] = """
select concat('src_', cast(cast(floor(user_id / 10) as bigint) as varchar(20))) as source_instance_key,
  event_type as logical_table_name, event_id as pull_id, ts as pulled_at,
  case when event_id % 3 = 0 then 0 else event_id % 1000 end as rows_pulled,
  event_id % 17 = 0 as failed
from {events}
"""

VIEWS["processing_log"] = """
select 'events' as table_name,
  case when tenant_no % 5 = 4 then cast(null as varchar(20)) else concat('tenant', cast(tenant_no as varchar(20))) end as customer_id,
  concat('dev.tenant', cast(tenant_no as varchar(20))) as kafka_topic,
  0 as kafka_partition, batch_no,
  min(event_id + gap) as min_kafka_offset, max(event_id + gap) as max_kafka_offset,
  count(*) as records_processed,
  case when batch_no % 23 = 5 then cast(null as bigint) else 1704067200000 + max(event_id) * 60000 end as max_source_ts_ms,
  lpad(hex(case when batch_no % 7 = 3 then batch_no - 2 else batch_no end), 20, '0') as start_lsn,
  lpad(hex(batch_no % 2), 20, '0') as seqval,
  max(ts) as processed_at
from (select cast(floor(event_id / 50) as bigint) as batch_no, cast(floor(event_id / 2500) as bigint) as tenant_no,
             cast(floor(event_id / 400) as bigint) * 50 as gap, event_id, ts
      from {events}) x
group by batch_no, tenant_no
"""

VIEWS["trace_log"] = """
select concat('evt-', cast(l_orderkey as varchar(20)), '-', cast(l_partkey as varchar(20)), '-', cast(l_linenumber as varchar(10))) as trace_id,
  concat(l_returnflag, l_linestatus) as table_name,
  cast(l_partkey % 1300 as double) as lag_capture_ms, cast(l_suppkey * 7 % 700 as double) as lag_kafka_produce_ms,
  l_quantity * 50 as lag_kafka_consume_ms, cast(l_orderkey % 6000 as double) as lag_sink_write_ms,
  cast(l_linenumber * 600 as double) as lag_merge_ms,
  cast(l_partkey % 1300 as double) + cast(l_suppkey * 7 % 700 as double) + l_quantity * 50
    + cast(l_orderkey % 6000 as double) + cast(l_linenumber * 600 as double) as lag_total_ms,
  l_shipdate as created_at
from {lineitem}
"""

SPARK_VIEWS["trace_times"] = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate as source_modified_at,
  timestampadd(MILLISECOND, l_partkey % 1300, l_shipdate) as source_captured_at,
  timestampadd(MILLISECOND, l_partkey % 1300 + 10, l_shipdate) as kafka_produced_at,
  timestampadd(MILLISECOND, l_partkey % 1300 + 10 + l_suppkey % 90, l_shipdate) as kafka_consumed_at,
  timestampadd(MILLISECOND, l_partkey % 1300 + 10 + l_suppkey % 90 + l_linenumber * 100, l_shipdate) as staging_inserted_at,
  timestampadd(MILLISECOND, l_partkey % 1300 + 10 + l_suppkey % 90 + l_linenumber * 100 + 5, l_shipdate) as target_merged_at
from {lineitem}
"""
SQL_VIEWS["trace_times"] = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate as source_modified_at,
  l_shipdate + to_milliseconds(l_partkey % 1300) as source_captured_at,
  l_shipdate + to_milliseconds(l_partkey % 1300 + 10) as kafka_produced_at,
  l_shipdate + to_milliseconds(l_partkey % 1300 + 10 + l_suppkey % 90) as kafka_consumed_at,
  l_shipdate + to_milliseconds(l_partkey % 1300 + 10 + l_suppkey % 90 + l_linenumber * 100) as staging_inserted_at,
  l_shipdate + to_milliseconds(l_partkey % 1300 + 10 + l_suppkey % 90 + l_linenumber * 100 + 5) as target_merged_at
from {lineitem}
"""

# --- A target and a batch of changes to it -------------------------------------

VIEWS["order_target"] = """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  lpad(hex(o_custkey), 20, '0') as start_lsn, lpad(hex(o_orderkey % 10), 20, '0') as seqval
from {orders}
"""

VIEWS["order_changes"] = """
select l_orderkey * 2 as o_orderkey, l_suppkey as o_custkey, l_linestatus as o_orderstatus, l_extendedprice as o_totalprice,
  case l_suppkey % 5 when 0 then 1 when 1 then 2 when 2 then 3 else 4 end as op_code,
  lpad(hex(l_partkey), 20, '0') as start_lsn,
  lpad(hex(l_suppkey * 100000 + l_linenumber * 10000 + cast(floor(l_quantity * 100) as bigint)), 20, '0') as seqval
from {lineitem}
"""

# --- Rows for rules and columns ----------------------------------------------

VIEWS["role_rows"] = """
select c_custkey as id, c_name as name, c_custkey % 2 = 0 as patient, c_custkey % 3 = 0 as ansatt,
  c_custkey % 5 = 0 as frilanser, cast(c_custkey % 6 as int) as priority, c_nationkey % 2 = 0 as is_active,
  case c_custkey % 4 when 0 then 'active' when 1 then 'pending' when 2 then 'closed' end as status,
  c_mktsegment as segment, c_acctbal as balance, cast(c_nationkey as int) as nation
from {customer}
"""

VIEWS["norwegian_names"] = """
select c_custkey as id, concat(c_name, case c_custkey % 4 when 0 then ' Bjørnstad' when 1 then ' Ærlig-Åsen' when 2 then '--' else ' Næss' end) as name
from {customer}
"""

# --- Databases, topologies, routes --------------------------------------------

VIEWS["db_names"] = """
select c_custkey as ord,
  concat('svc', cast(c_nationkey as varchar(10)), 'n', cast(c_custkey as varchar(20)),
    case c_custkey % 6 when 0 then '_db_prod_special' when 1 then '_dev' when 2 then '' when 3 then '_db_directory_test'
      when 4 then '_prod' else ' Shop' end) as db_name,
  case when c_custkey % 2 = 0 then 'default' else 'prod' end as server
from {customer}
"""

VIEWS["databases"] = """
select c_custkey as ord, concat('db_', cast(c_custkey as varchar(20))) as db_name,
  concat('svc', cast(cast(floor(c_custkey / 7) as bigint) as varchar(20))) as service,
  concat('Customer', cast(cast(floor(c_custkey / 3) as bigint) as varchar(20))) as customer,
  case c_custkey % 5 when 0 then 'dev' when 1 then 'nonprod' when 2 then 'prod' when 3 then '' else 'dev' end as environment,
  case when c_nationkey % 3 = 0 then 'default' else 'main' end as server,
  c_nationkey * 3 as table_count
from {customer}
"""

VIEWS["database_schemas"] = """
select concat('db_', cast(o_custkey as varchar(20))) as db_name,
  case o_orderkey % 4 when 0 then 'dbo' when 1 then 'public' when 2 then 'sales' else 'audit' end as schema_name
from {orders}
"""

VIEWS["db_tables"] = """
select case when p_partkey % 41 = 0 then 'master' else concat('db_', cast(cast(floor(p_partkey / 20) as bigint) as varchar(20)), case when p_size % 7 = 0 then '_tmp' else '' end) end as db_name,
  case when p_partkey % 2 = 0 then 'default' else 'prod' end as server,
  case p_size % 4 when 0 then 'sys_internal' when 1 then 'public' else 'dbo' end as schema_name,
  concat(replace(p_name, ' ', '_'), '_', cast(p_partkey as varchar(20))) as table_name,
  case when p_size % 9 = 0 then 'VIEW' else 'BASE TABLE' end as table_type
from {part}
"""

VIEWS["env_databases"] = """
select concat('svc', cast(cast(floor(c_custkey / 3) as bigint) as varchar(20))) as service,
  case c_custkey % 3 when 0 then 'dev' when 1 then 'nonprod' else 'prod' end as environment,
  c_nationkey as table_count
from {customer}
"""

VIEWS["env_schemas"] = """
select distinct concat('svc', cast(cast(floor(o_custkey / 3) as bigint) as varchar(20))) as service,
  case o_custkey % 3 when 0 then 'dev' when 1 then 'nonprod' else 'prod' end as environment,
  case o_orderkey % 5 when 0 then 'dbo' when 1 then 'public' when 2 then 'sales' when 3 then 'audit' else 'dbo' end as schema_name
from {orders}
"""

# Long topology: four rows per source. Row 0 is at source level, the others per environment.
VIEWS["topology"] = """
select concat('Source', cast(src as varchar(20))) as source_name,
  case slot when 0 then cast(null as varchar(20)) when 1 then 'dev' when 2 then 'nonprod' else 'prod' end as env,
  slot as ord,
  case when slot = 0 and src % 3 = 0 then 'customer_id' when slot = 0 then 'note'
    when src % 5 = 1 and slot = 2 then 'database' when src % 7 = 2 then 'server' else 'customer_id' end as key,
  case when src % 11 = 4 and slot = 3 then 'null' when src % 5 = 1 and slot = 2 then concat('db', cast(src as varchar(20)))
    when src % 7 = 2 then 'main' else concat('cust-', cast(src as varchar(20)), '-', cast(slot as varchar(20))) end as value
from (select cast(floor(c_custkey / 4) as bigint) as src, c_custkey % 4 as slot from {customer}) x
"""

# Connection settings per source and environment, for source plans.
VIEWS["connections"] = """
select concat(case when src % 2 = 0 then 'Tenant' else 'Kunde ' end, cast(src as varchar(20))) as source_name,
  case when slot = 0 then cast(null as varchar(20)) when src % 9 = 3 then 'prod' else 'dev' end as env,
  slot as ord,
  case slot when 0 then (case when src % 4 = 0 then 'customer_id' else 'note' end) when 1 then 'customer_id' when 2 then 'database' else 'server' end as key,
  case when slot = 1 and src % 6 = 5 then '  ' when slot = 2 and src % 8 = 6 then '' when slot = 3 and src % 10 = 7 then 'ghost'
    when slot = 3 then 'main' else concat('v', cast(src as varchar(20)), '-', cast(slot as varchar(20))) end as value
from (select cast(floor(c_custkey / 4) as bigint) as src, c_custkey % 4 as slot from {customer}) x
"""

VIEWS["servers"] = """
select distinct case when s_suppkey % 3 = 0 then 'main' else concat('srv', cast(s_suppkey as varchar(20))) end as server_name,
  case when s_suppkey % 3 = 0 then 'host-main' else concat('host-', cast(s_suppkey as varchar(20))) end as host
from {supplier}
"""

VIEWS["routes"] = """
select concat('sinks.', case when c_custkey % 3 = 0 then 'proxy' else 'main' end) as sink,
  concat('source', cast(cast(floor(c_custkey / 5) as bigint) as varchar(20))) as source_name,
  case c_custkey % 5 when 0 then 'dev' when 1 then 'nonprod' when 2 then 'prod' when 3 then 'default' else 'local' end as env,
  case when c_custkey % 11 = 0 then cast(null as varchar(20)) when c_custkey % 7 = 0 then 'qa' when c_custkey % 13 = 0 then ' '
    when c_custkey % 2 = 0 then cast(null as varchar(20)) else 'dev' end as target_sink_env,
  case when c_custkey % 13 = 0 then 'null' when c_custkey % 17 = 0 then ' ' else concat('cust-', cast(cast(floor(c_custkey / 2) as bigint) as varchar(20))) end as customer_id
from {customer}
"""

VIEWS["sink_targets"] = """
select distinct concat('sinks.', case when s_suppkey % 2 = 0 then 'proxy' else 'main' end) as sink,
  case s_suppkey % 4 when 0 then 'dev' when 1 then 'test' when 2 then 'production' else 'stage' end as target_env
from {supplier}
"""

VIEWS["sink_groups"] = """
select distinct concat('sinks.', case when s_suppkey % 2 = 0 then 'proxy' else 'main' end) as sink,
  s_suppkey % 2 = 0 as sink_env_aware, false as source_env_aware
from {supplier}
"""

# --- Registry: one feed per customer, ten feeds per source instance ----------------

_FEED = """concat('src_', cast(cast(floor(c_custkey / 10) as bigint) as varchar(20))) as source_instance_key,
  concat('tbl_', cast(c_custkey % 10 as varchar(10))) as logical_table_name"""
# Some rows belong to a feed nobody registered, so that joins also miss.
_FEED_MAYBE = """concat(case when c_custkey % {miss} = 0 then 'old_' else 'src_' end, cast(cast(floor(c_custkey / 10) as bigint) as varchar(20))) as source_instance_key,
  concat('tbl_', cast(c_custkey % 10 as varchar(10))) as logical_table_name"""


def _feed_maybe(miss: int) -> str:
    return _FEED_MAYBE.replace("{miss}", str(miss))


VIEWS["registrations"] = f"""
select {_FEED}, 'dbo' as remote_schema_name, 'sales' as target_schema_name,
  concat('tbl_', cast(c_custkey % 10 as varchar(10))) as target_table_name, c_custkey % 4 <> 1 as enabled
from {{customer}}
"""

VIEWS["policies"] = f"""
select {_feed_maybe(7)}, c_custkey % 5 <> 2 as enabled,
  case c_custkey % 5 when 0 then 'hot' when 1 then 'warm' when 2 then 'cool' when 3 then 'cold' end as schedule_profile,
  case when c_custkey % 6 = 0 then 'manual' else 'auto' end as tier_mode,
  case when c_custkey % 12 = 0 then 'cool' end as manual_schedule_profile,
  case when c_custkey % 2 = 0 then cast(c_nationkey as int) end as base_poll_interval_seconds,
  case when c_custkey % 3 = 0 then cast(c_nationkey as int) end as min_poll_interval_seconds,
  case when c_custkey % 4 = 0 then cast(c_nationkey + 60 as int) end as max_poll_interval_seconds,
  case when c_custkey % 5 = 0 then cast(c_nationkey * 100 as int) end as max_rows_per_pull,
  case when c_custkey % 3 = 1 then cast(c_nationkey + 30 as int) end as lease_seconds,
  case when c_custkey % 2 = 1 then cast(c_nationkey as int) end as poll_priority,
  case when c_custkey % 4 = 1 then cast(c_nationkey * 10 as int) end as jitter_millis,
  case when c_custkey % 4 = 2 then cast(c_nationkey * 20 as int) end as max_backoff_seconds,
  case when c_custkey % 8 <> 0 then c_custkey % 3 + 1 end as config_version
from {{customer}}
"""

VIEWS["runtime_states"] = f"""
select {_FEED}, concat('tbl_', cast(c_custkey % 10 as varchar(10))) as checkpoint_table_name,
  cast(c_nationkey + 1 as int) as current_poll_interval_seconds,
  case c_custkey % 4 when 0 then cast('2024-01-02 00:00:00' as timestamp) when 1 then cast('2024-01-01 12:00:00' as timestamp)
    when 2 then cast('2024-01-01 06:00:00' as timestamp) end as next_pull_at,
  case c_custkey % 3 when 0 then cast('2024-01-01 11:00:00' as timestamp) when 1 then cast('2024-01-01 13:00:00' as timestamp) end as lease_expires_at
from {{customer}}
"""
SPARK_VIEWS["runtime_states"] = VIEWS["runtime_states"].replace("as timestamp)", "as timestamp_ntz)")

VIEWS["instances"] = """
select concat('src_', cast(inst as varchar(20))) as source_instance_key, concat('cust_', cast(inst as varchar(20))) as customer_key,
  concat('db_', cast(inst as varchar(20))) as source_database, inst % 5 <> 3 as enabled
from (select distinct cast(floor(c_custkey / 10) as bigint) as inst from {customer}) x
"""

VIEWS["tenants"] = """
select concat('cust_', cast(inst as varchar(20))) as customer_key, concat('id-', cast(inst as varchar(20))) as customer_id
from (select distinct cast(floor(c_custkey / 10) as bigint) as inst from {customer}) x
"""

VIEWS["tiers"] = f"""
select {_feed_maybe(5)},
  case c_custkey % 6 when 0 then 'hot' when 1 then 'warm' when 2 then 'cool' when 3 then 'cold' when 4 then 'warm' end as effective_schedule_profile,
  case when c_custkey % 3 = 0 then 'warm' end as previous_schedule_profile, 'evaluated' as change_reason
from {{customer}}
"""

VIEWS["bootstrap_states"] = f"""
select {_feed_maybe(9)},
  case c_custkey % 7 when 0 then 'pending' when 1 then 'in_progress' when 2 then 'failed' when 3 then 'paused' else 'completed' end as bootstrap_status,
  case when c_custkey % 2 = 0 then cast('2024-01-01 10:00:00' as timestamp) when c_custkey % 3 = 0 then cast('2024-01-01 11:30:00' as timestamp) end as last_started_at,
  case when c_custkey % 7 > 3 then cast('2024-01-01 11:00:00' as timestamp) end as last_completed_at,
  case when c_custkey % 7 = 2 then cast('2024-01-01 11:00:00' as timestamp) end as last_failed_at
from {{customer}}
"""
SPARK_VIEWS["bootstrap_states"] = VIEWS["bootstrap_states"].replace("as timestamp)", "as timestamp_ntz)")

VIEWS["registry_checkpoints"] = """
select concat('id-', cast(cast(floor(c_custkey / 10) as bigint) as varchar(20))) as customer_id,
  concat('tbl_', cast(c_custkey % 10 as varchar(10)), case when c_custkey % 8 = 5 then '_old' else '' end) as table_name,
  lpad(hex(c_custkey + 1), 20, '0') as last_start_lsn,
  case when c_custkey % 2 = 0 then lpad(hex(cast(1 as bigint)), 20, '0') else cast(null as varchar(20)) end as last_seqval
from {customer}
"""

# The registry tables with every column that the schedule and health views show.
VIEWS["runtime_details"] = """
select v.*, next_pull_at - interval '3' hour as last_pull_started_at, next_pull_at - interval '2' hour as last_pull_at,
  case when current_poll_interval_seconds % 3 <> 0 then next_pull_at - interval '2' hour end as last_success_at,
  case when current_poll_interval_seconds % 4 = 0 then next_pull_at - interval '5' hour end as last_nonempty_at,
  current_poll_interval_seconds * 7 as last_batch_rows, current_poll_interval_seconds * 11 as last_duration_ms,
  case when current_poll_interval_seconds % 3 = 0 then 2 else 0 end as consecutive_failures,
  case when current_poll_interval_seconds % 3 = 0 then concat('timeout on ', logical_table_name) end as last_error,
  case when lease_expires_at is not null then concat('worker_', logical_table_name) end as lease_owner,
  current_poll_interval_seconds % 5 as empty_pull_streak
from {runtime_states} v
"""
VIEWS["tier_details"] = """
select v.*, cast('2024-01-01 09:00:00' as timestamp) as last_evaluated_at,
  case effective_schedule_profile when 'hot' then cast('2024-01-01 08:00:00' as timestamp) end as last_promoted_at,
  case effective_schedule_profile when 'cold' then cast('2024-01-01 07:00:00' as timestamp) end as last_demoted_at
from {tiers} v
"""
VIEWS["bootstrap_details"] = """
select v.*, case when last_completed_at is not null then 1000 end as last_rows_loaded,
  case when last_completed_at is not null then lpad('A1', 20, '0') end as last_captured_start_lsn,
  case when last_completed_at is not null and last_started_at is not null then lpad('2', 20, '0') end as last_captured_seqval,
  case when last_failed_at is not null then concat('no snapshot of ', logical_table_name) end as last_error
from {bootstrap_states} v
"""
VIEWS["policy_details"] = "select v.*, case when enabled then concat('hours_', tier_mode) end as business_hours_profile_key from {policies} v"
VIEWS["instance_details"] = "select v.*, concat('fdw_', source_instance_key) as fdw_schema_name from {instances} v"
VIEWS["checkpoint_details"] = """
select v.*, case when last_seqval is not null then cast('2024-01-01 11:45:00' as timestamp) end as updated_at from {registry_checkpoints} v
"""
for _name in ("tier_details", "checkpoint_details"):
    SPARK_VIEWS[_name] = VIEWS[_name].replace("as timestamp)", "as timestamp_ntz)")

VIEWS["requested_tables"] = """
select distinct case when s_suppkey % 5 = 0 then concat('Missing', cast(s_suppkey as varchar(20))) else concat('TBL_', cast(s_suppkey % 10 as varchar(10))) end as table_name
from {supplier}
"""

VIEWS["merge_control"] = """
select case when o_orderkey % 2 = 0 then 'sales' else 'hr' end as schema_name, concat('t', cast(o_orderkey as varchar(20))) as table_name,
  o_orderkey % 3 = 0 as has_changes, o_orderkey % 7 = 0 as is_merging,
  case when o_orderkey % 5 <> 0 then o_orderdate end as last_merge_at,
  case when o_orderkey % 4 <> 0 then o_orderdate end as last_change_at,
  o_custkey as merge_count, o_orderkey % 10 as last_merge_rows, cast(floor(o_totalprice) as bigint) as last_merge_duration_ms,
  o_orderdate as created_at
from {orders}
"""

VIEWS["error_log"] = """
select event_id as id, 'sales' as schema_name, event_type as table_name, props as error_msg, ts as occurred_at
from {events}
"""

# --- Catalogs: eight columns per table -----------------------------------------

_CATALOG = """
select {schema} as schema_name, {table} as table_name, p_partkey % 8 as ordinal,
  {column} as column_name, {type} as type_name, {nullable} as nullable, {key} as primary_key,
  case when p_partkey % 6 = 1 then '0' end as default_value
from {{part}}
"""
_TABLE_NO = "cast(floor(p_partkey / 8) as bigint)"
_SCHEMA = f"case when {_TABLE_NO} % 3 = 0 then 'sales' else 'dbo' end"
_TABLE = f"concat('T', cast({_TABLE_NO} as varchar(20)))"
_COLUMN = f"case when p_partkey % 8 = 0 then 'id' when {_TABLE_NO} % 5 = 0 and p_partkey % 8 = 3 then 'COL3' else concat('col', cast(p_partkey % 8 as varchar(10))) end"
_TYPE = (
    "case p_size % 14 when 0 then 'int' when 1 then 'nvarchar(50)' when 2 then 'DateTime2' when 3 then 'uniqueidentifier' "
    "when 4 then 'bit' when 5 then 'money' when 6 then 'varchar' when 7 then 'tinyint' when 8 then 'decimal(18, 2)' "
    "when 9 then 'geography' when 10 then 'text' when 11 then 'rowversion' when 12 then 'mystery' else 'bigint' end"
)
_NULLABLE = "p_size % 3 <> 0"
_KEY = f"p_partkey % 8 = 0 or (p_partkey % 8 = 1 and {_TABLE_NO} % 4 = 0)"


def _catalog(**parts: str) -> str:
    base = {"schema": _SCHEMA, "table": _TABLE, "column": _COLUMN, "type": _TYPE, "nullable": _NULLABLE, "key": _KEY}
    return _CATALOG.format(**{**base, **parts})


VIEWS["catalog_before"] = _catalog()
VIEWS["catalog_after"] = _catalog(
    table=f"case when {_TABLE_NO} % 19 = 7 then concat('New', cast({_TABLE_NO} as varchar(20))) else {_TABLE} end",
    column=f"case when p_partkey % 13 = 5 then concat('added', cast(p_partkey % 8 as varchar(10))) else {_COLUMN} end",
    type=f"case when p_partkey % 11 = 3 then 'bigint' else {_TYPE} end",
    nullable="case when p_partkey % 17 = 2 then p_size % 3 = 0 else p_size % 3 <> 0 end",
    key=f"(p_partkey % 8 = 0 and {_TABLE_NO} % 23 <> 5) or (p_partkey % 8 = 1 and {_TABLE_NO} % 4 = 0)",
)
# The same tables on the sink side, with the sink's own types.
VIEWS["sink_catalog"] = _catalog(
    column=f"case when p_partkey % 9 = 4 then concat('sink', cast(p_partkey % 8 as varchar(10))) else {_COLUMN} end",
    type=(
        "case p_size % 12 when 0 then 'integer' when 1 then 'varchar(80)' when 2 then 'timestamptz' when 3 then 'uuid' "
        "when 4 then 'boolean' when 5 then 'numeric' when 6 then 'text' when 7 then 'int8' when 8 then 'double precision' "
        "when 9 then 'bytea' when 10 then 'timestamp' else 'smallint' end"
    ),
)
VIEWS["column_mapping"] = f"""
select {_SCHEMA} as schema_name, {_TABLE} as table_name,
  case when p_partkey % 10 = 3 then 'ghost' else concat('col', cast(p_partkey % 8 as varchar(10))) end as source_column,
  case when p_partkey % 10 = 7 then 'phantom' else concat('sink', cast(p_partkey % 8 as varchar(10))) end as sink_column
from {{part}}
"""
VIEWS["catalog_tables"] = f"""
select schema_name, table_name, table_no % 6 = 1 as target_exists, case table_no % 4 when 0 then 'public' when 1 then 'sales' else concat('t', cast(table_no % 50 as varchar(10))) end as target_schema_name
from (select distinct {_SCHEMA} as schema_name, {_TABLE} as table_name, {_TABLE_NO} as table_no from {{part}}) x
"""
VIEWS["constraints"] = f"""
select {_SCHEMA} as schema_name, {_TABLE} as table_name, {_COLUMN} as column_name,
  case when {_KEY} then 'PRIMARY KEY' else 'UNIQUE' end as constraint_type
from {{part}}
"""
VIEWS["type_pairs"] = f"""
select concat({_SCHEMA}, '.', {_TABLE}) as source_table, {_COLUMN} as source_column, {_TYPE} as source_type,
  case p_partkey % 9 when 0 then 'integer' when 1 then 'character varying' when 2 then 'timestamp' when 3 then 'uuid'
    when 4 then 'bool' when 5 then 'numeric' when 6 then 'jsonb' when 7 then 'float8' else 'INT8' end as sink_type
from {{part}}
"""
VIEWS["type_overrides"] = f"""
select concat({_SCHEMA}, '.', {_TABLE}) as source_table, case when p_size < 10 then upper({_COLUMN}) else 'unused' end as source_column,
  case when p_partkey % 2 = 0 then 'bigint' else 'json' end as effective_type
from {{part}}
"""
