"""Registrations, schedules and states of feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.operators import registry as R
from changefeed.operators.monitor import activity_rollup
from queries.base import Tables, moment, query
from queries.monitor import _ROLLUP

NOW = "2024-01-01 12:30:00"
_ON_FEED = "{a}.source_instance_key = {b}.source_instance_key and {a}.logical_table_name = {b}.logical_table_name"


def _on(a: str, b: str) -> str:
    return _ON_FEED.format(a=a, b=b)


_PRESETS = """(values ('hot', 1, 1, 30, 2000, 120, 0, 60), ('warm', 5, 5, 60, 1000, 120, 250, 300), ('cool', 30, 30, 300, 750, 120, 1000, 300),
  ('cold', 60, 60, 1800, 500, 180, 5000, 900)) d(profile, base, low, high, max_rows, lease, jitter, backoff)"""

_FILLED = f"""select p.source_instance_key, p.logical_table_name, p.enabled, coalesce(p.schedule_profile, 'warm') as schedule_profile, p.tier_mode,
    case when p.tier_mode = 'manual' then coalesce(p.manual_schedule_profile, p.schedule_profile, 'warm') else p.manual_schedule_profile end as manual_schedule_profile,
    coalesce(p.base_poll_interval_seconds, d.base) as base_poll_interval_seconds, coalesce(p.min_poll_interval_seconds, d.low) as min_poll_interval_seconds,
    coalesce(p.max_poll_interval_seconds, d.high) as max_poll_interval_seconds, coalesce(p.max_rows_per_pull, d.max_rows) as max_rows_per_pull,
    coalesce(p.lease_seconds, d.lease) as lease_seconds, coalesce(p.poll_priority, 100) as poll_priority, coalesce(p.jitter_millis, d.jitter) as jitter_millis,
    coalesce(p.max_backoff_seconds, d.backoff) as max_backoff_seconds, coalesce(p.config_version, 1) as config_version
    from {{policies}} p join {_PRESETS} on d.profile = coalesce(p.schedule_profile, 'warm')"""


@query("h8_fill_tier_defaults", _FILLED)
def _(t: Tables) -> DataFrame:
    return R.fill_tier_defaults(t("policies"))


_RESOLVED = f"""select r.source_instance_key, r.logical_table_name, coalesce(p.enabled, true) as enabled,
    case when p.tier_mode is null then 'warm' else p.schedule_profile end as schedule_profile, coalesce(p.tier_mode, 'auto') as tier_mode, p.manual_schedule_profile,
    case when p.tier_mode is null then 5 else p.base_poll_interval_seconds end as base_poll_interval_seconds,
    case when p.tier_mode is null then 5 else p.min_poll_interval_seconds end as min_poll_interval_seconds,
    case when p.tier_mode is null then 60 else p.max_poll_interval_seconds end as max_poll_interval_seconds,
    case when p.tier_mode is null then 1000 else p.max_rows_per_pull end as max_rows_per_pull,
    case when p.tier_mode is null then 120 else p.lease_seconds end as lease_seconds,
    case when p.tier_mode is null then 250 else p.jitter_millis end as jitter_millis,
    case when p.tier_mode is null then 300 else p.max_backoff_seconds end as max_backoff_seconds,
    case when p.tier_mode is null then 100 else p.poll_priority end as poll_priority
    from {{registrations}} r left join {{policies}} p on {_on('p', 'r')}"""


@query("g1_resolve_policy", _RESOLVED)
def _(t: Tables) -> DataFrame:
    return R.resolve_policy(t("registrations"), t("policies"))


@query(
    "c4_unregistered_policies",
    f"select p.source_instance_key, p.logical_table_name from {{policies}} p where not exists (select 1 from {{registrations}} r where {_on('r', 'p')})",
)
def _(t: Tables) -> DataFrame:
    return t("policies").join(t("registrations"), R.FEED, "left_anti").select(*R.FEED)


_EFFECTIVE = """case when p.tier_mode = 'manual' then coalesce(p.manual_schedule_profile, p.schedule_profile, 'warm')
    when a.effective_schedule_profile is not null then a.effective_schedule_profile else coalesce(p.schedule_profile, 'warm') end"""
_JOINED = f"""from {{registrations}} r join {{policies}} p on {_on('p', 'r')} join {{runtime_states}} s on {_on('s', 'r')}
    join {{instances}} i on i.source_instance_key = r.source_instance_key join {{tenants}} c on c.customer_key = i.customer_key
    left join {{tiers}} a on {_on('a', 'r')} left join {{bootstrap_states}} b on {_on('b', 'r')}"""


_DETAILED = _JOINED.replace("{policies}", "{policy_details}").replace("{runtime_states}", "{runtime_details}").replace("{instances}", "{instance_details}")
_DETAILED = _DETAILED.replace("{tiers}", "{tier_details}").replace("{bootstrap_states}", "{bootstrap_details}")


def _details(t: Tables) -> list[DataFrame]:
    names = ["registrations", "policy_details", "runtime_details", "instance_details", "tenants", "tier_details", "bootstrap_details"]
    return [t(n) for n in names]


def _registry(t: Tables) -> list[DataFrame]:
    names = ["registrations", "policies", "runtime_states", "instances", "tenants", "tiers", "bootstrap_states"]
    return [t(n) for n in names]


@query(
    "c1_schedule_view",
    f"""select r.source_instance_key, r.logical_table_name, r.target_schema_name, r.target_table_name, r.enabled and i.enabled and p.enabled as enabled,
    coalesce(b.bootstrap_status, 'pending') as bootstrap_status, p.schedule_profile, p.tier_mode, p.manual_schedule_profile, {_EFFECTIVE} as effective_schedule_profile,
    s.current_poll_interval_seconds as poll_interval_seconds, p.base_poll_interval_seconds, p.min_poll_interval_seconds, p.max_poll_interval_seconds, p.max_rows_per_pull,
    p.lease_seconds, p.jitter_millis, p.max_backoff_seconds, p.poll_priority, p.config_version,
    b.last_started_at as bootstrap_last_started_at, b.last_completed_at as bootstrap_last_completed_at, b.last_failed_at as bootstrap_last_failed_at, b.last_error as bootstrap_last_error,
    s.last_pull_started_at, s.last_pull_at, s.last_success_at, s.last_nonempty_at, s.next_pull_at, s.last_batch_rows, s.last_duration_ms, s.consecutive_failures, s.last_error,
    s.lease_owner, s.lease_expires_at, s.empty_pull_streak, a.previous_schedule_profile, a.change_reason, a.last_evaluated_at, a.last_promoted_at, a.last_demoted_at,
    i.source_database, i.fdw_schema_name, c.customer_id {_DETAILED}""",
)
def _(t: Tables) -> DataFrame:
    return R.schedule_view(*_details(t))


@query(
    "c2_health_view",
    f"""select r.source_instance_key, r.logical_table_name, r.target_schema_name, r.target_table_name, r.enabled as registration_enabled, i.enabled as source_instance_enabled,
    p.enabled as policy_enabled, coalesce(b.bootstrap_status, 'pending') as bootstrap_status, {_EFFECTIVE} as effective_schedule_profile,
    b.last_started_at as bootstrap_last_started_at, b.last_completed_at as bootstrap_last_completed_at, b.last_failed_at as bootstrap_last_failed_at, b.last_error as bootstrap_last_error,
    b.last_rows_loaded as bootstrap_last_rows_loaded, b.last_captured_start_lsn as bootstrap_last_captured_start_lsn, b.last_captured_seqval as bootstrap_last_captured_seqval,
    p.schedule_profile, p.tier_mode, p.manual_schedule_profile, p.base_poll_interval_seconds, p.min_poll_interval_seconds, p.max_poll_interval_seconds, p.max_rows_per_pull,
    p.lease_seconds, p.jitter_millis, p.max_backoff_seconds, p.poll_priority, p.config_version, p.business_hours_profile_key, s.current_poll_interval_seconds, s.checkpoint_table_name,
    s.last_pull_started_at, s.last_pull_at, s.last_success_at, s.last_nonempty_at, s.next_pull_at, s.last_batch_rows, s.last_duration_ms, s.consecutive_failures, s.last_error,
    s.lease_owner, s.lease_expires_at, s.empty_pull_streak, a.previous_schedule_profile, a.change_reason, a.last_evaluated_at, a.last_promoted_at, a.last_demoted_at,
    k.updated_at as checkpoint_updated_at, i.fdw_schema_name,
    cast(greatest(0, coalesce(epoch(timestamp '{NOW}' - s.next_pull_at), 0)) as bigint) as overdue_seconds, k.last_start_lsn, k.last_seqval,
    coalesce(b.bootstrap_status, 'pending') <> 'completed' and (r.enabled or p.enabled) as unsafe_enabled_without_bootstrap,
    coalesce(b.bootstrap_status, 'pending') = 'completed' and k.last_start_lsn is null as unsafe_bootstrap_completed_without_checkpoint,
    coalesce(b.bootstrap_status, 'pending') = 'failed' as unsafe_failed_bootstrap,
    coalesce(b.bootstrap_status, 'pending') = 'pending' and r.enabled and p.enabled as unsafe_pending_bootstrap_enabled,
    coalesce(b.last_started_at is not null and b.last_completed_at is null and b.last_failed_at is null and timestamp '{NOW}' - b.last_started_at > interval 1 hour, false) as unsafe_stalled_bootstrap,
    i.source_database, c.customer_id {_DETAILED}
    left join {{checkpoint_details}} k on k.customer_id = c.customer_id and k.table_name = s.checkpoint_table_name""",
)
def _(t: Tables) -> DataFrame:
    return R.health_view(*_details(t), t("checkpoint_details"), moment(NOW))


_DUE = f"""select s.source_instance_key, s.logical_table_name, coalesce(s.next_pull_at, timestamp '{NOW}') as next_pull_at, s.current_poll_interval_seconds, r.target_schema_name, r.target_table_name,
    coalesce(p.poll_priority, 100) as poll_priority, p.max_rows_per_pull, p.lease_seconds, c.customer_id
    from {{runtime_states}} s join {{registrations}} r on {_on('r', 's')} join {{policies}} p on {_on('p', 's')}
    join {{instances}} i on i.source_instance_key = s.source_instance_key join {{tenants}} c on c.customer_key = i.customer_key
    join {{bootstrap_states}} b on {_on('b', 's')}
    where r.enabled and p.enabled and i.enabled and b.bootstrap_status = 'completed'
    and exists (select 1 from {{registry_checkpoints}} k where k.customer_id = c.customer_id and k.table_name = s.logical_table_name and k.last_start_lsn is not null)
    and coalesce(s.next_pull_at, timestamp '{NOW}') <= timestamp '{NOW}' and (s.lease_expires_at is null or s.lease_expires_at <= timestamp '{NOW}')"""


@query("f3_due_work", _DUE + " order by poll_priority, next_pull_at, source_instance_key, logical_table_name limit 100")
def _(t: Tables) -> DataFrame:
    reg, policy, runtime, instances, tenants, _tiers, bootstrap = _registry(t)
    return R.due_work(reg, policy, runtime, instances, tenants, bootstrap, t("registry_checkpoints"), moment(NOW))


@query(
    "c3_checkpointed_feeds",
    """select r.source_instance_key, r.logical_table_name from {registrations} r join {instances} i on i.source_instance_key = r.source_instance_key
    join {tenants} c on c.customer_key = i.customer_key where exists (select 1 from {registry_checkpoints} k where k.customer_id = c.customer_id and lower(k.table_name) = lower(r.logical_table_name))""",
)
def _(t: Tables) -> DataFrame:
    tenants = t("instances").join(t("tenants"), "customer_key").select("source_instance_key", "customer_id")
    checkpointed = t("registry_checkpoints").select("customer_id", F.lower("table_name").alias("__table"))
    feeds = t("registrations").join(tenants, "source_instance_key").withColumn("__table", F.lower("logical_table_name"))
    return feeds.join(checkpointed, ["customer_id", "__table"], "left_semi").select(*R.FEED)


@query(
    "c9_resolve_tenant",
    f"""select f.source_instance_key, f.logical_table_name, f.pull_id, c.customer_id, i.source_database from
    (select concat('src_', cast(cast(floor(user_id / 10) as bigint) as varchar)) as source_instance_key, concat('tbl_', cast(user_id % 10 as varchar)) as logical_table_name, event_id as pull_id from {{events}}) f
    join {{registrations}} r on {_on('r', 'f')} join {{instances}} i on i.source_instance_key = f.source_instance_key join {{tenants}} c on c.customer_key = i.customer_key
    where r.enabled and i.enabled""",
)
def _(t: Tables) -> DataFrame:
    feeds = t.sql(
        """select concat('src_', cast(cast(floor(user_id / 10) as bigint) as string)) as source_instance_key,
        concat('tbl_', cast(user_id % 10 as string)) as logical_table_name, event_id as pull_id from {events}"""
    )
    return R.resolve_tenant(feeds, t("instances"), t("tenants"), t("registrations"))


_PLAN_CASE = """case when not i.enabled then 'skipped_source_disabled' when coalesce(b.bootstrap_status, 'pending') = 'completed' then 'skipped_already_initialized'
    when coalesce(b.bootstrap_status, 'pending') = 'in_progress' then 'skipped_in_progress' when r.enabled or p.enabled then 'skipped_active'
    when coalesce(b.bootstrap_status, 'pending') not in ('pending', 'failed') then 'skipped_unknown_state' else 'eligible' end"""
_PLAN = f"""select r.source_instance_key, r.logical_table_name, r.target_schema_name, r.target_table_name, {_PLAN_CASE} as result_status, coalesce(b.bootstrap_status, 'pending') as bootstrap_status
    from {{registrations}} r join {{instances}} i on i.source_instance_key = r.source_instance_key join {{policies}} p on {_on('p', 'r')} left join {{bootstrap_states}} b on {_on('b', 'r')}"""
_PLAN_COLUMNS = [*R.FEED, "target_schema_name", "target_table_name", "result_status", "bootstrap_status"]


@query("h6_bootstrap_plan", _PLAN + " where coalesce(b.bootstrap_status, 'pending') = 'pending'")
def _(t: Tables) -> DataFrame:
    plan = R.bootstrap_plan(t("registrations"), t("policies"), t("instances"), t("bootstrap_states"))
    return plan.select(*_PLAN_COLUMNS)


@query(
    "h6_bootstrap_plan_requested",
    _PLAN
    + """ where exists (select 1 from {requested_tables} q where lower(q.table_name) = lower(r.logical_table_name))
    union all select cast(null as varchar), q.table_name, cast(null as varchar), cast(null as varchar), 'skipped_not_found', cast(null as varchar) from {requested_tables} q
    where not exists (select 1 from {registrations} r where lower(r.logical_table_name) = lower(q.table_name))""",
)
def _(t: Tables) -> DataFrame:
    plan = R.bootstrap_plan(t("registrations"), t("policies"), t("instances"), t("bootstrap_states"), t("requested_tables"))
    return plan.select(*_PLAN_COLUMNS)


_SETTINGS = [
    "enabled", "schedule_profile", "tier_mode", "manual_schedule_profile", "base_poll_interval_seconds", "min_poll_interval_seconds", "max_poll_interval_seconds",
    "max_rows_per_pull", "lease_seconds", "jitter_millis", "max_backoff_seconds", "poll_priority",
]
_SAME = " and ".join(f"p.{c} is not distinct from d.{c}" for c in _SETTINGS)
_WANTED = f"(select source_instance_key, logical_table_name, {', '.join(_SETTINGS)} from ({_FILLED}))"


@query(
    "h7_sync_policies",
    f"""with d as (select w.* from {_WANTED} w where exists (select 1 from {{registrations}} r where {_on('r', 'w')})
      union all select r.source_instance_key, r.logical_table_name, true, 'warm', 'auto', null, 5, 5, 60, 1000, 120, 250, 300, 100
      from {{registrations}} r where not exists (select 1 from {{policies}} p where {_on('p', 'r')}))
    select coalesce(d.source_instance_key, p.source_instance_key) as source_instance_key, coalesce(d.logical_table_name, p.logical_table_name) as logical_table_name,
    {', '.join(f'case when d.logical_table_name is not null then d.{c} else p.{c} end as {c}' for c in _SETTINGS)},
    case when p.logical_table_name is null then 1 when d.logical_table_name is null or ({_SAME}) then p.config_version else p.config_version + 1 end as config_version,
    case when p.logical_table_name is null then 'inserted' when d.logical_table_name is null or ({_SAME}) then 'unchanged' else 'updated' end as sync_action
    from d full outer join {{policies}} p on {_on('p', 'd')}""",
)
def _(t: Tables) -> DataFrame:
    policies, reg = t("policies"), t("registrations")
    stored = R.fill_tier_defaults(policies).select(*R.FEED, *_SETTINGS)
    fresh = R.resolve_policy(reg, policies).join(policies.select(*R.FEED), R.FEED, "left_anti").select(*R.FEED, *_SETTINGS)
    return R.sync_policies(reg, policies, stored.unionByName(fresh))


@query(
    "h7_sync_tiers",
    f"""select p.source_instance_key, p.logical_table_name,
    case when a.change_reason is null or (p.tier_mode = 'manual' and a.effective_schedule_profile is distinct from coalesce(p.manual_schedule_profile, p.schedule_profile, 'warm'))
      then (case when p.tier_mode = 'manual' then coalesce(p.manual_schedule_profile, p.schedule_profile, 'warm') else coalesce(p.schedule_profile, 'warm') end) else a.effective_schedule_profile end as effective_schedule_profile,
    case when a.change_reason is not null and p.tier_mode = 'manual' and a.effective_schedule_profile is distinct from coalesce(p.manual_schedule_profile, p.schedule_profile, 'warm')
      then a.effective_schedule_profile else a.previous_schedule_profile end as previous_schedule_profile,
    case when a.change_reason is null or (p.tier_mode = 'manual' and a.effective_schedule_profile is distinct from coalesce(p.manual_schedule_profile, p.schedule_profile, 'warm'))
      then (case when p.tier_mode = 'manual' then 'manual policy sync' else 'initial baseline tier' end) else a.change_reason end as change_reason
    from {{policies}} p left join {{tiers}} a on {_on('a', 'p')}""",
)
def _(t: Tables) -> DataFrame:
    return R.sync_tiers(t("policies"), t("tiers"))


@query(
    "h7_sync_bootstrap",
    f"""select source_instance_key, logical_table_name, bootstrap_status from {{bootstrap_states}}
    union all select r.source_instance_key, r.logical_table_name, case when k.last_start_lsn is not null then 'completed' else 'pending' end
    from {{registrations}} r left join {{instances}} i on i.source_instance_key = r.source_instance_key left join {{tenants}} c on c.customer_key = i.customer_key
    left join {{registry_checkpoints}} k on k.customer_id = c.customer_id and k.table_name = r.logical_table_name
    where not exists (select 1 from {{bootstrap_states}} b where {_on('b', 'r')})""",
)
def _(t: Tables) -> DataFrame:
    return R.sync_bootstrap(t("registrations"), t("bootstrap_states"), t("instances"), t("tenants"), t("registry_checkpoints"))


_FORCED = "case coalesce(p.manual_schedule_profile, p.schedule_profile, 'warm') when 'hot' then 1 when 'cool' then 30 when 'cold' then 60 else 5 end"


@query(
    "h7_sync_runtime",
    f"""select p.source_instance_key, p.logical_table_name,
    case when p.tier_mode = 'manual' then {_FORCED} else coalesce(s.current_poll_interval_seconds, p.base_poll_interval_seconds) end as current_poll_interval_seconds,
    case when p.tier_mode = 'manual' and coalesce(s.current_poll_interval_seconds, p.base_poll_interval_seconds) is distinct from {_FORCED}
      then timestamp '{NOW}' + to_seconds({_FORCED}) else coalesce(s.next_pull_at, timestamp '{NOW}') end as next_pull_at
    from {{policies}} p left join {{runtime_states}} s on {_on('s', 'p')}""",
)
def _(t: Tables) -> DataFrame:
    return R.sync_runtime(t("policies"), t("runtime_states"), moment(NOW))


@query(
    "h10_feed_status",
    """with o as (select *, max(case when not failed then pull_id end) over w as ok_id, max(case when not failed and rows_pulled > 0 then pull_id end) over w as full_id, max(pull_id) over w as last_id
      from {pull_log} window w as (partition by source_instance_key, logical_table_name))
    select o.source_instance_key, o.logical_table_name, max(pulled_at) as last_pull_at, max(case when not failed then pulled_at end) as last_success_at,
    max(case when not failed and rows_pulled > 0 then pulled_at end) as last_nonempty_at, max(case when pull_id = ok_id then rows_pulled end) as last_batch_rows,
    count(*) filter (where not failed and rows_pulled = 0 and (full_id is null or pull_id > full_id)) as empty_pull_streak,
    count(*) filter (where failed and (ok_id is null or pull_id > ok_id)) as consecutive_failures,
    max(pulled_at) + to_seconds(case when bool_or(pull_id = last_id and failed) then greatest(120, any_value(coalesce(x.base, 60))) else any_value(coalesce(x.base, 60)) end) as next_pull_at
    from o left join (select source_instance_key, event_type, base from (select distinct concat('src_', cast(cast(floor(c_custkey / 10) as bigint) as varchar)) as source_instance_key, 'click' as event_type, 300 as base from {customer})) x
      on x.source_instance_key = o.source_instance_key and x.event_type = o.logical_table_name
    group by o.source_instance_key, o.logical_table_name""",
)
def _(t: Tables) -> DataFrame:
    policy = t("registrations").select(
        "source_instance_key", F.lit("click").alias("logical_table_name"), F.lit(300).alias("base_poll_interval_seconds")
    ).distinct()
    return R.feed_status(t("pull_log"), policy)


@query(
    "h11_evaluate_tiers",
    f"""with roll as ({_ROLLUP}), t as (select distinct source_instance_key, logical_table_name,
      case logical_table_name when 'click' then 'hot' when 'view' then 'warm' when 'error' then 'cool' when 'signup' then 'cold' else 'warm' end as tier from {{pull_log}}),
    s as (select source_instance_key, logical_table_name,
      sum(case when bucket_start >= timestamp '2024-01-08 00:00:00' - interval 6 hour then pulls_total end) as ps, sum(case when bucket_start >= timestamp '2024-01-08 00:00:00' - interval 6 hour then nonempty_pulls_total end) as ns,
      sum(pulls_total) as pl, sum(nonempty_pulls_total) as nl from roll where bucket_start >= timestamp '2024-01-01 00:00:00' and bucket_start < timestamp '2024-01-08 00:00:00' group by source_instance_key, logical_table_name),
    e as (select t.*, case when tier = 'warm' and ps > 0 and ns * 100 > ps * 80 then 'hot' when tier = 'cool' and ps > 0 and ns * 100 > ps * 50 then 'warm' when tier = 'cold' and ps > 0 and ns * 100 > ps * 30 then 'cool' end as up,
      case when tier = 'hot' and pl > 0 and nl * 100 < pl * 10 then 'warm' when tier = 'warm' and pl > 0 and nl * 100 < pl * 5 then 'cool' when tier = 'cool' and pl > 0 and nl = 0 then 'cold' end as down
      from t left join s on s.source_instance_key = t.source_instance_key and s.logical_table_name = t.logical_table_name)
    select source_instance_key, logical_table_name, tier as previous_schedule_profile, coalesce(up, down, tier) as effective_schedule_profile,
    case when up is not null then 'promoted' when down is not null then 'demoted' else 'unchanged' end as change from e""",
)
def _(t: Tables) -> DataFrame:
    pulls = t("pull_log")
    tiers = pulls.select(
        *R.FEED,
        F.expr("case logical_table_name when 'click' then 'hot' when 'view' then 'warm' when 'error' then 'cool' when 'signup' then 'cold' else 'warm' end").alias("effective_schedule_profile"),
    ).distinct()
    return R.evaluate_tiers(activity_rollup(pulls, 900), tiers, moment("2024-01-08 00:00:00"))


_RUNS = """(select source_instance_key, logical_table_name, rank_no as rows_loaded, lpad(hex(rank_no), 20, '0') as start_lsn, case when rank_no % 2 = 0 then lpad(hex(rank_no + 1), 20, '0') end as seqval,
  case when rank_no % 5 = 0 then 'source unreachable' end as error
  from (select concat('src_', cast(cast(floor(s_suppkey / 10) as bigint) as varchar(20))) as source_instance_key, concat('tbl_', cast(s_suppkey % 10 as varchar(10))) as logical_table_name, s_suppkey as rank_no from {supplier}) x)"""


def _bootstrap_states(t: Tables) -> DataFrame:
    # States as stored, with nothing recorded yet.
    nothing = F.lit(None)
    return t("bootstrap_states").withColumns(
        {
            "last_rows_loaded": nothing.cast("bigint"),
            "last_captured_start_lsn": nothing.cast("string"),
            "last_captured_seqval": nothing.cast("string"),
            "last_error": nothing.cast("string"),
        }
    )


@query(
    "h5_record_bootstrap",
    f"""select coalesce(b.source_instance_key, r.source_instance_key) as source_instance_key, coalesce(b.logical_table_name, r.logical_table_name) as logical_table_name,
    case when r.rows_loaded is null then b.bootstrap_status when r.error is null then 'completed' else 'failed' end as bootstrap_status, b.last_started_at,
    case when r.rows_loaded is not null and r.error is null then timestamp '{NOW}' else b.last_completed_at end as last_completed_at,
    case when r.rows_loaded is null then b.last_failed_at when r.error is not null then timestamp '{NOW}' end as last_failed_at,
    case when r.error is null then r.rows_loaded end as last_rows_loaded, case when r.error is null then r.start_lsn end as last_captured_start_lsn,
    case when r.error is null then r.seqval end as last_captured_seqval, r.error as last_error
    from {{bootstrap_states}} b full outer join {_RUNS} r on {_on('b', 'r')}""",
)
def _(t: Tables) -> DataFrame:
    return R.record_bootstrap(_bootstrap_states(t), t.sql(f"select * from {_RUNS}"), moment(NOW))


@query(
    "h5_enable_feeds",
    f"""select p.source_instance_key, p.logical_table_name, p.enabled or r.rows_loaded is not null as enabled, p.config_version + case when r.rows_loaded is not null then 1 else 0 end as config_version
    from {{policies}} p left join {_RUNS} r on {_on('p', 'r')}""",
)
def _(t: Tables) -> DataFrame:
    loaded = t.sql(f"select * from {_RUNS}")
    return R.enable_feeds(t("policies").select(*R.FEED, "enabled", "config_version"), loaded)
