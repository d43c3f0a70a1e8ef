"""Registrations, schedules and states of many feeds, as joins over small tables.

A feed is (source_instance_key, logical_table_name). No join carries a broadcast hint:
the registry grows with the tenants, and adaptive execution measures it at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.functions.expressions import lookup

FEED = ["source_instance_key", "logical_table_name"]

# --- Fixed values -----------------------------------------------------------
DEFAULT_PROFILE = "warm"
DEFAULT_STATUS = "pending"
# Interval, cap and lease presets by schedule profile.
TIER_PRESETS = {
    "hot": {
        "base_poll_interval_seconds": 1,
        "min_poll_interval_seconds": 1,
        "max_poll_interval_seconds": 30,
        "max_rows_per_pull": 2000,
        "lease_seconds": 120,
        "jitter_millis": 0,
        "max_backoff_seconds": 60,
    },
    "warm": {
        "base_poll_interval_seconds": 5,
        "min_poll_interval_seconds": 5,
        "max_poll_interval_seconds": 60,
        "max_rows_per_pull": 1000,
        "lease_seconds": 120,
        "jitter_millis": 250,
        "max_backoff_seconds": 300,
    },
    "cool": {
        "base_poll_interval_seconds": 30,
        "min_poll_interval_seconds": 30,
        "max_poll_interval_seconds": 300,
        "max_rows_per_pull": 750,
        "lease_seconds": 120,
        "jitter_millis": 1000,
        "max_backoff_seconds": 300,
    },
    "cold": {
        "base_poll_interval_seconds": 60,
        "min_poll_interval_seconds": 60,
        "max_poll_interval_seconds": 1800,
        "max_rows_per_pull": 500,
        "lease_seconds": 180,
        "jitter_millis": 5000,
        "max_backoff_seconds": 900,
    },
}
DEFAULT_PRIORITY = 100
STALLED_AFTER_SECONDS = 3600
DEFAULT_RETRY_SECONDS = 120
DEFAULT_INTERVAL_SECONDS = 60
# Shares of non-empty pulls that move a feed to another tier.
PROMOTE_HOURS = 6
PROMOTE = {"warm": ("hot", 0.80), "cool": ("warm", 0.50), "cold": ("cool", 0.30)}
DEMOTE_DAYS = 7
DEMOTE = {"hot": ("warm", 0.10), "warm": ("cool", 0.05)}
DEMOTE_IDLE = {"cool": "cold"}
# --- End of fixed values ----------------------------------------------------

PRESET_COLUMNS = list(TIER_PRESETS["warm"])


def _preset(column: str, profile: Column) -> Column:
    values = {name: preset[column] for name, preset in TIER_PRESETS.items()}
    return F.coalesce(lookup(values, profile), F.lit(TIER_PRESETS[DEFAULT_PROFILE][column]))


def fill_tier_defaults(policy: DataFrame) -> DataFrame:
    """Fill what a policy leaves open from the presets of its profile."""
    profile = F.coalesce("schedule_profile", F.lit(DEFAULT_PROFILE))
    mode = F.coalesce("tier_mode", F.lit("auto"))
    manual = F.when(mode == "manual", F.coalesce("manual_schedule_profile", profile)).otherwise(
        F.col("manual_schedule_profile")
    )
    filled = {
        "enabled": F.coalesce("enabled", F.lit(True)),
        "schedule_profile": profile,
        "tier_mode": mode,
        "manual_schedule_profile": manual,
        **{c: F.coalesce(F.col(c), _preset(c, profile)) for c in PRESET_COLUMNS},
        "poll_priority": F.coalesce("poll_priority", F.lit(DEFAULT_PRIORITY)),
        "config_version": F.coalesce("config_version", F.lit(1)),
    }
    # One projection: every expression sees the columns as they were stored.
    return policy.select(*[filled.get(c, F.col(c)).alias(c) for c in policy.columns])


def resolve_policy(registrations: DataFrame, policy: DataFrame) -> DataFrame:
    """The stored policy of each registration, or the warm defaults where none is stored."""
    defaults = {
        "enabled": F.lit(True),
        "schedule_profile": F.lit(DEFAULT_PROFILE),
        "tier_mode": F.lit("auto"),
        "manual_schedule_profile": F.lit(None).cast("string"),
        **{c: F.lit(v) for c, v in TIER_PRESETS[DEFAULT_PROFILE].items()},
        "poll_priority": F.lit(DEFAULT_PRIORITY),
    }
    stored = policy.select(*FEED, *[F.col(c).alias(f"__{c}") for c in defaults], F.lit(True).alias("__stored"))
    joined = registrations.select(*FEED).join(stored, FEED, "left")
    return joined.select(
        *FEED, *[F.when(F.col("__stored"), F.col(f"__{c}")).otherwise(v).alias(c) for c, v in defaults.items()]
    )


def effective_profile(mode: Column, manual: Column, assigned: Column, stored: Column) -> Column:
    """Manual override, else the assigned tier, else the policy's profile, else warm."""
    by_policy = F.coalesce(stored, F.lit(DEFAULT_PROFILE))
    return F.when(mode == "manual", F.coalesce(manual, by_policy)).otherwise(F.coalesce(assigned, by_policy))


def resolve_tenant(feeds: DataFrame, instances: DataFrame, customers: DataFrame, registrations: DataFrame) -> DataFrame:
    """Add tenant id and source database to each feed; disabled instances and registrations drop out."""
    live = instances.filter(F.col("enabled")).select("source_instance_key", "customer_key", "source_database")
    active = registrations.filter(F.col("enabled")).select(*FEED)
    tenant = customers.select("customer_key", "customer_id")
    return feeds.join(active, FEED).join(live, "source_instance_key").join(tenant, "customer_key").drop("customer_key")


def _joined(reg: DataFrame, policy: DataFrame, runtime: DataFrame, instances: DataFrame, customers: DataFrame, tiers: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """One row per registration with everything known about it, each source in a struct column."""

    def packed(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        return df.select(*keys, F.struct(*[F.col(c) for c in df.columns if c not in keys]).alias(name))

    return (
        packed(reg, FEED, "reg")
        .join(packed(policy, FEED, "policy"), FEED)
        .join(packed(runtime, FEED, "runtime"), FEED)
        .join(packed(instances, ["source_instance_key"], "si"), "source_instance_key")
        .join(
            packed(customers, ["customer_key"], "cr").withColumnRenamed("customer_key", "__customer"),
            F.col("si.customer_key") == F.col("__customer"),
        )
        .join(packed(tiers, FEED, "tier"), FEED, "left")
        .join(packed(bootstrap, FEED, "boot"), FEED, "left")
    )


# Columns that both views show beside their own, with the types of those a given table may lack.
POLICY_COLUMNS = {"schedule_profile": "string", "tier_mode": "string", "manual_schedule_profile": "string", **dict.fromkeys(PRESET_COLUMNS, "int"), "poll_priority": "int", "config_version": "int"}
RUNTIME_COLUMNS = {
    **dict.fromkeys(("last_pull_started_at", "last_pull_at", "last_success_at", "last_nonempty_at", "next_pull_at"), "timestamp_ntz"),
    **dict.fromkeys(("last_batch_rows", "last_duration_ms", "consecutive_failures", "empty_pull_streak"), "int"),
    "last_error": "string", "lease_owner": "string", "lease_expires_at": "timestamp_ntz",
}
TIER_COLUMNS = {"previous_schedule_profile": "string", "change_reason": "string", **dict.fromkeys(("last_evaluated_at", "last_promoted_at", "last_demoted_at"), "timestamp_ntz")}
BOOT_COLUMNS = {**dict.fromkeys(("last_started_at", "last_completed_at", "last_failed_at"), "timestamp_ntz"), "last_error": "string"}
CAPTURED_COLUMNS = {"last_rows_loaded": "int", "last_captured_start_lsn": "string", "last_captured_seqval": "string"}


def _shown(table: DataFrame, name: str, columns: Mapping[str, str], prefix: str = "") -> list[Column]:
    """Columns of a joined table; null where the given one lacks them."""
    return [(F.col(f"{name}.{c}") if c in table.columns else F.lit(None).cast(t)).alias(prefix + c) for c, t in columns.items()]


def schedule_view(reg: DataFrame, policy: DataFrame, runtime: DataFrame, instances: DataFrame, customers: DataFrame, tiers: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """What is scheduled how: one row per registration."""
    j = _joined(reg, policy, runtime, instances, customers, tiers, bootstrap)
    return j.select(
        *FEED,
        "reg.target_schema_name",
        "reg.target_table_name",
        (F.col("reg.enabled") & F.col("si.enabled") & F.col("policy.enabled")).alias("enabled"),
        F.coalesce("boot.bootstrap_status", F.lit(DEFAULT_STATUS)).alias("bootstrap_status"),
        *_shown(bootstrap, "boot", BOOT_COLUMNS, "bootstrap_"),
        effective_profile(
            F.col("policy.tier_mode"),
            F.col("policy.manual_schedule_profile"),
            F.col("tier.effective_schedule_profile"),
            F.col("policy.schedule_profile"),
        ).alias("effective_schedule_profile"),
        F.col("runtime.current_poll_interval_seconds").alias("poll_interval_seconds"),
        *_shown(policy, "policy", POLICY_COLUMNS),
        *_shown(runtime, "runtime", RUNTIME_COLUMNS),
        *_shown(tiers, "tier", TIER_COLUMNS),
        *_shown(instances, "si", {"source_database": "string", "fdw_schema_name": "string"}),
        "cr.customer_id",
    )


def health_view(reg: DataFrame, policy: DataFrame, runtime: DataFrame, instances: DataFrame, customers: DataFrame, tiers: DataFrame, bootstrap: DataFrame, checkpoints: DataFrame, now: Column) -> DataFrame:
    """Per registration: how overdue it is, and which unsafe states it is in."""
    j = _joined(reg, policy, runtime, instances, customers, tiers, bootstrap)
    updated = F.col("updated_at") if "updated_at" in checkpoints.columns else F.lit(None).cast("timestamp_ntz")
    ckpt = checkpoints.select(
        F.col("customer_id").alias("__tenant"), F.col("table_name").alias("__table"), "last_start_lsn", "last_seqval", updated.alias("checkpoint_updated_at")
    )
    j = j.join(
        ckpt,
        (F.col("cr.customer_id") == F.col("__tenant")) & (F.col("runtime.checkpoint_table_name") == F.col("__table")),
        "left",
    )
    status = F.coalesce("boot.bootstrap_status", F.lit(DEFAULT_STATUS))
    reg_on, policy_on = F.coalesce("reg.enabled", F.lit(False)), F.coalesce("policy.enabled", F.lit(False))
    started, done, failed = (F.col(f"boot.last_{x}_at") for x in ("started", "completed", "failed"))
    stalled = (
        started.isNotNull()
        & done.isNull()
        & failed.isNull()
        & (F.timestamp_diff("SECOND", started, now) > STALLED_AFTER_SECONDS)
    )
    return j.select(
        *FEED,
        "reg.target_schema_name",
        "reg.target_table_name",
        F.col("reg.enabled").alias("registration_enabled"),
        F.col("si.enabled").alias("source_instance_enabled"),
        F.col("policy.enabled").alias("policy_enabled"),
        status.alias("bootstrap_status"),
        *_shown(bootstrap, "boot", {**BOOT_COLUMNS, **CAPTURED_COLUMNS}, "bootstrap_"),
        effective_profile(
            F.col("policy.tier_mode"),
            F.col("policy.manual_schedule_profile"),
            F.col("tier.effective_schedule_profile"),
            F.col("policy.schedule_profile"),
        ).alias("effective_schedule_profile"),
        *_shown(policy, "policy", {**POLICY_COLUMNS, "business_hours_profile_key": "string"}),
        "runtime.current_poll_interval_seconds",
        "runtime.checkpoint_table_name",
        *_shown(runtime, "runtime", RUNTIME_COLUMNS),
        *_shown(tiers, "tier", TIER_COLUMNS),
        F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("runtime.next_pull_at"), now)).cast("bigint").alias("overdue_seconds"),
        "last_start_lsn",
        "last_seqval",
        "checkpoint_updated_at",
        ((status != "completed") & (reg_on | policy_on)).alias("unsafe_enabled_without_bootstrap"),
        ((status == "completed") & F.col("last_start_lsn").isNull()).alias("unsafe_bootstrap_completed_without_checkpoint"),
        (status == "failed").alias("unsafe_failed_bootstrap"),
        ((status == "pending") & reg_on & policy_on).alias("unsafe_pending_bootstrap_enabled"),
        F.coalesce(stalled, F.lit(False)).alias("unsafe_stalled_bootstrap"),
        *_shown(instances, "si", {"source_database": "string", "fdw_schema_name": "string"}),
        "cr.customer_id",
    )


def due_work(reg: DataFrame, policy: DataFrame, runtime: DataFrame, instances: DataFrame, customers: DataFrame, bootstrap: DataFrame, checkpoints: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Feeds to pull now, most urgent first: enabled, bootstrapped, checkpointed, due and not leased."""
    on = F.col("enabled")
    completed = bootstrap.filter(F.col("bootstrap_status") == "completed").select(*FEED)
    tenants = instances.filter(on).join(customers.select("customer_key", "customer_id"), "customer_key")
    positioned = checkpoints.filter(F.col("last_start_lsn").isNotNull()).select(
        "customer_id", F.col("table_name").alias("logical_table_name")
    )
    due_at = F.coalesce(F.col("next_pull_at"), now)
    free = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now)
    return (
        runtime.filter((due_at <= now) & free)
        .select(*FEED, "next_pull_at", "current_poll_interval_seconds")
        .join(reg.filter(on).select(*FEED, "target_schema_name", "target_table_name"), FEED)
        .join(policy.filter(on).select(*FEED, "poll_priority", "max_rows_per_pull", "lease_seconds"), FEED)
        .join(tenants.select("source_instance_key", "customer_id"), "source_instance_key")
        .join(completed, FEED, "left_semi")
        .join(positioned, ["customer_id", "logical_table_name"], "left_semi")
        .withColumns({"poll_priority": F.coalesce("poll_priority", F.lit(DEFAULT_PRIORITY)), "next_pull_at": due_at})
        .orderBy("poll_priority", "next_pull_at", *FEED)
        .limit(limit)
    )


# Outcome of a bootstrap request -> explanation.
BOOTSTRAP_MESSAGES = {
    "skipped_source_disabled": "source instance is disabled",
    "skipped_already_initialized": "table has been bootstrapped before",
    "skipped_in_progress": "bootstrap is running",
    "skipped_active": "registration and policy must be disabled first",
    "skipped_unknown_state": "state does not allow a bootstrap",
    "skipped_not_found": "table is not registered",
    "eligible": "ready to bootstrap",
}


def bootstrap_plan(reg: DataFrame, policy: DataFrame, instances: DataFrame, bootstrap: DataFrame, requested: DataFrame | None = None, instance: str | None = None) -> DataFrame:
    """What a bootstrap request would do with each table, and why.

    ``requested`` has a column ``table_name`` (any case). Without it all pending tables are
    planned; with it also the requested names nobody registered are reported.
    """
    candidates = reg if instance is None else reg.filter(F.col("source_instance_key") == instance)
    registered = candidates
    if requested is not None:
        names = requested.select(F.lower("table_name").alias("__name")).distinct()
        candidates = candidates.join(names, F.lower("logical_table_name") == F.col("__name"), "left_semi")
    j = (
        candidates.select(*FEED, "target_schema_name", "target_table_name", F.col("enabled").alias("__reg_on"))
        .join(instances.select("source_instance_key", F.col("enabled").alias("__si_on")), "source_instance_key")
        .join(policy.select(*FEED, F.col("enabled").alias("__policy_on")), FEED)
        .join(bootstrap.select(*FEED, "bootstrap_status"), FEED, "left")
        .withColumn("bootstrap_status", F.coalesce("bootstrap_status", F.lit(DEFAULT_STATUS)))
    )
    status = F.col("bootstrap_status")
    if requested is None:
        j = j.filter(status == DEFAULT_STATUS)
    result = (
        F.when(~F.col("__si_on"), "skipped_source_disabled")
        .when(status == "completed", "skipped_already_initialized")
        .when(status == "in_progress", "skipped_in_progress")
        .when(F.col("__reg_on") | F.col("__policy_on"), "skipped_active")
        .when(~status.isin("pending", "failed"), "skipped_unknown_state")
        .otherwise("eligible")
    )
    columns = [*FEED, "target_schema_name", "target_table_name", "result_status", "bootstrap_status"]
    plan = j.withColumn("result_status", result).select(*columns)
    if requested is not None:
        absent = (
            requested.select("table_name")
            .distinct()
            .join(registered, F.lower("table_name") == F.lower("logical_table_name"), "left_anti")
        )
        nothing = F.lit(None).cast("string")
        plan = plan.unionByName(
            absent.select(
                F.lit(instance).cast("string").alias("source_instance_key"),
                F.col("table_name").alias("logical_table_name"),
                nothing.alias("target_schema_name"),
                nothing.alias("target_table_name"),
                F.lit("skipped_not_found").alias("result_status"),
                nothing.alias("bootstrap_status"),
            )
        )
    return plan.withColumn("message", lookup(BOOTSTRAP_MESSAGES, "result_status"))


def sync_policies(reg: DataFrame, policy: DataFrame, desired: DataFrame) -> DataFrame:
    """Stored policies after a sync with the desired ones.

    A registration without a stored policy gets its desired one as version 1; a stored one
    that differs in any setting is replaced and its version rises by one; others are kept.
    """
    settings = [c for c in desired.columns if c not in FEED]
    wanted = desired.select(*FEED, *[F.col(c).alias(f"__{c}") for c in settings], F.lit(True).alias("__wanted"))
    stored = policy.select(*FEED, *settings, "config_version", F.lit(True).alias("__stored"))
    j = stored.join(reg.select(*FEED).join(wanted, FEED), FEED, "full_outer")
    wanted_row = F.coalesce("__wanted", F.lit(False))
    is_new = F.col("__stored").isNull()
    same = F.lit(True)
    for c in settings:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    changed = wanted_row & ~is_new & ~same
    return j.select(
        *FEED,
        *[F.when(wanted_row, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in settings],
        F.when(is_new, F.lit(1)).when(changed, F.col("config_version") + 1).otherwise(F.col("config_version")).cast("bigint").alias("config_version"),
        F.when(is_new, "inserted").when(changed, "updated").otherwise("unchanged").alias("sync_action"),
    )


def sync_tiers(policy: DataFrame, tiers: DataFrame) -> DataFrame:
    """Tier assignments after a sync: missing ones start at the policy's tier, manual ones follow it.

    Only a change of a manual tier records what the tier was before.
    """
    fallback = F.coalesce("schedule_profile", F.lit(DEFAULT_PROFILE))
    manual = F.coalesce(F.col("tier_mode") == "manual", F.lit(False))
    target = F.when(manual, F.coalesce("manual_schedule_profile", fallback)).otherwise(fallback)
    stored = tiers.select(
        *FEED,
        F.col("effective_schedule_profile").alias("__now"),
        F.col("previous_schedule_profile").alias("__before"),
        F.col("change_reason").alias("__why"),
        F.lit(True).alias("__stored"),
    )
    j = policy.join(stored, FEED, "left").withColumn("__target", target)
    is_new = F.col("__stored").isNull()
    moved = ~is_new & manual & ~F.col("__now").eqNullSafe(F.col("__target"))
    reason = F.when(manual, "manual policy sync").otherwise("initial baseline tier")
    return j.select(
        *FEED,
        F.when(is_new | moved, F.col("__target")).otherwise(F.col("__now")).alias("effective_schedule_profile"),
        F.when(moved, F.col("__now")).otherwise(F.col("__before")).alias("previous_schedule_profile"),
        F.when(is_new | moved, reason).otherwise(F.col("__why")).alias("change_reason"),
    )


def sync_bootstrap(reg: DataFrame, bootstrap: DataFrame, instances: DataFrame, customers: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Bootstrap states after a sync: missing ones are completed if a checkpoint exists, else pending."""
    fresh = reg.select(*FEED).join(bootstrap.select(*FEED), FEED, "left_anti")
    tenant = instances.join(customers.select("customer_key", "customer_id"), "customer_key").select(
        "source_instance_key", "customer_id"
    )
    ckpt = checkpoints.select(
        "customer_id", F.col("table_name").alias("logical_table_name"), "last_start_lsn", "last_seqval"
    )
    added = (
        fresh.join(tenant, "source_instance_key", "left")
        .join(ckpt, ["customer_id", "logical_table_name"], "left")
        .select(
            *FEED,
            F.when(F.col("last_start_lsn").isNotNull(), "completed").otherwise(DEFAULT_STATUS).alias("bootstrap_status"),
        )
    )
    return bootstrap.select(*FEED, "bootstrap_status").unionByName(added)


def sync_runtime(policy: DataFrame, runtime: DataFrame, now: Column) -> DataFrame:
    """Runtime states after a sync: missing ones start now, a manual tier resets the interval."""
    manual = F.coalesce(F.col("tier_mode") == "manual", F.lit(False))
    profile = F.coalesce("manual_schedule_profile", "schedule_profile", F.lit(DEFAULT_PROFILE))
    forced = _preset("base_poll_interval_seconds", profile)
    stored = runtime.select(
        *FEED, F.col("current_poll_interval_seconds").alias("__interval"), F.col("next_pull_at").alias("__next")
    )
    j = policy.join(stored, FEED, "left")
    interval = F.coalesce("__interval", "base_poll_interval_seconds")
    reset = manual & ~interval.eqNullSafe(forced)
    return j.select(
        *FEED,
        F.when(reset, forced).otherwise(interval).alias("current_poll_interval_seconds"),
        F.when(reset, now + F.make_interval(secs=forced)).otherwise(F.coalesce(F.col("__next"), now)).alias("next_pull_at"),
    )


def sync_registrations(
    reg: DataFrame,
    policy: DataFrame,
    runtime: DataFrame,
    instances: DataFrame,
    customers: DataFrame,
    tiers: DataFrame,
    bootstrap: DataFrame,
    checkpoints: DataFrame,
    now: Column,
) -> dict[str, DataFrame]:
    """Everything a registration needs, after a sync: policy, tier, runtime and bootstrap state.

    The stored policies with their gaps filled are the desired ones; registrations without a
    policy get the defaults.
    """
    filled = fill_tier_defaults(policy)
    settings = [c for c in filled.columns if c not in (*FEED, "config_version")]
    fresh = resolve_policy(reg, policy).join(policy.select(*FEED), FEED, "left_anti")
    desired = filled.select(*FEED, *settings).unionByName(fresh.select(*FEED, *settings))
    live = desired.join(reg.select(*FEED), FEED, "left_semi")
    return {
        "policy": sync_policies(reg, policy, desired),
        "tier": sync_tiers(live, tiers),
        "runtime": sync_runtime(live, runtime, now),
        "bootstrap": sync_bootstrap(reg, bootstrap, instances, customers, checkpoints),
    }


def record_bootstrap(states: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Bootstrap states after some runs: completed, or failed with an error; others unchanged.

    ``results``: the feed, rows_loaded, start_lsn, seqval and error (null for success). A
    success clears the failure before it, a failure keeps what the last success recorded.
    """
    ran = results.select(*FEED, F.struct("rows_loaded", "start_lsn", "seqval", "error").alias("__run"))
    j = states.join(ran, FEED, "full_outer")
    happened, failed = F.col("__run").isNotNull(), F.col("__run.error").isNotNull()
    done = happened & ~failed

    def on_success(column: str, value: Column) -> Column:
        return F.when(done, value).otherwise(F.col(column)).alias(column)

    return j.select(
        *FEED,
        F.when(done, "completed").when(failed, "failed").otherwise(F.col("bootstrap_status")).alias("bootstrap_status"),
        "last_started_at",
        on_success("last_completed_at", now),
        F.when(failed, now).when(done, F.lit(None)).otherwise(F.col("last_failed_at")).alias("last_failed_at"),
        on_success("last_rows_loaded", F.col("__run.rows_loaded")),
        on_success("last_captured_start_lsn", F.col("__run.start_lsn")),
        on_success("last_captured_seqval", F.col("__run.seqval")),
        F.when(happened, F.col("__run.error")).otherwise(F.col("last_error")).alias("last_error"),
    )


def enable_feeds(df: DataFrame, feeds: DataFrame) -> DataFrame:
    """Registrations or policies with the given feeds enabled; a policy's version rises by one."""
    chosen = feeds.select(*FEED).distinct().withColumn("__on", F.lit(True))
    on = F.coalesce("__on", F.lit(False))
    changed = {"enabled": on | F.col("enabled")}
    if "config_version" in df.columns:
        changed["config_version"] = F.when(on, F.col("config_version") + 1).otherwise(F.col("config_version"))
    return df.join(chosen, FEED, "left").select(*[changed.get(c, F.col(c)).alias(c) for c in df.columns])


def feed_status(pulls: DataFrame, policy: DataFrame, retry_seconds: int = DEFAULT_RETRY_SECONDS) -> DataFrame:
    """Where each feed stands after its pulls.

    The streaks are what a running counter would show: empty successes since the last
    non-empty one, failures since the last success. Two aggregates replace the ordered walk
    through a feed's log: the first finds the resets, the second counts what came after, so
    one busy feed is spread over all tasks. Equal times are ordered by ``pull_id``.
    """
    at = F.struct("pulled_at", "pull_id")
    ok = ~F.col("failed")
    nonempty = ok & (F.col("rows_pulled") > 0)
    marks = pulls.groupBy(*FEED).agg(
        F.max(F.when(ok, at)).alias("__ok"),
        F.max(F.when(nonempty, at)).alias("__full"),
        F.max_by("failed", at).alias("__failed"),
        F.max("pulled_at").alias("last_pull_at"),
        F.max(F.when(ok, F.col("pulled_at"))).alias("last_success_at"),
        F.max(F.when(nonempty, F.col("pulled_at"))).alias("last_nonempty_at"),
        F.max_by(F.when(ok, F.col("rows_pulled")), F.when(ok, at)).alias("last_batch_rows"),
    )
    after_ok = F.col("__ok").isNull() | (at > F.col("__ok"))
    after_full = F.col("__full").isNull() | (at > F.col("__full"))
    streaks = (
        pulls.join(marks.select(*FEED, "__ok", "__full"), FEED)
        .groupBy(*FEED)
        .agg(
            F.count_if(ok & (F.col("rows_pulled") == 0) & after_full).alias("empty_pull_streak"),
            F.count_if(F.col("failed") & after_ok).alias("consecutive_failures"),
        )
    )
    interval = F.coalesce("base_poll_interval_seconds", F.lit(DEFAULT_INTERVAL_SECONDS))
    wait = F.when(F.col("__failed"), F.greatest(F.lit(retry_seconds), interval)).otherwise(interval)
    return (
        marks.join(streaks, FEED)
        .join(policy.select(*FEED, "base_poll_interval_seconds"), FEED, "left")
        .select(
            *FEED,
            "last_pull_at",
            "last_success_at",
            "last_nonempty_at",
            "last_batch_rows",
            "empty_pull_streak",
            "consecutive_failures",
            (F.col("last_pull_at") + F.make_interval(secs=wait)).alias("next_pull_at"),
        )
    )


def evaluate_tiers(rollup: DataFrame, tiers: DataFrame, now: Column) -> DataFrame:
    """New tiers from the share of non-empty pulls: promotion over hours, demotion over days.

    Promotion is looked at first. A horizon without pulls changes nothing.
    """
    b = F.col("bucket_start")
    short = (b >= now - F.make_interval(hours=F.lit(PROMOTE_HOURS))) & (b < now)
    long = (b >= now - F.make_interval(days=F.lit(DEMOTE_DAYS))) & (b < now)
    sums = rollup.filter(long).groupBy(*FEED).agg(
        F.sum(F.when(short, F.col("pulls_total"))).alias("pulls_short"),
        F.sum(F.when(short, F.col("nonempty_pulls_total"))).alias("nonempty_short"),
        F.sum("pulls_total").alias("pulls_long"),
        F.sum("nonempty_pulls_total").alias("nonempty_long"),
    )
    j = tiers.select(*FEED, F.col("effective_schedule_profile").alias("tier")).join(sums, FEED, "left")
    # Whole numbers are compared, so a share that equals a limit does not move a feed.
    up = F.lit(None).cast("string")
    for tier, (better, share) in PROMOTE.items():
        hit = (F.col("tier") == tier) & (F.col("pulls_short") > 0)
        hit = hit & (F.col("nonempty_short") * 100 > F.col("pulls_short") * round(share * 100))
        up = F.when(hit, better).otherwise(up)
    down = F.lit(None).cast("string")
    for tier, (worse, share) in DEMOTE.items():
        hit = (F.col("tier") == tier) & (F.col("pulls_long") > 0)
        hit = hit & (F.col("nonempty_long") * 100 < F.col("pulls_long") * round(share * 100))
        down = F.when(hit, worse).otherwise(down)
    for tier, worse in DEMOTE_IDLE.items():
        hit = (F.col("tier") == tier) & (F.col("pulls_long") > 0) & (F.col("nonempty_long") == 0)
        down = F.when(hit, worse).otherwise(down)
    return j.select(
        *FEED,
        F.col("tier").alias("previous_schedule_profile"),
        F.coalesce(up, down, F.col("tier")).alias("effective_schedule_profile"),
        F.when(up.isNotNull(), "promoted").when(down.isNotNull(), "demoted").otherwise("unchanged").alias("change"),
    )
