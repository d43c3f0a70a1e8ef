"""Routing by tenant, table and environment, and the checks made before routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from changefeed.functions.expressions import blank_to_null, join_nulls, lookup, safe_identifier

# --- Fixed values -----------------------------------------------------------
RETRYABLE_ERRORS = ("timeout", "connection")
# Sink environments tried, in order, for a source environment without a match of its own.
ENV_ALIASES = {
    "default": ("dev", "nonprod", "stage", "test"),
    "nonprod": ("dev", "stage", "test"),
    "local": ("dev", "test"),
    "prod": ("prod", "production"),
}
EMPTY_VALUES = ("", "null", "none")
# Tables of a service that meet its tenants at once.
SLICE_TABLES = 1024
# --- End of fixed values ----------------------------------------------------

ROUTE = ["__routing_schema", "__routing_table"]


def split_routes(df: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a known (schema, table) route and its target; and the rows without one.

    The two results come from one flagged join; a caller that writes both should persist
    the flagged rows (see ``fan_out``).
    """
    flagged = flag_routes(df, routes)
    routed = flagged.filter(F.col("__target").isNotNull()).withColumnRenamed("__target", "target")
    return routed, flagged.filter(F.col("__target").isNull()).drop("__target")


def flag_routes(df: DataFrame, routes: DataFrame, counts: Observation | str | None = None) -> DataFrame:
    """Add ``__target``: the target of the row's route, or null.

    A route listed twice counts once, so rows are never multiplied. ``counts`` observes how
    many rows were ``routed`` and ``dropped`` while they pass, without another job; a stream
    reports them by name in its progress.
    """
    known = routes.groupBy("schema_name", "table_name").agg(F.min("target").alias("__target"))
    on = (F.col(ROUTE[0]) == F.col("schema_name")) & (F.col(ROUTE[1]) == F.col("table_name"))
    flagged = df.join(known, on, "left").drop("schema_name", "table_name")
    if counts is None:
        return flagged
    lost = F.col("__target").isNull()
    return flagged.observe(counts, F.count_if(~lost).alias("routed"), F.count_if(lost).alias("dropped"))


def route_by(df: DataFrame, cases: Sequence[tuple[str, str]], default: str | None = None, into: str = "route") -> DataFrame:
    """Add a route by the first condition that holds, else the default (null drops nothing)."""
    chain = None
    for condition, name in cases:
        chain = (F.when if chain is None else chain.when)(F.expr(condition), name)
    if chain is None:
        return df.withColumn(into, F.lit(default))
    return df.withColumn(into, chain.otherwise(F.lit(default)))


def flag_errors(df: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """Add ``error``: the message of the first check that fails; null if all hold.

    ``checks`` maps a message to the Spark SQL condition a good row meets; null counts as failing.
    """
    chain = None
    for message, good in checks.items():
        bad = ~F.coalesce(F.expr(good), F.lit(False))
        chain = (F.when if chain is None else chain.when)(bad, message)
    return df.withColumn("error", chain if chain is not None else F.lit(None).cast("string"))


def split_dead_letters(df: DataFrame, checks: Mapping[str, str], failed_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good rows; rows worth a retry; and dead letters. Failed rows keep their original columns."""
    flagged = flag_errors(df, checks)
    failed = flagged.filter(F.col("error").isNotNull()).withColumn("failed_at", failed_at)
    transient = F.col("error").rlike("|".join(RETRYABLE_ERRORS))
    return flagged.filter(F.col("error").isNull()).drop("error"), failed.filter(transient), failed.filter(~transient)


def fan_out(df: DataFrame, outputs: Mapping[str, tuple[Sequence[str], Sequence[str]]], root: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Write several shapes of one batch: name -> (columns, partition columns); no columns means all.

    The batch is persisted (spilling to disk) so its lineage runs once, and released afterwards.
    """
    df.persist()
    try:
        for name, (columns, partitions) in outputs.items():
            shape = df.select(*columns) if columns else df
            shape.write.format(fmt).mode(mode).partitionBy(*partitions).save(f"{root}/{name}")
    finally:
        df.unpersist()


def write_routes(df: DataFrame, root: str, route: str = "route", fmt: str = "parquet", mode: str = "append") -> None:
    """Write each route to its own folder. Routes differ in size, so files are rebalanced by it."""
    df.hint("rebalance", route).write.format(fmt).mode(mode).partitionBy(route).save(root)


def enrich(df: DataFrame, lookup_table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add the columns of a lookup table; rows without a match keep nulls.

    Works on a stream too. Several lookup rows for one key would multiply rows, so the
    first by value is taken.
    """
    rest = [c for c in lookup_table.columns if c not in on]
    one = lookup_table.groupBy(*on).agg(F.min(F.struct(*rest)).alias("__found"))
    return df.join(one, list(on), "left").select(*df.columns, *[F.col(f"__found.{c}").alias(c) for c in rest])


def lookup_source_key(df: DataFrame, keys: DataFrame, key: str, into: str = "value") -> DataFrame:
    """Add a source's value of ``key``: at source level, else at the row's environment level.

    ``keys`` is long: source_name, env (null at source level), key, value. Rows for which
    neither exists get an ``error``.
    """
    named = keys.filter(F.col("key") == key)
    at_source = named.filter(F.col("env").isNull()).groupBy("source_name").agg(
        F.min("value").alias("__s"), F.count("*").alias("__sn")
    )
    at_env = named.filter(F.col("env").isNotNull()).groupBy("source_name", "env").agg(
        F.min("value").alias("__e"), F.count("*").alias("__en")
    )
    j = df.join(at_source, "source_name", "left").join(at_env, ["source_name", "env"], "left")
    found = F.when(F.col("__sn").isNotNull(), F.col("__s")).otherwise(F.col("__e"))
    absent = F.col("__sn").isNull() & F.col("__en").isNull()
    message = F.concat(F.lit(f"key {key} not found for "), F.col("source_name"), F.lit("."), F.coalesce("env", F.lit("")))
    return j.select(*df.columns, found.alias(into), F.when(absent, message).alias("error"))


def resolve_env(df: DataFrame, targets: DataFrame, aliases: Mapping[str, Sequence[str]] = ENV_ALIASES) -> DataFrame:
    """Add the sink environment of each route, or an ``error``.

    ``df`` has sink, env and target_sink_env; ``targets`` the sink's environments (sink,
    target_env). An explicit target must exist. Without one: the environment of the same
    name, then its aliases in order. All candidates of a row are exploded with their rank
    and joined once; the best rank that exists wins.
    """
    explicit = blank_to_null("target_sink_env")
    given = F.col("target_sink_env").isNotNull()
    named = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in aliases.items() for x in kv])
    fallbacks = F.coalesce(F.try_element_at(named, F.col("env")), F.array().cast("array<string>"))
    candidates = F.when(given, F.array(explicit)).otherwise(F.concat(F.array(F.col("env")), fallbacks))
    known = targets.select("sink", F.col("target_env").alias("__candidate")).distinct()
    routes = df.select("sink", "env", "target_sink_env").distinct()
    best = (
        routes.select("*", F.posexplode(candidates).alias("__rank", "__candidate"))
        .join(known, ["sink", "__candidate"])
        .groupBy("sink", "env", "target_sink_env")
        .agg(F.min_by("__candidate", "__rank").alias("resolved_env"))
    )
    r = best.select(
        F.struct("sink", "env", "target_sink_env").alias("__route"), "resolved_env"
    )
    message = F.when(given, F.concat(F.lit("invalid target environment "), F.col("target_sink_env"))).otherwise(
        F.concat(F.lit("no sink environment for "), F.col("env"))
    )
    return (
        df.withColumn("__route", F.struct("sink", "env", "target_sink_env"))
        .join(r, "__route", "left")
        .drop("__route")
        .withColumn("error", F.when(F.col("resolved_env").isNull(), message))
    )


def routing_issues(routes: DataFrame, sinks: DataFrame, targets: DataFrame) -> DataFrame:
    """Routes whose target environment is missing or unknown.

    Only sinks that tell environments apart, fed by a source group that does not, need one.
    ``sinks``: sink, sink_env_aware, source_env_aware.
    """
    affected = sinks.filter(F.col("sink_env_aware") & ~F.col("source_env_aware")).select("sink")
    known = targets.select("sink", F.col("target_env").alias("__target"), F.lit(True).alias("__known")).distinct()
    j = (
        routes.withColumn("__target", blank_to_null("target_sink_env"))
        .join(affected, "sink", "left_semi")
        .join(known, ["sink", "__target"], "left")
    )
    issue = F.when(F.col("__target").isNull(), "missing").when(F.col("__known").isNull(), "invalid")
    return j.withColumn("issue", issue).filter(F.col("issue").isNotNull()).select(
        "sink", "source_name", "env", "target_sink_env", "issue"
    )


def _scoped(routes: DataFrame, value: str) -> DataFrame:
    """Routes that have a scope: the source group, or a valid sink environment where sinks tell them apart."""
    env = blank_to_null("target_sink_env")
    scope = F.when(~F.col("sink_env_aware"), F.concat(F.lit("source_group:"), F.col("source_group"))).when(
        env.isNotNull() & F.col("target_known"), F.concat(F.lit("sink_env:"), env)
    )
    return (
        routes.withColumn("scope", scope)
        .filter(F.col("scope").isNotNull())
        .withColumn("value", F.trim(F.col(value)))
        .withColumn("route", F.concat_ws(".", "source_name", "env"))
    )


def unique_collisions(routes: DataFrame, value: str = "value") -> DataFrame:
    """Routes that share a value which must be unique, one row per colliding route.

    ``routes``: sink, source_group, sink_env_aware, target_sink_env, target_known,
    source_name, env, template and the value. A collision is two or more routes with one
    value in one scope. The routes of a value are counted before they are listed, so a value
    shared by very many routes is never gathered in one row.
    """
    at = ["sink", "scope", "template", "value"]
    usable = _scoped(routes, value).filter(F.col("value").isNotNull() & ~F.lower("value").isin(*EMPTY_VALUES))
    usable = usable.select(*at, "route").distinct()
    counts = usable.groupBy(*at).agg(F.count("*").alias("route_count")).filter(F.col("route_count") >= 2)
    return join_nulls(usable, counts, at)  # a route may have no template


def unique_missing(routes: DataFrame, value: str = "value") -> DataFrame:
    """Routes whose must-be-unique value is empty."""
    scoped = _scoped(routes, value)
    return scoped.filter(F.lower("value").isin(*EMPTY_VALUES)).select("sink", "scope", "template", "route")


def _of_tables(tenants: DataFrame, tables: DataFrame) -> DataFrame:
    """Every tenant with every table of its service: as many rows as both have together, so it is the rows made that are dealt out.

    The tables of a service are cut into slices of about ``SLICE_TABLES``, and a tenant goes to each slice: one row is
    moved for so many rows made. No service is the work of one task, however small the tables read, and rows of a tenant
    repeat the names of one slice at a time, which files encode in few bytes.
    """
    n = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = tables.groupBy("service").agg(F.ceil(F.count("*") / SLICE_TABLES).cast("int").alias("__slices"))
    place = F.pmod(F.xxhash64("schema_name", "table_name"), F.col("__slices")).cast("int").alias("__slice")
    sliced = tables.join(slices, "service").select(*tables.columns, place)
    every = F.explode(F.sequence(F.lit(0), F.col("__slices") - 1)).alias("__slice")
    spread = tenants.join(slices, "service").select(*tenants.columns, every)
    # A number of partitions that is asked for is kept: by their bytes they would be merged into one.
    at = ["service", "__slice"]
    return spread.repartition(n, *at).join(sliced.repartition(n, *at), at).drop("__slice")


def build_routes(tenants: DataFrame, tables: DataFrame, keys: DataFrame, key: str = "customer_id") -> tuple[DataFrame, DataFrame]:
    """Every table of a service for every tenant of that service; and the routes left out.

    ``tenants``: service, source_name, env, topic_prefix. ``tables``: service, schema_name,
    table_name. A tenant whose required key is missing or empty is reported, not routed.
    The key is resolved per tenant, before tables multiply the rows.
    """
    resolved = lookup_source_key(tenants, keys, key, "__key")
    empty = F.col("error").isNull() & F.coalesce(F.lower(F.trim("__key")).isin(*EMPTY_VALUES), F.lit(True))
    reason = F.coalesce(F.col("error"), F.when(empty, F.concat(F.lit(f"key {key} is empty for "), F.col("source_name"))))
    told = resolved.withColumn("reason", reason).drop("error")
    schema = F.lower("source_name")
    routes = _of_tables(told.filter(F.col("reason").isNull()), tables).select(
        F.concat_ws(".", "topic_prefix", "schema_name", "table_name").alias("topic"),
        schema.alias("schema_name"),
        F.col("table_name"),
        F.concat(schema, F.lit(".stg_"), F.col("table_name")).alias("target"),
        F.col("__key").alias(key),
    )
    skipped = _of_tables(told.filter(F.col("reason").isNotNull()), tables).select("source_name", "env", "schema_name", "table_name", "reason")
    return routes, skipped


def tenants(topology: DataFrame) -> DataFrame:
    """Tenants of a topology with their id: the first environment that has one, else the source's own.

    ``topology`` is long: source_name, env (null at source level), ord, key, value.
    """
    is_id = F.col("key") == "customer_id"
    in_env = is_id & F.col("env").isNotNull() & F.col("value").isNotNull()
    at_top = is_id & F.col("env").isNull()
    return (
        topology.groupBy(F.trim("source_name").alias("source_name"))
        .agg(
            F.min_by(F.when(in_env, F.col("value")), F.when(in_env, F.col("ord"))).alias("__env_id"),
            F.min(F.when(at_top, F.col("value"))).alias("__top_id"),
        )
        .filter(F.col("source_name") != "")
        .select(
            F.lower("source_name").alias("name"),
            F.lower("source_name").alias("schema"),
            F.coalesce("__env_id", "__top_id").alias("customer_id"),
        )
        .orderBy("name")
    )


def source_plan(topology: DataFrame, servers: DataFrame, env: str, prefix: str = "feed") -> DataFrame:
    """One row per tenant with what is needed to connect, or the reason it is skipped.

    ``topology`` as in ``tenants``, with keys customer_id, database and server per environment.
    """
    here = F.col("env") == env

    def pick(key: str, where: Column) -> Column:
        return F.max(F.when(where & (F.col("key") == key), blank_to_null("value")))

    per_source = topology.groupBy(F.trim("source_name").alias("customer_name")).agg(
        F.coalesce(F.bool_or(here), F.lit(False)).alias("__configured"),
        F.coalesce(pick("customer_id", here), pick("customer_id", F.col("env").isNull())).alias("customer_id"),
        pick("database", here).alias("source_database"),
        F.coalesce(pick("server", here), F.lit("default")).alias("server_name"),
    )
    known = servers.groupBy("server_name").agg(F.min("host").alias("host"))
    safe_env = safe_identifier(F.lit(env))
    key = F.lower("customer_name")
    reason = (
        F.when(~F.col("__configured"), "environment is not configured")
        .when(F.col("customer_id").isNull(), "customer_id is missing")
        .when(F.col("source_database").isNull(), "database is missing")
        .when(F.col("host").isNull(), "server is not defined")
    )
    return per_source.join(known, "server_name", "left").select(
        key.alias("customer_key"),
        "customer_name",
        "customer_id",
        F.lit(env).alias("source_env"),
        "server_name",
        "source_database",
        "host",
        F.concat_ws("_", F.lit(prefix), safe_env, safe_identifier(key)).alias("instance_key"),
        reason.alias("skip_reason"),
    )


def match_sinks(sources: DataFrame, sinks: DataFrame, collect_all: bool = False) -> DataFrame:
    """Sink tables fed by each source table.

    ``sources``: table_name. ``sinks``: sink_table, from_table, ord. A sink table of the same
    name is preferred, else the last one listed; ``collect_all`` keeps every match.
    """
    bare = lambda c: F.lower(F.regexp_replace(F.trim(F.col(c)), r"^[^.]*\.", ""))
    usable = sinks.filter(F.coalesce(F.trim("from_table"), F.lit("")) != "").withColumn("__from", bare("from_table"))
    if collect_all:
        matched = sources.join(usable, F.lower("table_name") == F.col("__from"))
        return matched.select("table_name", "sink_table")
    same = bare("sink_table") == F.col("__from")
    # Reduced per source name before the join: exact matches rank first (the earliest one), then the last listed.
    rank = F.struct(same.alias("same"), F.when(same, -F.col("ord")).otherwise(F.col("ord")).alias("ord"))
    best = usable.groupBy("__from").agg(F.max_by("sink_table", rank).alias("sink_table"))
    return sources.join(best, F.lower("table_name") == F.col("__from")).select("table_name", "sink_table")


def dangling_references(sinks: DataFrame, sources: DataFrame, groups: DataFrame, servers: DataFrame, source_servers: DataFrame) -> DataFrame:
    """References that lead nowhere, with a reason.

    Sink tables (owner, table_name) absent from the source list (table_name); sink groups
    (owner, source_group) naming an unknown source group; sink servers (owner, source_group,
    server_name) naming a server its source group lacks. ``source_servers``: source_group,
    server_name.
    """
    known_groups = source_servers.select("source_group").distinct()
    lost_tables = sinks.join(sources.select("table_name").distinct(), "table_name", "left_anti").select(
        "owner", F.col("table_name").alias("reference"), F.lit("unknown source table").alias("reason")
    )
    lost_groups = groups.join(known_groups, "source_group", "left_anti").select(
        "owner", F.col("source_group").alias("reference"), F.lit("unknown source group").alias("reason")
    )
    lost_servers = (
        servers.join(known_groups, "source_group", "left_semi")
        .join(source_servers.distinct(), ["source_group", "server_name"], "left_anti")
        .select("owner", F.col("server_name").alias("reference"), F.lit("unknown server").alias("reason"))
    )
    return lost_tables.unionByName(lost_groups).unionByName(lost_servers)
