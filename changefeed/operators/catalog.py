"""Catalogs as data: inventories, topologies, schema comparison, coverage, keys.

Catalog rows are long: schema_name, table_name, ordinal, column_name, type_name, nullable,
primary_key, default_value. Results stay long as well, one row per finding, so no group is
gathered into one row however large it grows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefeed.functions.expressions import blank_to_null, join_nulls
from changefeed.functions.types import (
    MSSQL_PG,
    MSSQL_TO_PG,
    CompatibilityMap,
    compatible,
    map_type,
    map_type_name,
    mapping_accepts,
    normalize_for_compare,
    spark_type,
)
from changefeed.spec import BROKERED_METADATA, NATIVE_METADATA, TENANT_COLUMN, TableSpec

TABLE = ["schema_name", "table_name"]

# --- Fixed values -----------------------------------------------------------
BASELINE_ENVIRONMENT = "dev"
DEFAULT_TARGET_SCHEMA = "public"
# --- End of fixed values ----------------------------------------------------


# --- Inventories and topologies ----------------------------------------------


def merge_inventory(existing: DataFrame, scanned: DataFrame, servers: Sequence[str]) -> DataFrame:
    """An inventory after some servers were scanned again.

    Scanned rows replace what those servers had and take over the routing metadata stored for
    their database; rows of other servers stay unless the same source and environment was
    scanned elsewhere.
    """
    known = existing.filter(F.col("target_sink_env").isNotNull()).groupBy("db_name").agg(
        F.min("target_sink_env").alias("__kept")
    )
    fresh = (
        scanned.join(known, "db_name", "left")
        .withColumn("target_sink_env", F.coalesce("target_sink_env", "__kept"))
        .select(*existing.columns)
    )
    preserved = existing.filter(~F.col("server").isin(*servers)).join(
        scanned.select("service", "environment").distinct(), ["service", "environment"], "left_anti"
    )
    return fresh.unionByName(preserved.select(*existing.columns))


def merge_schemas(existing: DataFrame, scanned: DataFrame) -> DataFrame:
    """Schemas per service known before or found by a scan: (service, schema_name)."""
    both = existing.select("service", "schema_name").unionByName(scanned.select("service", "schema_name"))
    return both.filter(F.coalesce(F.trim("schema_name"), F.lit("")) != "").distinct()


def inventory_stats(databases: DataFrame) -> DataFrame:
    """Databases, tables and whole average tables: for all, and per non-blank environment."""
    per_env = databases.groupBy(blank_to_null("environment").alias("environment")).agg(
        F.count("*").alias("databases"), F.sum("table_count").alias("tables")
    )
    total = per_env.agg(F.sum("databases").alias("databases"), F.sum("tables").alias("tables"))
    rows = total.select(F.lit("all").alias("scope"), "databases", "tables").unionByName(
        per_env.filter(F.col("environment").isNotNull()).select(
            F.concat(F.lit("env:"), F.col("environment")).alias("scope"), "databases", "tables"
        )
    )
    average = F.floor(F.try_divide("tables", "databases"))
    return rows.withColumn("avg_tables", F.coalesce(average, F.lit(0)).cast("bigint"))


def service_environments(databases: DataFrame) -> DataFrame:
    """The environments of each service; blank environments are left out."""
    env = F.trim("environment")
    return (
        databases.filter(F.coalesce(env, F.lit("")) != "")
        .select(F.coalesce("service", F.lit("unknown")).alias("service"), env.alias("environment"))
        .distinct()
    )


def build_topology(databases: DataFrame, schemas: DataFrame, mode: str) -> DataFrame:
    """Source topology as (source_name, env, key, value).

    ``databases``: ord, db_name, service, customer, environment, server, table_count;
    ``schemas``: db_name, schema_name. Every source has one ``schema`` row per schema of its
    databases. ``shared`` groups by service and lists all databases of an environment with
    their summed table count and the first one's server; ``per_tenant`` groups by customer
    and the last database of an environment wins.
    """
    if mode == "shared":
        named = databases.select("*", F.coalesce("service", "db_name").alias("source_name"), blank_to_null("environment").alias("env"))
    elif mode == "per_tenant":
        env = F.coalesce(blank_to_null("environment"), F.lit("default"))
        named = databases.select("*", F.coalesce("customer", "db_name").alias("source_name"), env.alias("env"))
    else:
        raise ValueError(f"mode must be 'shared' or 'per_tenant', not {mode!r}")
    nothing = F.lit(None).cast("string")
    at_source = (
        named.join(schemas, "db_name")
        .select("source_name", nothing.alias("env"), F.lit("schema").alias("key"), F.col("schema_name").alias("value"))
        .distinct()
    )
    placed = named.filter(F.col("env").isNotNull())
    group = placed.groupBy("source_name", "env")
    if mode == "shared":
        facts = group.agg(F.min_by("server", "ord").alias("server"), F.sum("table_count").alias("table_count"))
        members = placed.select("source_name", "env", F.lit("database").alias("key"), F.col("db_name").alias("value"))
        rows = at_source.unionByName(members)
    else:
        facts = group.agg(
            F.max_by("server", "ord").alias("server"),
            F.max_by("table_count", "ord").alias("table_count"),
            F.max_by("db_name", "ord").alias("database"),
        )
        rows = at_source
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in facts.columns[2:]]
    spread = facts.select("source_name", "env", F.inline(F.array(*pairs)))
    return rows.unionByName(spread)


def environment_parity(databases: DataFrame, schemas: DataFrame, baseline: str = BASELINE_ENVIRONMENT) -> DataFrame:
    """How the environments of a service differ from its baseline environment.

    ``databases``: service, environment, table_count (one row each); ``schemas``: service,
    environment, schema_name. Services whose baseline has no schemas are not compared.
    """
    is_base = F.col("environment") == baseline
    base_schemas = schemas.filter(is_base).select("service", "schema_name").distinct()
    others = schemas.filter(~is_base).select("service", "environment", "schema_name").distinct()
    compared = base_schemas.select("service").distinct()
    envs = databases.filter(~is_base).join(compared, "service", "left_semi")
    missing = (
        envs.select("service", "environment")
        .join(base_schemas, "service")
        .join(others, ["service", "environment", "schema_name"], "left_anti")
    )
    extra = others.join(compared, "service", "left_semi").join(base_schemas, ["service", "schema_name"], "left_anti")
    base_tables = databases.filter(is_base).select("service", F.col("table_count").alias("__base"))
    counts = envs.join(base_tables, "service").filter(
        (F.col("__base") > 0) & ~F.col("table_count").eqNullSafe(F.col("__base"))
    )

    def finding(df: DataFrame, kind: str, detail: Column) -> DataFrame:
        return df.select("service", "environment", F.lit(kind).alias("warning"), detail.alias("detail"))

    return (
        finding(missing, "missing schema", F.col("schema_name"))
        .unionByName(finding(extra, "extra schema", F.col("schema_name")))
        .unionByName(finding(counts, "table count differs", F.col("__base").cast("string")))
    )


def target_schemas(tables: DataFrame) -> DataFrame:
    """Target schemas except the default one, sorted."""
    s = F.col("target_schema_name")
    return tables.filter(s != DEFAULT_TARGET_SCHEMA).select(s).distinct().orderBy("target_schema_name")


def all_sink_envs(topologies: Sequence[DataFrame]) -> DataFrame:
    """Environment keys over all sinks."""
    return (
        reduce(lambda a, b: a.unionByName(b), [t.select("env") for t in topologies])
        .filter(F.col("env").isNotNull() & (F.col("env") != "schemas"))
        .distinct()
    )


def missing_keys(topology: DataFrame, key: str) -> DataFrame:
    """Sources that lack a key, with the number of environments that lack it.

    A key at source level covers all environments. If every source lacks it, one row with a
    null source says so and carries the total.
    """
    is_key = F.col("key") == key
    per_env = topology.groupBy("source_name", "env").agg(F.bool_or(is_key).alias("has"))
    in_env = F.col("env").isNotNull()
    per_source = per_env.groupBy("source_name").agg(
        F.bool_or(~in_env & F.col("has")).alias("__at_source"),
        F.count_if(in_env).alias("__envs"),
        F.count_if(in_env & ~F.col("has")).alias("__lacking"),
    )
    lacking = F.when(F.col("__at_source"), 0).when(F.col("__envs") == 0, 1).otherwise(F.col("__lacking"))
    found = per_source.select("source_name", lacking.cast("bigint").alias("missing_in"))
    failing = found.filter(F.col("missing_in") > 0)
    total, bad = found.agg(F.count("*")).scalar(), failing.agg(F.count("*")).scalar()
    everyone = failing.agg(F.sum("missing_in").alias("missing_in")).filter((bad == total) & (total > 0))
    return failing.filter(bad < total).unionByName(
        everyone.select(F.lit(None).cast("string").alias("source_name"), "missing_in")
    )


def custom_keys(databases: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per database the first value its key query returned, and the databases without one.

    ``rows``: db_name, ord, value. A blank first value counts as none, whatever follows it.
    """
    first = rows.groupBy("db_name").agg(F.min_by(F.struct("value"), "ord").alias("__first"))
    values = databases.select("db_name").join(first, "db_name", "left").select(
        "db_name", blank_to_null("__first.value").alias("value")
    )
    return values, values.filter(F.col("value").isNull()).select("db_name", F.lit("missing value").alias("warning"))


# --- Columns and keys ---------------------------------------------------------


def case_variants(catalog: DataFrame) -> DataFrame:
    """Column names that occur in several spellings: one row per spelling."""
    names = catalog.select(F.lower("column_name").alias("folded_name"), "column_name").distinct()
    several = names.groupBy("folded_name").agg(F.count("*").alias("variants")).filter(F.col("variants") > 1)
    return names.join(several, "folded_name")


def table_column_counts(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Number of columns per table; a table without columns counts 0."""
    counts = columns.groupBy(*TABLE).agg(F.count("*").alias("column_count"))
    return tables.join(counts, TABLE, "left").select(*TABLE, F.coalesce("column_count", F.lit(0)).alias("column_count"))


def resolve_keys(catalog: DataFrame, table_keys: DataFrame | None = None, tenant: bool = False) -> tuple[DataFrame, DataFrame]:
    """Key columns of each table in order; and the tables that have none.

    A table-level key (``table_keys``: schema_name, table_name, ordinal, column_name) beats
    flagged columns. With ``tenant`` the tenant id leads. Names repeat only once, without
    regard to case. One row per key column: schema_name, table_name, key_position, column_name.
    """
    flagged = catalog.filter(F.col("primary_key")).select(*TABLE, "ordinal", "column_name")
    if table_keys is not None:
        declared = table_keys.select(*TABLE, "ordinal", "column_name")
        flagged = flagged.join(declared.select(*TABLE).distinct(), TABLE, "left_anti").unionByName(declared)
    without = catalog.select(*TABLE).distinct().join(flagged.select(*TABLE).distinct(), TABLE, "left_anti")
    if tenant:
        lead = flagged.select(*TABLE).distinct().select(*TABLE, F.lit(-1).alias("ordinal"), F.lit(TENANT_COLUMN).alias("column_name"))
        flagged = flagged.unionByName(lead)
    once = flagged.groupBy(*TABLE, F.lower("column_name").alias("__folded")).agg(
        F.min(F.struct("ordinal", "column_name")).alias("__first")
    )
    # A key has at most a few dozen columns in any database, so its list is small.
    keys = once.groupBy(*TABLE).agg(F.array_sort(F.collect_list("__first")).alias("__keys"))
    listed = keys.select(*TABLE, F.posexplode("__keys").alias("key_position", "__key"))
    return listed.select(*TABLE, "key_position", F.col("__key.column_name").alias("column_name")), without


def missing_tenant_column(tables: DataFrame, columns: DataFrame, tenant: str = TENANT_COLUMN) -> DataFrame:
    """Target tables we create that have no tenant column."""
    has = columns.filter(F.lower("column_name") == tenant).select(*TABLE).distinct()
    return tables.filter(~F.coalesce("target_exists", F.lit(False))).join(has, TABLE, "left_anti").select(*TABLE)


def target_schema(
    columns: Sequence[tuple[str, str, bool]],
    spec: TableSpec,
    mode: str = "native",
    mapping: Mapping[str, str] = MSSQL_TO_PG,
) -> T.StructType:
    """The Spark schema of a target table.

    Source columns (name, type, nullable) that are not ignored, then templates, rule outputs,
    the tenant id (native only) and metadata; each name once, without regard to case.
    """
    ignored = {c.casefold() for c in spec.ignore}
    wanted = [
        (spec.renames.get(n, n), spark_type(spec.types.get(n, t), mapping), null)
        for n, t, null in columns
        if n.casefold() not in ignored
    ]
    wanted += [(t.name, t.type, t.nullable) for t in spec.templates]
    wanted += [(r.output, r.output_type, True) for r in spec.rules if r.output]
    if mode == "native":
        wanted.append((TENANT_COLUMN, "string", False))
    metadata = NATIVE_METADATA if mode == "native" else BROKERED_METADATA
    wanted += [(n, t, n != "__sync_timestamp") for n, t in metadata.items()]
    fields: dict[str, T.StructField] = {}
    for name, type_name, nullable in wanted:
        fields.setdefault(name.casefold(), T.StructField(name, T.DataType.fromDDL(type_name), nullable))
    return T.StructType(list(fields.values()))


def target_columns(catalog: DataFrame, ignored: Sequence[str] = (), extra: Sequence[tuple[str, str, bool]] = (), mapping: Mapping[str, str] = MSSQL_TO_PG) -> DataFrame:
    """``target_schema`` for a whole catalog: one row per target column.

    ``extra`` columns (name, type, nullable) are added to every table after its own. They are
    exploded from a literal per table; the earliest column of a name wins.
    """
    own = catalog.select(*TABLE, F.lit(0).alias("part"), "ordinal", "column_name", map_type("type_name", mapping).alias("target_type"), "nullable")
    dropped = [c.lower() for c in ignored]
    if dropped:
        own = own.filter(~F.lower("column_name").isin(*dropped))
    if extra:
        items = F.array(
            *[
                F.struct(
                    F.lit(1).alias("part"), F.lit(i).alias("ordinal"), F.lit(n).alias("column_name"), F.lit(t).alias("target_type"), F.lit(null).alias("nullable")
                )
                for i, (n, t, null) in enumerate(extra)
            ]
        )
        own = own.unionByName(catalog.select(*TABLE).distinct().select(*TABLE, F.inline(items)))
    first = F.min(F.struct("part", "ordinal", "column_name", "target_type", "nullable")).alias("__first")
    return own.groupBy(*TABLE, F.lower("column_name").alias("__folded")).agg(first).select(*TABLE, "__first.*")


def evolve(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Add the columns a frame lacks, with a default or null; existing columns are not touched."""
    present = {c.casefold() for c in df.columns}
    added = {
        f.name: F.lit((defaults or {}).get(f.name)).cast(f.dataType)
        for f in schema.fields
        if f.name.casefold() not in present
    }
    return df.withColumns(added) if added else df


def replication_summary(catalog: DataFrame, mapping: Mapping[str, str] = MSSQL_TO_PG) -> DataFrame:
    """Per table the number of columns and of columns whose type name changes."""
    changed = F.col("type_name") != map_type("type_name", mapping)
    return catalog.groupBy(*TABLE).agg(
        F.count("*").alias("column_count"),
        F.count_if("primary_key").alias("key_columns"),
        F.count_if(changed).alias("type_changes"),
    )


def type_changes(catalog: DataFrame, mapping: Mapping[str, str] = MSSQL_TO_PG) -> DataFrame:
    """The columns whose type name changes."""
    return catalog.withColumn("sink_type", map_type("type_name", mapping)).filter(F.col("type_name") != F.col("sink_type")).select(
        *TABLE, "column_name", F.col("type_name").alias("source_type"), "sink_type"
    )


# --- Comparing catalogs ---------------------------------------------------------


def _sides(expected: DataFrame, existing: DataFrame, fold: bool) -> DataFrame:
    """One row per column name of either catalog, with both definitions and both tables' presence.

    One aggregate over the union replaces a full outer join; the presence of tables is a
    second, much smaller aggregate joined back.
    """
    name = F.lower("column_name") if fold else F.col("column_name")
    facts = F.struct("column_name", "type_name", "nullable", "primary_key")
    tagged = expected.select(*TABLE, name.alias("__name"), facts.alias("new"), F.lit(None).cast(expected.select(facts.alias("x")).schema["x"].dataType).alias("old"))
    other = existing.select(*TABLE, name.alias("__name"), F.lit(None).cast(existing.select(facts.alias("x")).schema["x"].dataType).alias("new"), facts.alias("old"))
    columns = tagged.unionByName(other).groupBy(*TABLE, "__name").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    tables = columns.groupBy(*TABLE).agg(
        F.bool_or(F.col("new").isNotNull()).alias("__in_new"), F.bool_or(F.col("old").isNotNull()).alias("__in_old")
    )
    return join_nulls(columns, tables, TABLE)


def schema_diff(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Tables and columns added or removed, and changed types, each with a severity."""
    s = _sides(expected, existing, fold=False)
    new, old = F.col("new"), F.col("old")
    both = F.col("__in_new") & F.col("__in_old")
    new_type, old_type = F.upper("new.type_name"), F.upper("old.type_name")
    kind = (
        F.when(F.col("__in_new") & ~F.col("__in_old"), "table_added")
        .when(F.col("__in_old") & ~F.col("__in_new"), "table_removed")
        .when(both & old.isNull(), "column_added")
        .when(both & new.isNull(), "column_removed")
        .when(both & (new_type != old_type), "column_type_changed")
    )
    severity = (
        F.when(F.col("kind").isin("table_added", "column_added"), "info")
        .when(F.col("kind").isin("table_removed", "column_removed"), "warning")
        .otherwise("breaking")
    )
    whole = F.col("kind").startswith("table_")
    changed = F.col("kind") == "column_type_changed"
    nothing = F.lit(None).cast("string")
    return (
        s.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select(
            *TABLE,
            "kind",
            F.when(whole, nothing).otherwise(F.col("__name")).alias("column_name"),
            F.when(whole, nothing).when(changed, old_type).otherwise(F.col("old.type_name")).alias("old_value"),
            F.when(whole, nothing).when(changed, new_type).otherwise(F.col("new.type_name")).alias("new_value"),
            severity.alias("severity"),
        )
        .distinct()
    )


def destructive_changes(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Changes to existing tables that an additive update cannot make.

    Removed columns, changed types, nullability and key sets, and a possible rename where
    exactly one column went and one came. Names compare without case, types by one spelling.
    """
    s = _sides(expected, existing, fold=True).filter(F.col("__in_new") & F.col("__in_old"))
    old_type, new_type = F.col("old.type_name"), F.col("new.type_name")
    removed, added = F.col("new").isNull(), F.col("old").isNull()
    both = ~removed & ~added

    def finding(kind: str, when: Column, old: Column, new: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), old.alias("old_value"), new.alias("new_value")))

    nothing = F.lit(None).cast("string")
    findings = F.array_compact(
        F.array(
            finding("COLUMN_REMOVED", removed, nothing, nothing),
            finding(
                "COLUMN_TYPE_CHANGED",
                both & (normalize_for_compare("old.type_name") != normalize_for_compare("new.type_name")),
                old_type,
                new_type,
            ),
            finding(
                "COLUMN_NULLABILITY_CHANGED",
                both & (F.col("old.nullable") != F.col("new.nullable")),
                F.col("old.nullable").cast("string"),
                F.col("new.nullable").cast("string"),
            ),
        )
    )
    per_column = s.select(*TABLE, F.col("old.column_name").alias("column_name"), F.inline(findings))

    in_old, in_new = F.coalesce("old.primary_key", F.lit(False)), F.coalesce("new.primary_key", F.lit(False))

    def key_list(flag: Column) -> Column:
        # Keys have few columns; only they are collected.
        names = F.array_sort(F.collect_set(F.when(flag, F.col("__name"))))
        return F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("<none>"))

    per_table = s.groupBy(*TABLE).agg(
        F.bool_or(in_old != in_new).alias("__keys_differ"),
        key_list(in_old).alias("__old_key"),
        key_list(in_new).alias("__new_key"),
        F.count_if(removed).alias("__removed"),
        F.count_if(added).alias("__added"),
        F.min(F.when(removed, F.col("old.column_name"))).alias("__gone"),
        F.min(F.when(added, F.col("new.column_name"))).alias("__came"),
    )
    table_findings = F.array_compact(
        F.array(
            finding("PRIMARY_KEY_CHANGED", F.col("__keys_differ"), F.col("__old_key"), F.col("__new_key")),
            finding("POSSIBLE_RENAME_HINT", (F.col("__removed") == 1) & (F.col("__added") == 1), F.col("__gone"), F.col("__came")),
        )
    )
    return per_column.unionByName(per_table.select(*TABLE, nothing.alias("column_name"), F.inline(table_findings)))


def schema_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Existing columns whose type or nullability is not the expected one; missing columns are fine."""
    at = [*TABLE, "column_name"]
    real = actual.select(*at, normalize_for_compare("type_name").alias("actual_type"), F.col("nullable").alias("actual_nullable"))
    j = expected.select(*at, normalize_for_compare("type_name").alias("expected_type"), F.col("nullable").alias("expected_nullable")).join(real, at)
    drift = F.when(F.col("actual_type") != F.col("expected_type"), "type").when(
        F.col("actual_nullable") != F.col("expected_nullable"), "nullability"
    )
    return j.withColumn("drift", drift).filter(F.col("drift").isNotNull())


# --- Compatibility and coverage --------------------------------------------------


def type_compatible(pairs: DataFrame, overrides: DataFrame | None = None, spec: CompatibilityMap = MSSQL_PG) -> DataFrame:
    """Add ``effective_type`` and ``is_compatible`` to (source_table, source_column, source_type, sink_type).

    ``overrides`` (source_table, source_column, effective_type) replaces single source types.
    The type tables are literals in the expression, so only overrides are joined.
    """
    out = pairs.withColumn("effective_type", F.col("source_type"))
    if overrides is not None:
        per_column = overrides.groupBy(
            F.lower("source_table").alias("__t"), F.lower("source_column").alias("__c")
        ).agg(F.min("effective_type").alias("__override"))
        out = (
            pairs.join(per_column, (F.lower("source_table") == F.col("__t")) & (F.lower("source_column") == F.col("__c")), "left")
            .withColumn("effective_type", F.coalesce("__override", "source_type"))
            .drop("__t", "__c", "__override")
        )
    return out.withColumn("is_compatible", compatible("effective_type", "sink_type", spec))


def valid_overrides(usages: DataFrame, allowed: Sequence[str], spec: CompatibilityMap = MSSQL_PG) -> DataFrame:
    """Types a source column may be declared as: compatible with every sink column that uses it.

    ``usages``: source_table, source_column, sink_type (null where nothing uses the column,
    which then may have any type).
    """
    types = sorted(dict.fromkeys(allowed), key=str.casefold)
    uses = usages.distinct().select("*", F.explode(F.array(*map(F.lit, types))).alias("override_type"))
    fits = F.col("sink_type").isNull() | compatible("override_type", "sink_type", spec)
    return (
        uses.groupBy("source_table", "source_column", "override_type")
        .agg(F.bool_and(fits).alias("__fits"))
        .filter("__fits")
        .drop("__fits")
    )


def uncovered_required(sink: DataFrame, source: DataFrame, mapping: DataFrame, generated: Sequence[str] = (), spec: CompatibilityMap = MSSQL_PG) -> DataFrame:
    """Sink columns nothing fills, and same-name columns whose types do not fit.

    Required means not null or key, without a default. A column is filled by an explicit
    mapping (schema_name, table_name, sink_column), by a generated column, or by a source
    column of the same name and a fitting type.
    """
    at = [*TABLE, "column_name"]
    mapped = mapping.select(*TABLE, F.col("sink_column").alias("column_name")).distinct()
    open_columns = sink.join(mapped, at, "left_anti")
    if generated:
        open_columns = open_columns.filter(~F.col("column_name").isin(*generated))
    types = source.select(*at, F.col("type_name").alias("source_type"))
    j = open_columns.join(types, at, "left").withColumn(
        "__fits", F.col("source_type").isNotNull() & compatible("source_type", "type_name", spec)
    )
    required = (~F.col("nullable") | F.col("primary_key")) & F.col("default_value").isNull()
    issue = F.when(F.col("source_type").isNotNull() & ~F.col("__fits"), "incompatible type").when(
        ~F.col("__fits") & required, "required column not filled"
    )
    return j.withColumn("issue", issue).filter(F.col("issue").isNotNull()).select(*at, "source_type", F.col("type_name").alias("sink_type"), "issue")


def mapping_errors(mapping: DataFrame, source: DataFrame, sink: DataFrame, spec: CompatibilityMap = MSSQL_PG) -> DataFrame:
    """Explicit mappings that cannot work: unknown source or sink column, or types that do not fit."""
    src = source.select(*TABLE, F.col("column_name").alias("source_column"), F.col("type_name").alias("source_type"))
    dst = sink.select(*TABLE, F.col("column_name").alias("sink_column"), F.col("type_name").alias("sink_type"))
    j = mapping.join(src, [*TABLE, "source_column"], "left").join(dst, [*TABLE, "sink_column"], "left")
    error = (
        F.when(F.col("source_type").isNull(), "unknown source column")
        .when(F.col("sink_type").isNull(), "unknown sink column")
        .when(~mapping_accepts("source_type", "sink_type", spec), "type mismatch")
    )
    return j.withColumn("error", error).filter(F.col("error").isNotNull()).select(
        *TABLE, "source_column", "sink_column", "source_type", "sink_type", "error"
    )


def identity_columns(source: DataFrame, sink: DataFrame) -> DataFrame:
    """Columns that source and sink tables have under the same name."""
    at = [*TABLE, "column_name"]
    return source.select(*at).intersect(sink.select(*at))


def artifact_status(current: DataFrame, history: DataFrame) -> DataFrame:
    """Pending, applied or modified, by comparing content checksums with the latest applied one.

    ``current``: artifact, content. ``history``: artifact, checksum, applied_at.
    """
    last = history.groupBy("artifact").agg(
        F.max_by("checksum", "applied_at").alias("applied_checksum"), F.max("applied_at").alias("applied_at")
    )
    status = (
        F.when(F.col("applied_checksum").isNull(), "pending")
        .when(F.col("applied_checksum") == F.col("checksum"), "applied")
        .otherwise("modified")
    )
    return (
        current.select("artifact", F.sha2("content", 256).alias("checksum"))
        .join(last, "artifact", "left")
        .withColumn("status", status)
    )


def rename_targets(types: Mapping[str, str], mapping: Mapping[str, str] = MSSQL_TO_PG) -> dict[str, str]:
    """Target type of each column of one table, for a table spec."""
    return {name: map_type_name(t, mapping) for name, t in types.items()}
