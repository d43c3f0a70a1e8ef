"""Catalogs and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefeed.functions import types as Y
from changefeed.operators import catalog as C
from changefeed.sources.catalogs import foreign_keys, sized_type
from queries.base import Tables, query
from queries.columns import _MAPPED


# --- Inventories and topologies ----------------------------------------------

_SCANNED = """(select concat('db_', cast(o_custkey as varchar)) as db_name, concat('svc', cast(cast(floor(o_custkey / 7) as bigint) as varchar)) as service,
  case o_custkey % 3 when 0 then 'dev' when 1 then 'nonprod' else 'stage' end as environment, 'main' as server, o_orderkey % 100 as table_count, cast(null as varchar) as target_sink_env from {orders})"""
_EXISTING = """(select db_name, service, environment, server, table_count, case when ord % 3 = 0 then 'dev' end as target_sink_env from {databases})"""


@query(
    "c11_merge_inventory",
    f"""with s as {_SCANNED}, e as {_EXISTING}
    select s.db_name, s.service, s.environment, s.server, s.table_count, k.t as target_sink_env from s left join
      (select db_name, min(target_sink_env) as t from e where target_sink_env is not null group by db_name) k on k.db_name = s.db_name
    union all select e.* from e where e.server not in ('main') and not exists (select 1 from s where s.service = e.service and s.environment = e.environment)""",
)
def _(t: Tables) -> DataFrame:
    scanned = t.sql(
        """select concat('db_', cast(o_custkey as string)) as db_name, concat('svc', cast(cast(floor(o_custkey / 7) as bigint) as string)) as service,
        case o_custkey % 3 when 0 then 'dev' when 1 then 'nonprod' else 'stage' end as environment, 'main' as server, o_orderkey % 100 as table_count, cast(null as string) as target_sink_env from {orders}"""
    )
    existing = t("databases").select(
        "db_name", "service", "environment", "server", F.col("table_count").cast("bigint").alias("table_count"), F.when(F.col("ord") % 3 == 0, "dev").alias("target_sink_env")
    )
    return C.merge_inventory(existing, scanned, ["main"])


@query(
    "c11_merge_schemas",
    "select service, schema_name from {env_schemas} union select d.service, s.schema_name from {databases} d join {database_schemas} s on s.db_name = d.db_name",
)
def _(t: Tables) -> DataFrame:
    scanned = t("databases").join(t("database_schemas"), "db_name").select("service", "schema_name")
    return C.merge_schemas(t("env_schemas"), scanned)


@query(
    "d5_inventory_stats",
    """select 'all' as scope, count(*) as databases, cast(sum(table_count) as bigint) as tables, cast(floor(sum(table_count) / count(*)) as bigint) as avg_tables from {databases}
    union all select concat('env:', environment), count(*), cast(sum(table_count) as bigint), cast(floor(sum(table_count) / count(*)) as bigint) from {databases} where environment <> '' group by environment""",
)
def _(t: Tables) -> DataFrame:
    return C.inventory_stats(t("databases"))


@query("d6_service_environments", "select distinct service, environment from {databases} where environment <> ''")
def _(t: Tables) -> DataFrame:
    return C.service_environments(t("databases"))


@query(
    "d7_build_topology_shared",
    """select distinct d.service as source_name, cast(null as varchar) as env, 'schema' as key, s.schema_name as value from {databases} d join {database_schemas} s on s.db_name = d.db_name
    union all select service, environment, 'database', db_name from {databases} where environment <> ''
    union all select service, environment, 'server', arg_min(server, ord) from {databases} where environment <> '' group by service, environment
    union all select service, environment, 'table_count', cast(sum(table_count) as varchar) from {databases} where environment <> '' group by service, environment""",
)
def _(t: Tables) -> DataFrame:
    return C.build_topology(t("databases"), t("database_schemas"), "shared")


@query(
    "d7_build_topology_per_tenant",
    """with d as (select *, case when environment = '' then 'default' else environment end as e from {databases})
    select distinct d.customer as source_name, cast(null as varchar) as env, 'schema' as key, s.schema_name as value from d join {database_schemas} s on s.db_name = d.db_name
    union all select customer, e, 'server', arg_max(server, ord) from d group by customer, e
    union all select customer, e, 'table_count', cast(arg_max(table_count, ord) as varchar) from d group by customer, e
    union all select customer, e, 'database', arg_max(db_name, ord) from d group by customer, e""",
)
def _(t: Tables) -> DataFrame:
    return C.build_topology(t("databases"), t("database_schemas"), "per_tenant")


@query(
    "d10_missing_keys",
    """select source_name, count(*) filter (where not has) as missing_in from
    (select source_name, env, bool_or(key = 'customer_id') as has from {topology} where env is not null group by source_name, env) x
    where source_name not in (select source_name from {topology} where env is null and key = 'customer_id') group by source_name having count(*) filter (where not has) > 0""",
)
def _(t: Tables) -> DataFrame:
    return C.missing_keys(t("topology"), "customer_id")


@query(
    "d10_missing_keys_everywhere",
    "select cast(null as varchar) as source_name, count(*) as missing_in from (select distinct source_name, env from {topology} where env is not null)",
)
def _(t: Tables) -> DataFrame:
    return C.missing_keys(t("topology"), "host")


@query("d14_target_schemas", "select distinct target_schema_name from {catalog_tables} where target_schema_name <> 'public' order by 1")
def _(t: Tables) -> DataFrame:
    return C.target_schemas(t("catalog_tables"))


@query(
    "d15_environment_parity",
    """with b as (select distinct service, schema_name from {env_schemas} where environment = 'dev'), o as (select * from {env_schemas} where environment <> 'dev'),
    d as (select * from {env_databases} where environment <> 'dev' and service in (select service from b))
    select d.service, d.environment, 'missing schema' as warning, b.schema_name as detail from d join b on b.service = d.service
      where not exists (select 1 from o where o.service = d.service and o.environment = d.environment and o.schema_name = b.schema_name)
    union all select o.service, o.environment, 'extra schema', o.schema_name from o where o.service in (select service from b)
      and not exists (select 1 from b where b.service = o.service and b.schema_name = o.schema_name)
    union all select d.service, d.environment, 'table count differs', cast(x.table_count as varchar) from d join {env_databases} x on x.service = d.service and x.environment = 'dev'
      where x.table_count > 0 and x.table_count <> d.table_count""",
)
def _(t: Tables) -> DataFrame:
    return C.environment_parity(t("env_databases"), t("env_schemas"))


@query("g4_all_sink_envs", "select distinct target_env as env from {sink_targets} union select distinct env from {topology} where env is not null")
def _(t: Tables) -> DataFrame:
    return C.all_sink_envs([t("sink_targets").withColumnRenamed("target_env", "env"), t("topology")])


_KEY_ROWS = """(select concat('db_', cast(o_custkey as varchar)) as db_name, o_orderkey as ord, case o_orderkey % 5 when 0 then ' ' when 1 then cast(null as varchar) else concat(' ', o_orderpriority, ' ') end as value from {orders})"""


def _key_rows(t: Tables) -> DataFrame:
    return t.sql(
        """select concat('db_', cast(o_custkey as string)) as db_name, o_orderkey as ord,
        case o_orderkey % 5 when 0 then ' ' when 1 then cast(null as string) else concat(' ', o_orderpriority, ' ') end as value from {orders}"""
    )


_FIRST_VALUE = f"(select d.db_name, nullif(trim(r.value), '') as value from {{databases}} d left join (select * from (select *, row_number() over (partition by db_name order by ord) as rn from {_KEY_ROWS}) where rn = 1) r on r.db_name = d.db_name)"


@query("m3_custom_keys", f"select db_name, value from {_FIRST_VALUE}")
def _(t: Tables) -> DataFrame:
    return C.custom_keys(t("databases"), _key_rows(t))[0]


@query("m3_custom_keys_missing", f"select db_name, 'missing value' as warning from {_FIRST_VALUE} where value is null")
def _(t: Tables) -> DataFrame:
    return C.custom_keys(t("databases"), _key_rows(t))[1]


# --- Columns and keys ---------------------------------------------------------


@query(
    "d8_case_variants",
    """with n as (select distinct lower(column_name) as folded_name, column_name from {catalog_before})
    select n.folded_name, n.column_name, c.variants from n join (select folded_name, count(*) as variants from n group by folded_name having count(*) > 1) c on c.folded_name = n.folded_name""",
)
def _(t: Tables) -> DataFrame:
    return C.case_variants(t("catalog_before"))


@query(
    "d16_table_column_counts",
    "select t.schema_name, t.table_name, count(c.column_name) as column_count from {catalog_tables} t left join {catalog_after} c on c.schema_name = t.schema_name and c.table_name = t.table_name group by t.schema_name, t.table_name",
)
def _(t: Tables) -> DataFrame:
    return C.table_column_counts(t("catalog_tables"), t("catalog_after"))


@query(
    "j1_target_schema",
    f"""with own as (select schema_name, table_name, 0 as part, ordinal, column_name, {_MAPPED} as target_type, nullable from {{catalog_before}} where lower(column_name) not in ('col5')),
    x as (select * from own union all select schema_name, table_name, 1, e.ordinal, e.column_name, e.target_type, e.nullable from (select distinct schema_name, table_name from {{catalog_before}}),
      (values (cast(0 as bigint), 'ID', 'text', true), (1, 'customer_id', 'uuid', false), (2, '__source', 'text', true)) e(ordinal, column_name, target_type, nullable))
    select schema_name, table_name, part, ordinal, column_name, target_type, nullable from
    (select *, row_number() over (partition by schema_name, table_name, lower(column_name) order by part, ordinal) as rn from x) where rn = 1""",
)
def _(t: Tables) -> DataFrame:
    extra = [("ID", "text", True), ("customer_id", "uuid", False), ("__source", "text", True)]
    return C.target_columns(t("catalog_before"), ["COL5"], extra)


_KEYS = """(select schema_name, table_name, ordinal, column_name from {catalog_after} where primary_key)"""


@query(
    "j11_resolve_keys",
    f"""select schema_name, table_name, cast(row_number() over (partition by schema_name, table_name order by ordinal) - 1 as integer) as key_position, column_name from
    (select * from {_KEYS} union all select distinct schema_name, table_name, -1, 'customer_id' from {_KEYS})""",
)
def _(t: Tables) -> DataFrame:
    return C.resolve_keys(t("catalog_after"), tenant=True)[0]


@query(
    "j11_resolve_keys_declared",
    f"""with d as (select schema_name, table_name, ordinal, upper(column_name) as column_name from {{catalog_after}} where default_value is not null)
    select schema_name, table_name, cast(row_number() over (partition by schema_name, table_name order by ordinal) - 1 as integer) as key_position, column_name from
    (select * from {_KEYS} k where not exists (select 1 from d where d.schema_name = k.schema_name and d.table_name = k.table_name) union all select * from d)""",
)
def _(t: Tables) -> DataFrame:
    after = t("catalog_after")
    declared = after.filter(F.col("default_value").isNotNull()).withColumn("column_name", F.upper("column_name"))
    return C.resolve_keys(after, declared)[0]


@query(
    "j11_tables_without_key",
    f"select distinct schema_name, table_name from {{catalog_after}} a where not exists (select 1 from {_KEYS} k where k.schema_name = a.schema_name and k.table_name = a.table_name)",
)
def _(t: Tables) -> DataFrame:
    return C.resolve_keys(t("catalog_after"))[1]


@query(
    "j12_missing_tenant_column",
    """select schema_name, table_name from {catalog_tables} t where not target_exists
    and not exists (select 1 from {catalog_after} a where a.schema_name = t.schema_name and a.table_name = t.table_name and lower(a.column_name) = 'added5')""",
)
def _(t: Tables) -> DataFrame:
    return C.missing_tenant_column(t("catalog_tables"), t("catalog_after"), "added5")


@query(
    "j9_evolve",
    "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, cast(null as varchar) as note, 'nb' as lang, cast(0 as bigint) as visits from {customer}",
)
def _(t: Tables) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("C_NAME", T.StringType()),
            T.StructField("note", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("visits", T.LongType()),
        ]
    )
    return C.evolve(t("customer"), schema, {"lang": "nb", "visits": 0})


@query(
    "j8_replication_summary",
    f"select schema_name, table_name, count(*) as column_count, count(*) filter (where primary_key) as key_columns, count(*) filter (where type_name <> {_MAPPED}) as type_changes from {{catalog_before}} group by schema_name, table_name",
)
def _(t: Tables) -> DataFrame:
    return C.replication_summary(t("catalog_before"))


@query("j8_type_changes", f"select schema_name, table_name, column_name, type_name as source_type, {_MAPPED} as sink_type from {{catalog_before}} where type_name <> {_MAPPED}")
def _(t: Tables) -> DataFrame:
    return C.type_changes(t("catalog_before"))


@query(
    "j14_foreign_keys",
    """select concat('T', cast(l_orderkey as varchar)) as table_name, concat('fk_', cast(l_orderkey as varchar), '_', cast(l_linenumber as varchar), '_', cast(l_partkey as varchar)) as constraint_name,
    concat('part', cast(l_linenumber as varchar)) as column_name, concat('P', cast(l_partkey as varchar), '.id') as "references" from {lineitem}""",
)
def _(t: Tables) -> DataFrame:
    ids = "concat(cast(l_orderkey as string), '_', cast(l_linenumber as string), '_', cast(l_partkey as string))"
    keys = t.sql(f"select {ids} as constraint_id, concat('T', cast(l_orderkey as string)) as table_name, concat('fk_', {ids}) as constraint_name from {{lineitem}}").distinct()
    columns = t.sql(
        f"select {ids} as constraint_id, concat('part', cast(l_linenumber as string)) as column_name, concat('P', cast(l_partkey as string)) as referenced_table, 'id' as referenced_column from {{lineitem}}"
    )
    return foreign_keys(keys, columns)


@query(
    "j14_sized_types",
    """select p_partkey, case when p_type in ('nvarchar', 'char') and p_size <> 0 then concat(p_type, '(', case when p_size = -1 then 'MAX' else cast(p_size as varchar) end, ')') else p_type end as sized_type
    from (select p_partkey, case p_partkey % 3 when 0 then 'nvarchar' when 1 then 'char' else 'int' end as p_type, case when p_size % 5 = 0 then -1 when p_size % 7 = 0 then 0 else p_size end as p_size from {part})""",
)
def _(t: Tables) -> DataFrame:
    rows = t.sql(
        "select p_partkey, case p_partkey % 3 when 0 then 'nvarchar' when 1 then 'char' else 'int' end as type_name, case when p_size % 5 = 0 then -1 when p_size % 7 = 0 then 0 else p_size end as max_length from {part}"
    )
    return rows.select("p_partkey", sized_type().alias("sized_type"))


# --- Comparing catalogs ---------------------------------------------------------

_AT = "{a}.schema_name = {b}.schema_name and {a}.table_name = {b}.table_name"


def _at(a: str, b: str) -> str:
    return _AT.format(a=a, b=b)


@query(
    "j3_schema_diff",
    f"""with n as (select * from {{catalog_after}}), o as (select * from {{catalog_before}}), nt as (select distinct schema_name, table_name from n), ot as (select distinct schema_name, table_name from o)
    select nt.*, 'table_added' as kind, cast(null as varchar) as column_name, cast(null as varchar) as old_value, cast(null as varchar) as new_value, 'info' as severity from nt where not exists (select 1 from ot where {_at('ot', 'nt')})
    union all select ot.*, 'table_removed', null, null, null, 'warning' from ot where not exists (select 1 from nt where {_at('ot', 'nt')})
    union all select n.schema_name, n.table_name, 'column_added', n.column_name, null, n.type_name, 'info' from n where exists (select 1 from ot where {_at('ot', 'n')}) and not exists (select 1 from o where {_at('o', 'n')} and o.column_name = n.column_name)
    union all select o.schema_name, o.table_name, 'column_removed', o.column_name, o.type_name, null, 'warning' from o where exists (select 1 from nt where {_at('nt', 'o')}) and not exists (select 1 from n where {_at('n', 'o')} and o.column_name = n.column_name)
    union all select n.schema_name, n.table_name, 'column_type_changed', n.column_name, upper(o.type_name), upper(n.type_name), 'breaking' from n join o on {_at('n', 'o')} and n.column_name = o.column_name where upper(n.type_name) <> upper(o.type_name)""",
)
def _(t: Tables) -> DataFrame:
    return C.schema_diff(t("catalog_after"), t("catalog_before"))


@query(
    "g2_set_difference",
    "select 'missing' as side, schema_name, table_name from (select schema_name, table_name from {catalog_before} except select schema_name, table_name from {catalog_after}) union all select 'new', schema_name, table_name from (select schema_name, table_name from {catalog_after} except select schema_name, table_name from {catalog_before})",
)
def _(t: Tables) -> DataFrame:
    before, after = (t(n).select(*C.TABLE).distinct() for n in ("catalog_before", "catalog_after"))
    lost, new = before.join(after, C.TABLE, "left_anti"), after.join(before, C.TABLE, "left_anti")
    return lost.select(F.lit("missing").alias("side"), "*").unionByName(new.select(F.lit("new").alias("side"), "*"))


def _norm(c: str) -> str:
    return f"(case when lower({c}) like 'varchar%' then replace(lower({c}), 'varchar', 'character varying') when lower({c}) = 'timestamp' then 'timestamp without time zone' when lower({c}) = 'timestamptz' then 'timestamp with time zone' else lower({c}) end)"


_BOTH = f"""n as (select *, lower(column_name) as c from {{catalog_after}}), o as (select *, lower(column_name) as c from {{catalog_before}}),
    tb as (select distinct n.schema_name, n.table_name from n join o on {_at('n', 'o')}),
    j as (select coalesce(n.schema_name, o.schema_name) as schema_name, coalesce(n.table_name, o.table_name) as table_name, coalesce(n.c, o.c) as c, n.column_name as nn, o.column_name as oo, n.type_name as nt, o.type_name as ot,
      n.nullable as nu, o.nullable as ou, coalesce(n.primary_key, false) as nk, coalesce(o.primary_key, false) as ok from n full outer join o on {_at('n', 'o')} and n.c = o.c),
    b as (select j.* from j join tb on {_at('j', 'tb')}),
    g as (select schema_name, table_name, bool_or(nk <> ok) as differ, coalesce(string_agg(c, ', ' order by c) filter (where ok), '<none>') as okey, coalesce(string_agg(c, ', ' order by c) filter (where nk), '<none>') as nkey,
      count(*) filter (where nn is null) as gone, count(*) filter (where oo is null) as came, min(oo) filter (where nn is null) as gname, min(nn) filter (where oo is null) as cname from b group by schema_name, table_name)"""


@query(
    "j4_destructive_changes",
    f"""with {_BOTH}
    select schema_name, table_name, oo as column_name, 'COLUMN_REMOVED' as kind, cast(null as varchar) as old_value, cast(null as varchar) as new_value from b where nn is null
    union all select schema_name, table_name, oo, 'COLUMN_TYPE_CHANGED', ot, nt from b where nn is not null and oo is not null and {_norm('ot')} <> {_norm('nt')}
    union all select schema_name, table_name, oo, 'COLUMN_NULLABILITY_CHANGED', cast(ou as varchar), cast(nu as varchar) from b where nn is not null and oo is not null and ou <> nu
    union all select schema_name, table_name, null, 'PRIMARY_KEY_CHANGED', okey, nkey from g where differ
    union all select schema_name, table_name, null, 'POSSIBLE_RENAME_HINT', gname, cname from g where gone = 1 and came = 1""",
)
def _(t: Tables) -> DataFrame:
    return C.destructive_changes(t("catalog_after"), t("catalog_before"))


@query(
    "j5_schema_drift",
    f"""select n.schema_name, n.table_name, n.column_name, {_norm('n.type_name')} as expected_type, n.nullable as expected_nullable, {_norm('o.type_name')} as actual_type, o.nullable as actual_nullable,
    case when {_norm('n.type_name')} <> {_norm('o.type_name')} then 'type' else 'nullability' end as drift
    from {{catalog_after}} n join {{catalog_before}} o on {_at('n', 'o')} and n.column_name = o.column_name where {_norm('n.type_name')} <> {_norm('o.type_name')} or n.nullable <> o.nullable""",
)
def _(t: Tables) -> DataFrame:
    return C.schema_drift(t("catalog_after"), t("catalog_before"))


_ARTIFACTS = "(select concat('01-tables/', cast(o_orderkey as varchar), '.sql') as artifact, concat('v', cast(o_custkey as varchar)) as content from {orders})"
_HISTORY = """(select concat('01-tables/', cast(l_orderkey as varchar), '.sql') as artifact, sha256(concat('v', cast(l_partkey % 200 as varchar))) as checksum,
  l_orderkey * 100000 + l_partkey * 10 + l_linenumber as applied_at from {lineitem})"""


@query(
    "j10_artifact_status",
    f"""select c.artifact, sha256(c.content) as checksum, h.applied_checksum, h.applied_at,
    case when h.applied_checksum is null then 'pending' when h.applied_checksum = sha256(c.content) then 'applied' else 'modified' end as status
    from {_ARTIFACTS} c left join (select artifact, arg_max(checksum, applied_at) as applied_checksum, max(applied_at) as applied_at from {_HISTORY} group by artifact) h on h.artifact = c.artifact""",
)
def _(t: Tables) -> DataFrame:
    current = t.sql("select concat('01-tables/', cast(o_orderkey as string), '.sql') as artifact, concat('v', cast(o_custkey as string)) as content from {orders}")
    history = t.sql(
        """select concat('01-tables/', cast(l_orderkey as string), '.sql') as artifact, sha2(concat('v', cast(l_partkey % 200 as string)), 256) as checksum,
        l_orderkey * 100000 + l_partkey * 10 + l_linenumber as applied_at from {lineitem}"""
    )
    return C.artifact_status(current, history)


# --- Compatibility and coverage --------------------------------------------------


def _values(pairs: list[tuple[str, str]], names: str) -> str:
    return "(values " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + f") {names}"


_PAIRS = [*Y.MSSQL_PG_EXACT.items(), *((s, d) for s, ds in Y.MSSQL_PG_CASTABLE.items() if s != "*" for d in ds)]
_ACCEPTED = _values(list(dict.fromkeys(_PAIRS)), "acc(src, dst)")


def _bare(c: str) -> str:
    return f"trim(lower(regexp_replace({c}, '\\s*\\([^)]*\\)', '', 'g')))"


def _src(c: str) -> str:
    return f"(case {_bare(c)} when 'integer' then 'int' else {_bare(c)} end)"


def _dst(c: str) -> str:
    cases = " ".join(f"when '{a}' then '{b}'" for a, b in Y.PG_SINK_ALIASES.items())
    return f"(case {_bare(c)} {cases} else {_bare(c)} end)"


def _fits(source: str, sink: str) -> str:
    return f"({_dst(sink)} in ('text', 'character varying', 'character') or exists (select 1 from {_ACCEPTED} where acc.src = {_src(source)} and acc.dst = {_dst(sink)}))"


@query(
    "j2_type_compatible",
    f"""select source_table, source_column, source_type, sink_type, effective_type, {_fits('effective_type', 'sink_type')} as is_compatible from
    (select p.*, coalesce(o.effective_type, p.source_type) as effective_type from {{type_pairs}} p left join {{type_overrides}} o on lower(o.source_table) = lower(p.source_table) and lower(o.source_column) = lower(p.source_column))""",
)
def _(t: Tables) -> DataFrame:
    return C.type_compatible(t("type_pairs"), t("type_overrides"))


_PG_TYPE = "case p_partkey % 9 when 0 then 'int4' when 1 then 'varchar(20)' when 2 then 'timestamp' when 3 then 'uuid' when 4 then 'bool' when 5 then 'decimal(10,2)' when 6 then 'json' when 7 then 'date' else 'money' end"
_PG_SINK = "case p_size % 7 when 0 then 'bigint' when 1 then 'character varying' when 2 then 'timestamptz' when 3 then 'uuid' when 4 then 'boolean' when 5 then 'float8' else 'jsonb' end"


@query(
    "j2_type_compatible_same_engine",
    f"""select p_partkey, s, d, case split_part(s, '(', 1) when 'int4' then d in ('bigint', 'float8') when 'varchar' then d = 'character varying' when 'timestamp' then d = 'timestamptz'
    when 'uuid' then d = 'uuid' when 'bool' then d = 'boolean' when 'decimal' then d = 'float8' when 'date' then d = 'timestamptz' else false end as is_compatible
    from (select p_partkey, {_PG_TYPE} as s, {_PG_SINK} as d from {{part}})""",
)
def _(t: Tables) -> DataFrame:
    rows = t.sql(f"select p_partkey, {_PG_TYPE} as s, {_PG_SINK} as d from {{part}}")
    return rows.withColumn("is_compatible", Y.compatible("s", "d", Y.PG_PG))


_ALLOWED = ["int", "bigint", "uniqueidentifier", "nvarchar", "datetime2", "bit", "float"]
_ALLOWED_SQL = "(values " + ", ".join(f"('{a}')" for a in _ALLOWED) + ") allowed(override_type)"


@query(
    "j13_valid_overrides",
    f"""select source_table, source_column, override_type from
    (select distinct p.source_table, case when p.source_column = 'col6' then 'col1' else p.source_column end as source_column, p.sink_type, override_type from {{type_pairs}} p, {_ALLOWED_SQL}) u
    group by source_table, source_column, override_type having bool_and({_fits('override_type', 'sink_type')})""",
)
def _(t: Tables) -> DataFrame:
    # Two sink columns use col1 of every table, so some types fit one and not the other.
    column = F.when(F.col("source_column") == "col6", "col1").otherwise(F.col("source_column"))
    usages = t("type_pairs").select("source_table", column.alias("source_column"), "sink_type")
    return C.valid_overrides(usages, _ALLOWED)


@query(
    "j6_uncovered_required",
    f"""with s as (select k.* from {{sink_catalog}} k where column_name <> 'col7' and not exists (select 1 from {{column_mapping}} m where {_at('m', 'k')} and m.sink_column = k.column_name)),
    j as (select s.schema_name, s.table_name, s.column_name, b.type_name as source_type, s.type_name as sink_type, (not s.nullable or s.primary_key) and s.default_value is null as required
      from s left join {{catalog_before}} b on {_at('s', 'b')} and b.column_name = s.column_name),
    f as (select *, source_type is not null and {_fits('source_type', 'sink_type')} as fits from j)
    select schema_name, table_name, column_name, source_type, sink_type, case when source_type is not null then 'incompatible type' else 'required column not filled' end as issue
    from f where not fits and (source_type is not null or required)""",
)
def _(t: Tables) -> DataFrame:
    return C.uncovered_required(t("sink_catalog"), t("catalog_before"), t("column_mapping"), ["col7"])


@query(
    "j7_mapping_errors",
    f"""with j as (select m.*, b.type_name as source_type, k.type_name as sink_type from {{column_mapping}} m left join {{catalog_before}} b on {_at('m', 'b')} and b.column_name = m.source_column
      left join {{sink_catalog}} k on {_at('m', 'k')} and k.column_name = m.sink_column)
    select schema_name, table_name, source_column, sink_column, source_type, sink_type,
    case when source_type is null then 'unknown source column' when sink_type is null then 'unknown sink column' else 'type mismatch' end as error from j
    where source_type is null or sink_type is null or not ({_fits('source_type', 'sink_type')} or
      (regexp_matches({_bare('sink_type')}, 'char|text|string|user-defined') and regexp_matches({_bare('source_type')}, 'int|numeric|decimal|float|double|real|money|uuid|uniqueidentifier')))""",
)
def _(t: Tables) -> DataFrame:
    return C.mapping_errors(t("column_mapping"), t("catalog_before"), t("sink_catalog"))


@query(
    "g3_identity_columns",
    "select schema_name, table_name, column_name from {catalog_before} intersect select schema_name, table_name, column_name from {sink_catalog}",
)
def _(t: Tables) -> DataFrame:
    return C.identity_columns(t("catalog_before"), t("sink_catalog"))
