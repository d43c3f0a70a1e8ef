"""Projections, computed columns, rules and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.functions.catalog import FunctionCatalog
from changefeed.functions import expressions as X
from changefeed.functions import names as N
from changefeed.functions import types as Y
from changefeed.operators import columns as C
from changefeed.operators import rules as R
from changefeed.spec import Condition, Rule, Template
from queries.base import Tables, moment, query


RULES = R.RuleRegistry.from_dicts(
    {
        "priority_label": {
            "type": "conditional_column",
            "output_column": {"name": "_priority_label"},
            "conditions": [{"when": "priority > 3", "value": "'high'"}, {"when": "priority > 1", "value": "'medium'"}],
            "default_value": "'low'",
            "on_no_match": "default",
        },
        "priority_known": {
            "type": "conditional_column",
            "output_column": {"name": "_known"},
            "conditions": [{"when": "status = 'active'", "value": "id"}],
            "on_no_match": "keep",
        },
        "priority_strict": {
            "type": "conditional_column",
            "output_column": {"name": "_strict"},
            "conditions": [{"when": "status = 'active'", "value": "'a'"}, {"when": "priority > 4", "value": "'p'"}],
            "on_no_match": "drop",
        },
        "user_class": {
            "type": "row_multiplier",
            "output_column": {"name": "_user_class"},
            "conditions": [
                {"when": "patient", "value": "'Patient'"},
                {"when": "ansatt", "value": "'Ansatt'"},
                {"when": "frilanser", "value": "'Frilanser'"},
            ],
            "on_no_match": "drop",
        },
        "active_only": {"type": "filter", "conditions": [{"when": "is_active = true"}]},
        "valid_status": {"type": "filter", "conditions": [{"when": "status = 'active'"}, {"when": "status = 'pending'"}]},
    }
)


@query("b10_prune_columns", "select c_custkey, c_name, c_nationkey from {customer}")
def _(t: Tables) -> DataFrame:
    return C.prune_columns(t("customer"), include=["C_NAME", "c_nationkey", "c_acctbal"], ignore=["C_AcctBal"], keys=["c_custkey"])


@query("b10_prune_columns_ignore_first", "select c_custkey, c_name, c_nationkey, c_mktsegment from {customer}")
def _(t: Tables) -> DataFrame:
    return C.prune_columns(t("customer"), include=["c_name"], ignore=["C_AcctBal"], mode="ignore_first")


@query("b11_dedupe_columns", "select c_custkey, c_name from {customer}")
def _(t: Tables) -> DataFrame:
    c = t("customer")
    twice = c.select("c_custkey", "c_name", F.col("c_custkey").alias("C_CUSTKEY"), F.upper("c_name").alias("C_Name"))
    return C.dedupe_frame(twice)


@query("b12_rename_columns", 'select c_custkey as "Id", c_name as "Navn", c_acctbal from {customer}')
def _(t: Tables) -> DataFrame:
    return C.rename_columns(t("customer").select("c_custkey", "c_name", "c_acctbal"), {"c_custkey": "Id", "c_name": "Navn"})


@query(
    "b13_normalize_identifier",
    "select id, replace(replace(translate(name, 'åÅøØ', 'aAoO'), 'æ', 'ae'), 'Æ', 'AE') as normalized from {norwegian_names}",
)
def _(t: Tables) -> DataFrame:
    return t("norwegian_names").select("id", X.normalize_identifier("name").alias("normalized"))


@query(
    "b14_safe_identifier",
    """select id, case when s = '' then 'unnamed' else s end as identifier from
    (select id, trim(regexp_replace(name, '[^A-Za-z0-9_]+', '_', 'g'), '_') as s from
      (select id, case when id % 50 = 0 then '--' else name end as name from {norwegian_names}))""",
)
def _(t: Tables) -> DataFrame:
    name = F.when(F.col("id") % 50 == 0, F.lit("--")).otherwise(F.col("name"))
    return t("norwegian_names").select("id", X.safe_identifier(name).alias("identifier"))


@query(
    "b14_feed_name",
    """select schema_name, table_name, concat(case when n = 1 and lower(schema_name) = 'dbo' then table_name
      else concat(schema_name, '_', table_name) end, '_CT') as feed_name
    from (select *, count(*) over (partition by lower(table_name)) as n from
      (select schema_name, case when target_exists then concat('Shared', right(table_name, 1)) else table_name end as table_name from {catalog_tables}))""",
)
def _(t: Tables) -> DataFrame:
    name = F.when(F.col("target_exists"), F.concat(F.lit("Shared"), F.right("table_name", F.lit(1)))).otherwise(F.col("table_name"))
    return N.feed_name(t("catalog_tables").select("schema_name", name.alias("table_name")))


_MAPPED = """case lower(trim(regexp_replace(type_name, '\\s*\\([^)]*\\)', '', 'g'))) when 'int' then 'integer' when 'nvarchar' then 'varchar' when 'datetime2' then 'timestamp'
  when 'uniqueidentifier' then 'uuid' when 'bit' then 'boolean' when 'money' then 'numeric' when 'varchar' then 'varchar' when 'tinyint' then 'smallint'
  when 'decimal' then 'numeric' when 'geography' then 'text' when 'text' then 'text' when 'rowversion' then 'bytea' when 'bigint' then 'bigint' else 'text' end"""


@query("b15_map_type", f"select schema_name, table_name, column_name, {_MAPPED} as target_type from {{catalog_before}}")
def _(t: Tables) -> DataFrame:
    return t("catalog_before").select("schema_name", "table_name", "column_name", Y.map_type("type_name").alias("target_type"))


@query(
    "b15_map_type_reverse",
    """select p_partkey, case p_partkey % 5 when 0 then 'int' when 1 then 'decimal' when 2 then 'bit' when 3 then 'binary' else 'text' end as source_type from {part}""",
)
def _(t: Tables) -> DataFrame:
    name = F.expr("case p_partkey % 5 when 0 then 'integer' when 1 then 'numeric' when 2 then 'BOOLEAN' when 3 then 'bytea' else 'polygon' end")
    return t("part").select("p_partkey", Y.map_type(name, Y.reverse_mapping(Y.MSSQL_TO_PG)).alias("source_type"))


@query(
    "b15_cast_to_target",
    """select cast(id as integer) as id, name, cast(priority as smallint) as priority, cast(cast(balance as decimal(19, 4)) as double) as balance,
    case when status = 'active' then true end as flag, lower(guid) as guid
    from (select *, upper(md5(name)) as guid from {role_rows})""",
)
def _(t: Tables) -> DataFrame:
    rows = t("role_rows").select(
        "id",
        "name",
        "priority",
        "balance",
        F.when(F.col("status") == "active", F.lit(1)).alias("flag"),
        F.upper(F.md5("name")).alias("guid"),
    )
    types = {"id": "int", "name": "nvarchar(50)", "priority": "TinyInt", "balance": "money", "flag": "bit", "guid": "uniqueidentifier"}
    return C.cast_to_target(rows, types).withColumn("balance", F.col("balance").cast("double"))


@query(
    "b16_apply_templates",
    """select id, 'Actor' as _source_table, 'dbo' as _source_schema, concat('dev.t.', segment) as _kafka_topic, id as _kafka_offset,
    nation as _kafka_partition, cast('2024-02-01 00:00:00' as timestamp) as _synced_at, md5(cast(id as varchar)) as _sync_id,
    case when patient then 'u' else 'c' end as op, printf('%020X', id) as _cdc_lsn, 'nonprod' as deploy_env, 't-17' as _tenant_id,
    sha256(concat('{{"id":', cast(id as varchar), ',"nation":', cast(nation as varchar), ',"patient":', cast(patient as varchar), ',"segment":"', segment, '"}}')) as _row_hash,
    md5(cast(id as varchar)) as _ingestion_id, id * 2 as twice
    from {role_rows}""",
)
def _(t: Tables) -> DataFrame:
    rows = t("role_rows").select("id", "segment", "nation", "patient")
    ctx = {
        "table": F.lit("Actor"),
        "schema": F.lit("dbo"),
        "kafka_topic": F.concat(F.lit("dev.t."), F.col("segment")),
        "kafka_offset": F.col("id"),
        "kafka_partition": F.col("nation"),
        "operation": F.when(F.col("patient"), "u").otherwise("c"),
        "lsn": F.format_string("%020X", F.col("id")),
        "now": moment(),
        "uuid": F.md5(F.col("id").cast("string")),
    }
    templates = [
        "source_table", "source_schema", "kafka_topic", "kafka_offset", "kafka_partition", "sync_timestamp", "sync_id",
        ("cdc_operation", {"name": "op"}), "cdc_lsn", ("environment", {"name": "deploy_env"}), "tenant_id", "row_hash", "ingestion_id",
        Template("twice", "bigint", "id * 2"),
    ]
    out = C.apply_templates(rows, templates, ctx, {"ENVIRONMENT": "nonprod", "TENANT_ID": "t-17"})
    return out.drop("segment", "nation", "patient")


@query(
    "b17_template_value",
    """select id, concat(name, '!') as expression, 'nonprod' as env, cast('2024-02-01 00:00:00' as timestamp) as clock, 'plain' as sql_text, 'cust-7' as reference from {role_rows}""",
)
def _(t: Tables) -> DataFrame:
    ctx = {"now": moment()}
    return t("role_rows").select(
        "id",
        C.template_value("expression", "concat(name, '!')", ctx).alias("expression"),
        C.template_value("env", "${ENVIRONMENT}", ctx, {"ENVIRONMENT": "nonprod"}).alias("env"),
        C.template_value("sql", "now()", ctx).alias("clock"),
        C.template_value("sql", "plain", ctx).alias("sql_text"),
        C.template_value("source_ref", " cust-7 ", ctx).alias("reference"),
    )


@query(
    "b18_row_hash",
    """select id, sha256(concat('{{"id":', cast(id as varchar), ',"name":"', name, '","status":', coalesce('"' || status || '"', 'null'), '}}')) as row_hash from {role_rows}""",
)
def _(t: Tables) -> DataFrame:
    return t("role_rows").select("id", X.row_hash(["status", "name", "id"]).alias("row_hash"))


@query("b19_conditional_column", "select id, case when priority > 3 then 'high' when priority > 1 then 'medium' else 'low' end as _priority_label from {role_rows}")
def _(t: Tables) -> DataFrame:
    return RULES.apply(t("role_rows"), ["priority_label"]).select("id", "_priority_label")


@query("b19_conditional_column_keep", "select id, case when status = 'active' then cast(id as varchar) end as _known from {role_rows}")
def _(t: Tables) -> DataFrame:
    return RULES.apply(t("role_rows"), ["priority_known"]).select("id", "_known")


@query("b19_conditional_column_drop", "select id, case when status = 'active' then 'a' else 'p' end as _strict from {role_rows} where status = 'active' or priority > 4")
def _(t: Tables) -> DataFrame:
    return RULES.apply(t("role_rows"), ["priority_strict"]).select("id", "_strict")


_CLASSES = """select id, 'Patient' as _user_class from {role_rows} where patient union all select id, 'Ansatt' from {role_rows} where ansatt
  union all select id, 'Frilanser' from {role_rows} where frilanser"""


@query("b20_row_multiplier", _CLASSES)
def _(t: Tables) -> DataFrame:
    return RULES.apply(t("role_rows"), ["user_class"]).select("id", "_user_class")


@query("b20_row_multiplier_keep", _CLASSES + " union all select id, cast(null as varchar) from {role_rows} where not patient and not ansatt and not frilanser")
def _(t: Tables) -> DataFrame:
    rule = RULES.rule("user_class")
    keep = Rule(rule.name, rule.kind, rule.conditions, rule.output, on_no_match="keep")
    return R.row_multiplier(t("role_rows"), keep, keys=["id", "_user_class"]).select("id", "_user_class")


@query("b21_rule_filter", "select id, status from {role_rows} where status = 'active' or status = 'pending'")
def _(t: Tables) -> DataFrame:
    return RULES.apply(t("role_rows"), ["valid_status"]).select("id", "status")


@query("b22_value_map", "select id, case status when 'active' then 'ACTIVE' when 'closed' then 'DELETED' else 'UNKNOWN' end as label from {role_rows}")
def _(t: Tables) -> DataFrame:
    return t("role_rows").select("id", X.value_map("status", {"active": "ACTIVE", "closed": "DELETED"}, "UNKNOWN").alias("label"))


@query(
    "b23_nested_decision",
    """select id, case when patient then (case when priority > 4 then 'CRITICAL' when priority > 2 then 'HIGH' else 'MEDIUM' end)
    else (case when priority > 2 then 'MEDIUM' else 'LOW' end) end as urgency from {role_rows}""",
)
def _(t: Tables) -> DataFrame:
    rule = Rule(
        "urgency",
        "conditional_column",
        [Condition("patient", "case when priority > 4 then 'CRITICAL' when priority > 2 then 'HIGH' else 'MEDIUM' end")],
        "urgency",
        on_no_match="default",
        default="case when priority > 2 then 'MEDIUM' else 'LOW' end",
    )
    return R.conditional_column(t("role_rows"), rule).select("id", "urgency")


@query(
    "b24_json_field",
    """select event_id, case when event_id % 3 = 0 then 'none' else coalesce(json_extract_string(props, '$.k'), 'none') end as k, 'none' as missing from {events}""",
)
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return t("events").select(
        "event_id", X.json_field(text, "$.k", "none").alias("k"), X.json_field("props", "$.absent", "none").alias("missing")
    )


@query(
    "b25_run_rules",
    """select id, case when priority > 3 then 'high' when priority > 1 then 'medium' else 'low' end as _priority_label, _user_class
    from (select * from {role_rows} where is_active) r join
    (select id as cid, _user_class from (""" + _CLASSES + """)) c on c.cid = r.id""",
)
def _(t: Tables) -> DataFrame:
    rules = [RULES.rule(n) for n in ("active_only", "priority_label", "user_class", "active_only")]
    return R.run_rules(t("role_rows"), rules).select("id", "_priority_label", "_user_class")


@query(
    "b25_run_route_rules",
    """select id, case when segment = 'BUILDING' then (case when priority > 3 then 'high' when priority > 1 then 'medium' else 'low' end) end as _priority_label
    from {role_rows} where segment <> 'MACHINERY' or is_active""",
)
def _(t: Tables) -> DataFrame:
    label, active = RULES.rule("priority_label"), RULES.rule("active_only")
    sink = lambda r: Rule(r.name, r.kind, r.conditions, r.output, r.output_type, r.on_no_match, r.default, "sink")
    rows = t("role_rows").withColumns({"__routing_schema": F.lit("t1"), "__routing_table": F.col("segment")})
    out = R.run_route_rules(rows, {("t1", "BUILDING"): [sink(label)], ("t1", "MACHINERY"): [sink(active)]})
    return out.select("id", "_priority_label")


@query(
    "b26_name_matches",
    """select db_name, regexp_matches(db_name, '(?i)_(dev|prod)$') or contains(lower(db_name), 'directory') as matched,
    regexp_full_match(db_name, 'svc1.*_dev') as globbed from {db_names}""",
)
def _(t: Tables) -> DataFrame:
    return t("db_names").select(
        "db_name",
        N.name_matches("db_name", ["_(DEV|PROD)$", "Directory", " "]).alias("matched"),
        N.glob_matches("db_name", "svc1*_dev").alias("globbed"),
    )


@query(
    "b27_extract_identifiers_shared",
    """select db_name, '' as customer,
    case when regexp_matches(db_name, '^\\w+_db_prod_special$') then regexp_replace(regexp_extract(db_name, '^(\\w+)_db_prod_special$', 1), 'n\\d+$', '')
      when regexp_matches(db_name, '^[a-z0-9]+_(dev|prod)$') then regexp_extract(db_name, '^([a-z0-9]+)_(dev|prod)$', 1)
      when regexp_matches(db_name, '^[a-z0-9]+_db_[a-z]+_[a-z]+$') then regexp_extract(db_name, '^([a-z0-9]+)_db_', 1)
      else db_name end as service,
    case when regexp_matches(db_name, '^\\w+_db_prod_special$') then 'prod_special'
      when regexp_matches(db_name, '_dev$') then 'development' when regexp_matches(db_name, '^[a-z0-9]+_prod$') then 'prod'
      when regexp_matches(db_name, '^[a-z0-9]+_db_[a-z]+_[a-z]+$') then regexp_extract(db_name, '_([a-z]+)$', 1)
      else server end as env
    from {db_names}""",
)
def _(t: Tables) -> DataFrame:
    patterns = [
        N.NamePattern(r"(?P<service>\w+)_db_prod_special$", env="prod_special", strip=[r"n\d+$"]),
        N.NamePattern(r"(?P<service>nothing)$", env="absent_from_regex"),
        N.NamePattern(r"(?P<service>[a-z0-9]+)_(?P<env>dev|prod)$", env_mapping={"dev": "development"}),
    ]
    out = N.extract_identifiers(t("db_names"), "shared", patterns, single=r"^(?P<service>[a-z0-9]+)_db_[a-z]+_(?P<env>[a-z]+)$")
    return out.select("db_name", "customer", "service", "env")


@query(
    "b27_extract_identifiers_per_tenant",
    """select db_name, case when db_name = 'svc3n1_dev' then 'Acme' when regexp_matches(db_name, '^svc\\d+n\\d+') then regexp_extract(db_name, '^svc\\d+n(\\d+)', 1) else db_name end as customer,
    'crm' as service, server as env from {db_names}""",
)
def _(t: Tables) -> DataFrame:
    out = N.extract_identifiers(
        t("db_names"), "per_tenant", single=r"svc\d+n(?P<customer>\d+)", overrides={"svc3n1_dev": " Acme "}, group="crm"
    )
    return out.select("db_name", "customer", "service", "env")


@query(
    "b27_infer_service",
    """select db_name, lower(case when contains(n, '_db_') and split_part(n, '_db_', 2) <> '' then split_part(n, '_db_', 2) else split_part(n, '_db_', 1) end) as service
    from (select db_name, regexp_replace(db_name, '(?:_dev|_prod|_test|_staging)$', '') as n from {db_names})""",
)
def _(t: Tables) -> DataFrame:
    return t("db_names").select("db_name", N.infer_service("db_name").alias("service"))


@query(
    "b28_select_tables",
    """select schema_name, table_name from {catalog_tables}
    where lower(table_name) not in ('t4') or schema_name <> 'dbo'
    except select schema_name, table_name from {catalog_tables} where schema_name = 'sales' and table_name = 'T9'""",
)
def _(t: Tables) -> DataFrame:
    return N.select_tables(t("catalog_tables"), [], ["t4", "Sales.t9", "T9"]).select("schema_name", "table_name")


@query(
    "b28_select_tables_tracked",
    "select schema_name, table_name from {catalog_tables} where (schema_name = 'sales' and table_name = 'T9') or table_name in ('T1', 'T3')",
)
def _(t: Tables) -> DataFrame:
    return N.select_tables(t("catalog_tables"), ["SALES.T9", "t1", "T3", "dbo.T9"]).select("schema_name", "table_name")


@query("b29_first_present", "select id, lower(trim(coalesce(status, name))) as shown from {role_rows}")
def _(t: Tables) -> DataFrame:
    return t("role_rows").select("id", X.first_present("status", "name", lower=True, default="").alias("shown"))


@query("b30_missing_fields", "select id, concat_ws(',', case when status is null then 'status' end, case when lead_name is null then 'lead_name' end) as missing from (select id, status, case when patient then name end as lead_name, name from {role_rows})")
def _(t: Tables) -> DataFrame:
    rows = t("role_rows").withColumn("lead_name", F.when(F.col("patient"), F.col("name")))
    return rows.select("id", F.array_join(X.missing_fields(["status", "name", "lead_name"]), ",").alias("missing"))


@query("b31_idempotency_key", "select event_id, substring(sha256(concat(cast(user_id as varchar), event_type, props)), 1, 32) as idempotency_key from {events}")
def _(t: Tables) -> DataFrame:
    return t("events").select("event_id", X.idempotency_key(["user_id", "event_type", "props"]).alias("idempotency_key"))


@query(
    "m1_rule_registry",
    "select id, status, case when priority > 3 then 'high' when priority > 1 then 'medium' else 'low' end as _priority_label from {role_rows} where status in ('active', 'pending')",
)
def _(t: Tables) -> DataFrame:
    return RULES.apply(t("role_rows"), ["valid_status", "priority_label"]).select("id", "status", "_priority_label")


@query("m2_register_expr", "select id, upper(name) as shout, balance > 0 as in_credit from {role_rows}")
def _(t: Tables) -> DataFrame:
    registry = R.RuleRegistry()
    registry.register_expr("shout", "upper(name)")
    registry.register_expr("in_credit", "balance > 0")
    return registry.with_expressions(t("role_rows"), ["shout", "in_credit"]).select("id", "shout", "in_credit")


_FUNCTIONS = FunctionCatalog.from_dicts(
    {
        "gross": {"parameters": {"net": "double", "rate": "double"}, "defaults": {"rate": "0.25D"}, "returns": "double", "body": "net * (1 + rate)"},
        "order_reports": {
            "parameters": {"price": "double", "status": "string"},
            "returns": {"report": "string", "place": "int"},
            "body": "SELECT col, pos FROM (SELECT posexplode(array_compact(array(if(price > 250000, 'large', null), if(status = 'O', 'open', null)))))",
        },
    }
)


@query("m2_sql_functions", "select id, balance * 1.25::double as gross, balance * (1 + priority / 10.0::double) as gross_by_priority from {role_rows}")
def _(t: Tables) -> DataFrame:
    _FUNCTIONS.load(t.spark)
    by_priority = _FUNCTIONS.call("gross", "balance", F.col("priority") / 10)
    return t("role_rows").select("id", _FUNCTIONS.call("gross", "balance").alias("gross"), by_priority.alias("gross_by_priority"))


@query(
    "m4_row_multiplying_function",
    """select o_orderkey, 'large' as report, 0 as place from {orders} where o_totalprice > 250000
    union all select o_orderkey, 'open', case when o_totalprice > 250000 then 1 else 0 end from {orders} where o_orderstatus = 'O'
    union all select o_orderkey, null, null from {orders} where not o_totalprice > 250000 and o_orderstatus <> 'O'""",
)
def _(t: Tables) -> DataFrame:
    _FUNCTIONS.load(t.spark)
    orders = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return _FUNCTIONS.spread(orders, "order_reports", "o_totalprice", "o_orderstatus", keep=True).select("o_orderkey", "report", "place")


@query("m4_row_multiplying_rule", "select o_orderkey, unnest(case when o_totalprice > 250000 then ['large', 'all'] else ['all'] end) as report from {orders}")
def _(t: Tables) -> DataFrame:
    rule = Rule(
        "reports",
        "row_multiplier",
        [Condition("o_totalprice > 250000", "'large'"), Condition("true", "'all'")],
        "report",
    )
    return R.row_multiplier(t("orders"), rule).select("o_orderkey", "report")
