from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefeed.operators import catalog as C
from changefeed.operators import registry as R
from changefeed.spec import Rule, TableSpec, Template
from tests.conftest import rows

CATALOG = "schema_name string, table_name string, ordinal int, column_name string, type_name string, nullable boolean, primary_key boolean, default_value string"


def catalog(spark, *columns):  # noqa: ANN001, ANN201
    """(table, column, type, nullable, key) in order."""
    data = [("dbo", t, i, c, ty, n, k, None) for i, (t, c, ty, n, k) in enumerate(columns)]
    return spark.createDataFrame(data, CATALOG)


@pytest.fixture
def before(spark):  # noqa: ANN001, ANN201
    return catalog(
        spark,
        ("Actor", "actno", "int", False, True),
        ("Actor", "Navn", "varchar(50)", True, False),
        ("Actor", "Epost", "varchar", True, False),
        ("Old", "id", "int", False, True),
    )


@pytest.fixture
def after(spark):  # noqa: ANN001, ANN201
    return catalog(
        spark,
        ("Actor", "actno", "bigint", False, True),
        ("Actor", "navn", "character varying(50)", False, True),
        ("Actor", "Mail", "varchar", True, False),
        ("New", "id", "int", False, True),
    )


def test_schema_diff(before, after):
    got = rows(C.schema_diff(after, before), "table_name", "kind", "column_name", "severity")
    assert got == sorted(
        [
            ("Actor", "column_added", "Mail", "info"),
            ("Actor", "column_added", "navn", "info"),
            ("Actor", "column_removed", "Epost", "warning"),
            ("Actor", "column_removed", "Navn", "warning"),
            ("Actor", "column_type_changed", "actno", "breaking"),
            ("New", "table_added", None, "info"),
            ("Old", "table_removed", None, "warning"),
        ],
        key=lambda t: tuple((v is not None, str(v)) for v in t),
    )
    assert C.schema_diff(before, before).count() == 0


def test_destructive_changes(before, after):
    got = {(r.kind, r.old_value, r.new_value) for r in C.destructive_changes(after, before).collect()}
    assert got == {
        ("COLUMN_REMOVED", None, None),
        ("COLUMN_TYPE_CHANGED", "int", "bigint"),
        ("COLUMN_NULLABILITY_CHANGED", "true", "false"),
        ("PRIMARY_KEY_CHANGED", "actno", "actno, navn"),
        ("POSSIBLE_RENAME_HINT", "Epost", "Mail"),
    }


def test_two_removed_columns_give_no_rename_hint(spark, before):
    new = catalog(spark, ("Actor", "actno", "int", False, True), ("Actor", "Mail", "varchar", True, False))
    kinds = [r.kind for r in C.destructive_changes(new, before).collect()]
    assert sorted(kinds) == ["COLUMN_REMOVED", "COLUMN_REMOVED"]


def test_drift_allows_missing_columns(before, after):
    assert rows(C.schema_drift(after, before), "column_name", "drift") == [("actno", "type")]


def test_keys(spark, before):
    keys, without = C.resolve_keys(before, tenant=True)
    assert rows(keys.filter("table_name = 'Actor'"), "key_position", "column_name") == [(0, "customer_id"), (1, "actno")]
    assert without.count() == 0
    none = catalog(spark, ("T", "a", "int", True, False))
    assert rows(C.resolve_keys(none, tenant=True)[1], "table_name") == [("T",)]
    declared = spark.createDataFrame([("dbo", "Actor", 2, "Navn"), ("dbo", "Actor", 1, "CUSTOMER_ID"), ("dbo", "Actor", 3, "navn")], "schema_name string, table_name string, ordinal int, column_name string")
    assert rows(C.resolve_keys(before, declared, tenant=True)[0].filter("table_name = 'Actor'"), "key_position", "column_name") == [
        (0, "customer_id"),
        (1, "Navn"),
    ]


def test_target_schema_adds_each_column_once(spark):
    spec = TableSpec(
        "Actor",
        ["actno"],
        ignore=["secret"],
        renames={"Navn": "name"},
        templates=[Template("_tenant", "string", "'t'", nullable=False), Template("ACTNO", "string", "''")],
        rules=[Rule("r", "filter", []), Rule("c", "conditional_column", [], "_label")],
    )
    columns = [("actno", "int", False), ("Navn", "nvarchar(50)", True), ("Secret", "text", True), ("changedt", "datetime", True), ("navn", "int", True)]
    schema = C.target_schema(columns, spec)
    assert schema.names[:6] == ["actno", "name", "changedt", "navn", "_tenant", "_label"]
    assert schema["actno"].dataType == T.IntegerType() and schema["changedt"].dataType == T.TimestampNTZType()
    assert not schema["customer_id"].nullable and schema.names[-1] == "__cdc_operation"
    assert "customer_id" not in C.target_schema(columns, spec, mode="brokered").names


def test_evolve_leaves_present_columns_alone(spark):
    df = spark.createDataFrame([(1,)], "Id int")
    out = C.evolve(df, T.StructType.fromDDL("id string, note string, n bigint"), {"n": 7})
    assert out.columns == ["Id", "note", "n"] and tuple(out.first()) == (1, None, 7)


def test_missing_keys_collapse_when_all_sources_miss_it(spark):
    t = spark.createDataFrame(
        [("a", "dev", "host", "x"), ("a", "prod", "port", "1"), ("b", None, "host", "x"), ("b", "dev", "port", "1"), ("c", None, "note", "x")],
        "source_name string, env string, key string, value string",
    )
    assert rows(C.missing_keys(t, "host")) == [("a", 1), ("c", 1)]
    assert rows(C.missing_keys(t, "nope")) == [(None, 4)]
    assert C.missing_keys(t.filter("source_name = 'b'"), "host").count() == 0


def test_custom_keys_take_the_first_row_even_if_blank(spark):
    dbs = spark.createDataFrame([("a",), ("b",), ("c",)], "db_name string")
    found = spark.createDataFrame([("a", 1, " cust-001 "), ("a", 2, "x"), ("b", 1, " "), ("b", 2, "y")], "db_name string, ord int, value string")
    values, warnings = C.custom_keys(dbs, found)
    assert rows(values) == [("a", "cust-001"), ("b", None), ("c", None)]
    assert rows(warnings, "db_name") == [("b",), ("c",)]


def test_overrides_fit_all_users_of_a_column(spark):
    usages = spark.createDataFrame([("t", "a", "integer"), ("t", "a", "bigint"), ("t", "b", None)], "source_table string, source_column string, sink_type string")
    got = rows(C.valid_overrides(usages, ["int", "bigint", "bit"]), "source_column", "override_type")
    assert got == [("a", "int"), ("b", "bigint"), ("b", "bit"), ("b", "int")]


def test_artifact_status(spark):
    current = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "artifact string, content string")
    history = current.select("artifact", F.sha2("content", 256).alias("checksum"), F.lit(1).alias("applied_at")).filter("artifact <> 'c'")
    tampered = current.withColumn("content", F.when(F.col("artifact") == "b", "changed").otherwise(F.col("content")))
    assert rows(C.artifact_status(tampered, history), "artifact", "status") == [("a", "applied"), ("b", "modified"), ("c", "pending")]


# --- Registry -----------------------------------------------------------------


def test_streaks_follow_a_running_counter(spark):
    import random

    rnd = random.Random(3)
    log, counter = [], {}
    for i in range(200):
        feed, failed, n = rnd.choice("abc"), rnd.random() < 0.4, rnd.choice((0, 0, 5))
        log.append((feed, "t", i, i // 5, n, failed))
        empty, failures = counter.get(feed, (0, 0))
        if failed:
            failures += 1
        else:
            failures, empty = 0, (empty + 1 if n == 0 else 0)
        counter[feed] = (empty, failures)
    pulls = spark.createDataFrame(log, "source_instance_key string, logical_table_name string, pull_id int, second int, rows_pulled int, failed boolean")
    pulls = pulls.withColumn("pulled_at", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, second)"))
    policy = spark.createDataFrame([], "source_instance_key string, logical_table_name string, base_poll_interval_seconds int")
    got = {r.source_instance_key: (r.empty_pull_streak, r.consecutive_failures) for r in R.feed_status(pulls, policy).collect()}
    assert got == counter


def test_no_pulls_means_no_tier_change(spark):
    now = F.expr("timestamp_ntz'2024-01-08 00:00:00'")
    tiers = spark.createDataFrame([("a", "t", "warm"), ("b", "t", "warm"), ("c", "t", "warm"), ("d", "t", "cool")], "source_instance_key string, logical_table_name string, effective_schedule_profile string")
    rollup = spark.sql(
        """select * from values ('a', 't', timestamp_ntz'2024-01-07 23:00:00', 10L, 8L), ('b', 't', timestamp_ntz'2024-01-07 23:00:00', 10L, 9L),
        ('d', 't', timestamp_ntz'2024-01-03 00:00:00', 5L, 0L) v(source_instance_key, logical_table_name, bucket_start, pulls_total, nonempty_pulls_total)"""
    )
    got = rows(R.evaluate_tiers(rollup, tiers, now), "source_instance_key", "effective_schedule_profile", "change")
    # Exactly 80 % is not more than 80 %.
    assert got == [("a", "warm", "unchanged"), ("b", "hot", "promoted"), ("c", "warm", "unchanged"), ("d", "cold", "demoted")]


def test_sync_gives_every_registration_all_its_states(spark):
    feed = "source_instance_key string, logical_table_name string"
    now = F.expr("timestamp_ntz'2024-01-08 00:00:00'")
    reg = spark.createDataFrame([("a", "t"), ("b", "t")], feed)
    none = F.lit(None)
    policy = reg.filter("source_instance_key = 'a'").withColumns(
        {
            "enabled": F.lit(True),
            "schedule_profile": F.lit("hot"),
            "tier_mode": F.lit("manual"),
            "manual_schedule_profile": none.cast("string"),
            **{c: none.cast("int") for c in [*R.PRESET_COLUMNS, "poll_priority"]},
            "config_version": F.lit(3).cast("bigint"),
        }
    )
    runtime = spark.createDataFrame([], feed + ", current_poll_interval_seconds int, next_pull_at timestamp_ntz")
    instances = spark.createDataFrame([("a", "ca"), ("b", "cb")], "source_instance_key string, customer_key string")
    customers = spark.createDataFrame([("ca", "1"), ("cb", "2")], "customer_key string, customer_id string")
    tiers = spark.createDataFrame([("a", "t", "cold", None, "evaluated")], feed + ", effective_schedule_profile string, previous_schedule_profile string, change_reason string")
    bootstrap = spark.createDataFrame([], feed + ", bootstrap_status string")
    checkpoints = spark.createDataFrame([("2", "t", "05", None)], "customer_id string, table_name string, last_start_lsn string, last_seqval string")
    out = R.sync_registrations(reg, policy, runtime, instances, customers, tiers, bootstrap, checkpoints, now)
    assert rows(out["policy"], "source_instance_key", "schedule_profile", "max_rows_per_pull", "config_version", "sync_action") == [
        ("a", "hot", 2000, 4, "updated"),
        ("b", "warm", 1000, 1, "inserted"),
    ]
    assert rows(out["tier"], "source_instance_key", "effective_schedule_profile", "previous_schedule_profile") == [("a", "hot", "cold"), ("b", "warm", None)]
    assert rows(out["runtime"], "source_instance_key", "current_poll_interval_seconds") == [("a", 1), ("b", 5)]
    assert rows(out["bootstrap"], "source_instance_key", "bootstrap_status") == [("a", "pending"), ("b", "completed")]
