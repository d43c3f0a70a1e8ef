from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from changefeed.operators import routing as R
from changefeed.sources import catalogs, feeds, topics
from tests.conftest import rows


@pytest.fixture
def topology(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(
        [
            ("directory", None, 0, "directory_id", "3"),
            ("directory", "dev", 1, "host", "h1"),
            ("directory", "prod", 2, "host", "h2"),
            ("activities", "dev", 1, "host", "h3"),
            ("activities", "prod", 2, "other", "x"),
        ],
        "source_name string, env string, ord int, key string, value string",
    )


def test_a_source_level_key_beats_an_environment(spark, topology):
    asked = spark.createDataFrame([("directory", "dev"), ("activities", "dev"), ("activities", "prod"), ("ghost", None)], "source_name string, env string")
    more = topology.union(spark.createDataFrame([("directory", "dev", 3, "directory_id", "99")], topology.schema))
    assert rows(R.lookup_source_key(asked, more, "directory_id"), "source_name", "env", "value")[0] == ("activities", "dev", None)
    assert ("directory", "dev", "3") in rows(R.lookup_source_key(asked, more, "directory_id"), "source_name", "env", "value")
    found = {(r.source_name, r.env): r for r in R.lookup_source_key(asked, topology, "host").collect()}
    assert found["activities", "dev"].value == "h3" and found["activities", "dev"].error is None
    assert found["activities", "prod"].error == "key host not found for activities.prod"
    assert found["ghost", None].error is not None


def test_explicit_targets_must_exist_and_aliases_have_an_order(spark):
    targets = spark.createDataFrame([("s", "dev"), ("s", "stage")], "sink string, target_env string")
    routes = spark.createDataFrame(
        [("s", "default", None), ("s", "stage", None), ("s", "nonprod", " stage "), ("s", "dev", "does_not_exist"), ("s", "prod", None), ("s", "dev", "")],
        "sink string, env string, target_sink_env string",
    )
    got = {(r.env, r.target_sink_env): (r.resolved_env, r.error) for r in R.resolve_env(routes, targets).collect()}
    assert got["default", None] == ("dev", None)
    assert got["stage", None] == ("stage", None)
    assert got["nonprod", " stage "] == ("stage", None)
    assert got["dev", "does_not_exist"] == (None, "invalid target environment does_not_exist")
    assert got["prod", None] == (None, "no sink environment for prod")
    assert got["dev", ""][0] is None


def test_a_bad_key_leaves_the_route_out_and_says_why(spark, topology):
    tenants = spark.createDataFrame([("svc", "directory", "dev", "dev.d"), ("svc", "activities", "dev", "dev.a")], "service string, source_name string, env string, topic_prefix string")
    tables = spark.createDataFrame([("svc", "dbo", "Actor"), ("svc", "dbo", "Role"), ("other", "dbo", "X")], "service string, schema_name string, table_name string")
    routes, skipped = R.build_routes(tenants, tables, topology, "directory_id")
    assert rows(routes, "topic", "schema_name", "target") == [
        ("dev.d.dbo.Actor", "directory", "directory.stg_Actor"),
        ("dev.d.dbo.Role", "directory", "directory.stg_Role"),
    ]
    assert rows(skipped, "source_name", "reason") == [("activities", "key directory_id not found for activities.dev")] * 2
    empty = topology.union(spark.createDataFrame([("activities", None, 0, "directory_id", " None ")], topology.schema))
    assert rows(R.build_routes(tenants, tables, empty, "directory_id")[1], "reason") == [("key directory_id is empty for activities",)] * 2


def test_the_routes_of_one_large_service_are_made_by_several_tasks(spark):
    given = lambda n, *columns: spark.range(0, n, 1, 1).selectExpr(*columns)
    tenants = given(30, "'s' as service", "concat('T', id) as source_name", "'dev' as env", "concat('dev.t', id) as topic_prefix")
    tenants = tenants.unionAll(given(1, "null", "'Lost'", "'dev'", "'x'")).unionAll(given(1, "'none'", "'Bare'", "'dev'", "'x'")).coalesce(1)
    tables = given(6000, "'s' as service", "if(id % 2 = 0, 'dbo', null) as schema_name", "concat('Tab', id div 2) as table_name")
    tables = tables.unionAll(given(1, "'s'", "'dbo'", "'Tab1'")).unionAll(given(1, "null", "'dbo'", "'Lost'")).coalesce(1)
    keys = given(30, "concat('T', id) as source_name", "'dev' as env", "'customer_id' as key", "if(id % 10 = 0, ' ', concat('c', id)) as value")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        routes, skipped = R.build_routes(tenants, tables, keys)
        tasks = routes.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
        assert sum(r["count"] for r in tasks) == 27 * 6001 and max(r["count"] for r in tasks) < 0.8 * 27 * 6001
        pairs = tenants.join(tables, "service").where("source_name not in ('T0', 'T10', 'T20')").select(F.concat_ws(".", "topic_prefix", "schema_name", "table_name").alias("topic"))
        assert routes.select("topic").exceptAll(pairs).count() == pairs.exceptAll(routes.select("topic")).count() == 0
        assert skipped.count() == 3 * 6001 and skipped.where("reason is null or table_name is null").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_unknown_routes_are_split_off_and_rows_never_multiply(spark):
    df = spark.createDataFrame([(1, "a", "T"), (2, "a", "U"), (3, None, "T")], "id int, __routing_schema string, __routing_table string")
    routes = spark.createDataFrame([("a", "T", "x"), ("a", "T", "x2")], "schema_name string, table_name string, target string")
    good, bad = R.split_routes(df, routes)
    assert rows(good, "id", "target") == [(1, "x")]
    assert rows(bad, "id") == [(2,), (3,)]


def test_dead_letters(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, n int")
    checks = {"timeout reading n": "n is not null", "n is negative": "n >= 0"}
    good, retry, dead = R.split_dead_letters(df, checks, F.lit("now"))
    assert rows(good) == [(1, 5)]
    assert rows(retry, "id", "error", "failed_at") == [(3, "timeout reading n", "now")]
    assert rows(dead, "id", "error") == [(2, "n is negative")]


def test_collisions_list_every_route(spark):
    base = ("k", "grp", False, None, False)
    routes = spark.createDataFrame(
        [(*base, "a", "dev", "t", "1"), (*base, "b", "dev", "t", " 1 "), (*base, "c", "dev", "t", "2"), (*base, "d", "dev", "t", "None"), ("k2", "grp", True, "qa", False, "a", "dev", "t", "1")],
        "sink string, source_group string, sink_env_aware boolean, target_sink_env string, target_known boolean, source_name string, env string, template string, value string",
    )
    assert rows(R.unique_collisions(routes), "value", "route", "route_count") == [("1", "a.dev", 2), ("1", "b.dev", 2)]
    assert rows(R.unique_missing(routes), "route") == [("d.dev",)]


def test_match_sinks(spark):
    sources = spark.createDataFrame([("Actor",), ("Role",)], "table_name string")
    sinks = spark.createDataFrame(
        [("public.first", "dbo.actor", 1), ("public.ACTOR", "dbo.Actor", 2), ("public.last", "Actor", 3), ("x.r1", "dbo.Role", 4), ("x.r2", "dbo.role", 5), ("x.none", None, 6)],
        "sink_table string, from_table string, ord int",
    )
    assert rows(R.match_sinks(sources, sinks)) == [("Actor", "public.ACTOR"), ("Role", "x.r2")]
    assert R.match_sinks(sources, sinks, collect_all=True).count() == 5


def test_tenants_prefer_the_first_environment(spark):
    t = spark.createDataFrame(
        [("Test", None, 0, "customer_id", "top"), ("Test", "dev", 1, "customer_id", None), ("Test", "prod", 2, "customer_id", "p"), ("B", None, 0, "customer_id", "b"), (" ", None, 0, "customer_id", "x"), ("C", "dev", 1, "server", "s")],
        "source_name string, env string, ord int, key string, value string",
    )
    assert rows(R.tenants(t), "name", "customer_id") == [("b", "b"), ("c", None), ("test", "p")]


def test_enrich_keeps_one_row_per_row(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    table = spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    assert rows(R.enrich(df, table, ["k"])) == [(1, "a"), (2, None)]


def test_envelope_round_trip_of_deletes_and_malformed_text(spark):
    data = spark.createDataFrame([], "id int, v string").schema
    messages = spark.createDataFrame(
        [('{"payload":{"op":"d","before":{"id":1,"v":"x"},"after":null,"source":{"table":"T","db":"d"}}}',), ("{broken",)], "value string"
    )
    flat = feeds.unwrap_envelope(feeds.parse_envelope(messages, data))
    assert rows(flat, "id", "v", "__cdc_operation") == [(None, None, "UNKNOWN"), (1, "x", "DELETE")]


def test_topic_options():
    options = topics.topic_options("b:9092", ["a", "b"], max_per_trigger=100)
    assert options["subscribe"] == "a,b" and options["startingOffsets"] == "earliest" and options["maxOffsetsPerTrigger"] == "100"
    assert topics.topic_options("b:9092", pattern="x.*", from_oldest=False)["startingOffsets"] == "latest"
    with pytest.raises(ValueError, match="either"):
        topics.topic_options("b:9092")


def test_a_partitioned_read_needs_bounds(spark):
    with pytest.raises(ValueError, match="bounds"):
        catalogs.read_jdbc(spark, "jdbc:x", "t", partition_column="id")


def test_a_database_without_counted_tables_stays_in_the_inventory(spark):
    tables = spark.createDataFrame(
        [("a", "s", "dbo", "T1", "BASE TABLE"), ("a", "s", "sys", "T2", "BASE TABLE"), ("b", "s", "sys", "T3", "BASE TABLE"), ("Master", "s", "dbo", "T", "BASE TABLE")],
        "db_name string, server string, schema_name string, table_name string, table_type string",
    )
    out = catalogs.inventory(tables, catalogs.InventoryFilters(schemas_excluded=["sys"]))
    assert rows(out, "db_name", "schema_count", "table_count") == [("a", 1, 1), ("b", 0, 0)]


def test_dropped_rows_are_counted_while_they_pass(spark, tmp_path):
    from pyspark.sql import Observation

    df = spark.createDataFrame([(1, "a", "T"), (2, "a", "U"), (3, None, "T")], "id int, __routing_schema string, __routing_table string")
    routes = spark.createDataFrame([("a", "T", "x")], "schema_name string, table_name string, target string")
    seen = Observation()
    R.flag_routes(df, routes, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"routed": 1, "dropped": 2}
    R.write_routes(R.route_by(df, [("id = 1", "one")], "rest"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("route = 'rest'").count() == 2
