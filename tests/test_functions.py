from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from changefeed.functions import expressions as X
from changefeed.functions import names as N
from changefeed.functions import types as Y
from changefeed.operators import columns as C
from changefeed.spec import TableSpec, Template
from tests.conftest import rows


def one(spark, column):  # noqa: ANN001, ANN201
    return spark.range(1).select(column.alias("x")).first()[0]


def test_decode_op_unlisted_code_is_an_insert_unless_strict(spark):
    df = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 9, None)], "c int")
    assert [r[0] for r in df.select(X.decode_op("c")).collect()] == ["d", "c", "c", "u", "c", "c"]
    assert [r[0] for r in df.select(X.decode_op("c", strict=True)).collect()] == ["d", "c", None, "u", None, None]


def test_op_name(spark):
    df = spark.createDataFrame([(c,) for c in ("d", "c", "u", "r", None)], "c string")
    assert [r[0] for r in df.select(X.op_name("c")).collect()] == ["DELETE", "INSERT", "UPDATE", "UNKNOWN", "UNKNOWN"]
    assert df.select(X.op_name("c", snapshots=True)).collect()[3][0] == "READ"


def test_message_key_keeps_the_place_of_null_parts(spark):
    df = spark.createDataFrame([(1, None, "b")], "a int, n string, b string")
    assert df.select(X.message_key(["a", "n", "b"])).first()[0] == "1||b"


def test_identifiers(spark):
    assert one(spark, X.normalize_identifier(F.lit("Ærlig Åse Bjørn"))) == "AErlig Ase Bjorn"
    assert one(spark, X.safe_identifier(F.lit("--My Shop/Test__"))) == "My_Shop_Test"
    assert one(spark, X.safe_identifier(F.lit("--"))) == "unnamed"


def test_row_hash_ignores_column_order_and_sees_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    h1, h2 = df.select(X.row_hash(["a", "b"]), X.row_hash(["b", "a"])).first()
    assert h1 == h2 != df.select(X.row_hash(["a"])).first()[0]


def test_json_field_falls_back_on_bad_json(spark):
    df = spark.createDataFrame([('{"email": "a@b"}',), ("{oops",), (None,), ('{"email": null}',)], "j string")
    got = [r[0] for r in df.select(X.json_field("j", "$.email", "none")).collect()]
    assert got == ["a@b", "none", "none", "none"]


@pytest.mark.parametrize(
    ("source", "target"),
    [
        ("uniqueidentifier", "uuid"),
        ("BIGINT", "bigint"),
        ("nvarchar(50)", "varchar"),
        ("Decimal (18, 2)", "numeric"),
        ("mystery", "text"),
        ("timestamp", "bytea"),
    ],
)
def test_map_type(spark, source, target):
    assert one(spark, Y.map_type(F.lit(source))) == target
    assert Y.map_type_name(source) == target


def test_reverse_mapping_keeps_the_first():
    back = Y.reverse_mapping(Y.MSSQL_TO_PG)
    assert back["numeric"] == "decimal" and back["smallint"] == "tinyint"


@pytest.mark.parametrize(
    ("source", "sink", "fits"),
    [
        ("int", "integer", True),
        ("integer", "int8", True),
        ("bigint", "integer", False),
        ("uniqueidentifier", "uuid", True),
        ("uniqueidentifier", "varchar(36)", True),
        ("nvarchar(10)", "boolean", False),
        ("datetime", "timestamptz", True),
    ],
)
def test_compatible(spark, source, sink, fits):
    assert one(spark, Y.compatible(F.lit(source), F.lit(sink))) is fits


def test_pg_fallback_map(spark):
    assert one(spark, Y.compatible(F.lit("int4"), F.lit("bigint"), Y.PG_PG))
    assert not one(spark, Y.compatible(F.lit("bigint"), F.lit("int4"), Y.PG_PG))


def test_mapping_accepts_text_sinks(spark):
    assert one(spark, Y.mapping_accepts(F.lit("uuid"), F.lit("citext")))
    assert not one(spark, Y.mapping_accepts(F.lit("uuid"), F.lit("integer")))


def test_name_matches(spark):
    df = spark.createDataFrame([("Sales_DEV",), ("master",), ("a[b",)], "n string")
    got = [r[0] for r in df.select(N.name_matches("n", ["_dev$", "A[B", " "])).collect()]
    assert got == [True, False, True]  # an invalid regex is a substring
    assert [r[0] for r in df.select(N.name_matches("n", [])).collect()] == [False] * 3
    assert [r[0] for r in df.select(N.name_matches("n", [], when_empty=True)).collect()] == [True] * 3
    assert [r[0] for r in df.select(N.glob_matches("n", "m?ster")).collect()] == [False, True, False]


def test_extraction_patterns(spark):
    patterns = [
        N.NamePattern(r"^(?P<service>\w+)_db_prod_west$", env="prod_west", strip=["_db$"]),
        N.NamePattern(r"^(?P<service>\w+)_(?P<env>\w+)$"),
        N.NamePattern(r"^(?P<service>\w+)$"),
    ]
    df = spark.createDataFrame(
        [("auth_db_prod_west", "prod"), ("myservice_dev", "default"), ("auth", "prod"), ("---", "x")], "db_name string, server string"
    )
    got = rows(N.extract_identifiers(df, "shared", patterns), "db_name", "service", "env")
    assert got == [
        ("---", "---", "x"),
        ("auth", "auth", "prod"),
        ("auth_db_prod_west", "auth", "prod_west"),
        ("myservice_dev", "myservice", "dev"),
    ]


@pytest.mark.parametrize(
    ("name", "service"),
    [("activities_db_dev", "activities_db"), ("crm_db_directory_dev", "directory"), ("auth_dev", "auth"), ("Plain", "plain"), ("a_db_", "a")],
)
def test_infer_service(spark, name, service):
    assert one(spark, N.infer_service(F.lit(name))) == service


def test_feed_name(spark):
    df = spark.createDataFrame([("dbo", "Actor"), ("dbo", "role"), ("hr", "Role"), ("hr", "Pay Roll")], "schema_name string, table_name string")
    assert [r[0] for r in N.feed_name(df).orderBy("schema_name", "table_name").select("feed_name").collect()] == [
        "Actor_CT",
        "dbo_role_CT",
        "hr_Pay_Roll_CT",
        "hr_Role_CT",
    ]


def test_prune_keeps_keys_and_ignores_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Id int, A int, b int")
    assert C.prune_columns(df, include=["B"], keys=["id"]).columns == ["Id", "b"]
    assert C.prune_columns(df, include=["a", "b"], ignore=["A"]).columns == ["b"]
    assert C.prune_columns(df, include=["a"], ignore=["b"], mode="ignore_first").columns == ["Id", "A"]


def test_dedupe_columns():
    assert C.dedupe_columns(["Navn", "id", "navn", "ID"]) == ["Navn", "id"]


def test_templates_skip_existing_columns_and_report_unknown_names(spark):
    df = spark.createDataFrame([(1, "x")], "id int, _tenant_id string")
    out = C.apply_templates(df, ["tenant_id", Template("double_id", "bigint", "id * 2")], {}, {"TENANT_ID": "t"})
    assert tuple(out.first()) == (1, "x", 2)
    with pytest.raises(KeyError, match="known: .*row_hash"):
        C.apply_templates(df, ["nope"], {})


@pytest.mark.parametrize("value", ["", " ", "null", "None"])
def test_an_empty_source_reference_is_an_error(spark, value):
    with pytest.raises(ValueError, match="empty"):
        C.template_value("source_ref", value, {})


def test_an_unset_environment_variable_is_an_error(spark):
    with pytest.raises(ValueError, match="ENVIRONMENT"):
        C.template_value("env", "${ENVIRONMENT}", {}, {})


def test_lenient_cast_gives_null(spark):
    df = spark.createDataFrame([("12",), ("x",)], "n string")
    assert [r[0] for r in C.cast_to_target(df, {"n": "int"}, lenient=True).collect()] == [12, None]


def test_a_spec_needs_keys():
    with pytest.raises(ValueError, match="key"):
        TableSpec("t", [])


def test_sql_functions_of_a_catalog(spark):
    from changefeed.functions.catalog import FunctionCatalog

    catalog = FunctionCatalog.from_dicts(
        {
            "scaled": {"parameters": {"x": "int", "by": "int"}, "defaults": {"by": "10"}, "returns": "int", "body": "x * by"},
            "letters": {"parameters": {"word": "string"}, "returns": {"letter": "string"}, "body": "SELECT explode(filter(split(word, ''), c -> c <> ''))"},
        }
    )
    catalog.load(spark)
    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "n int, odd word string".replace("odd word", "`odd word`"))
    assert [r[0] for r in df.select(catalog.call("scaled", "n")).collect()] == [10, 20, 30]
    assert [r[0] for r in df.select(catalog.call("scaled", F.col("n") + 1, F.lit(2))).collect()] == [4, 6, 8]
    assert sorted((r.n, r.letter) for r in catalog.spread(df, "letters", "odd word").collect()) == [(1, "a"), (1, "b")]
    kept = sorted((r.n, r.letter or "") for r in catalog.spread(df, "letters", "odd word", keep=True).collect())
    assert kept == [(1, "a"), (1, "b"), (2, ""), (3, "")]
    with pytest.raises(KeyError, match="letters, scaled"):
        catalog.call("nope")
    with pytest.raises(TypeError, match="takes x, by; 3 arguments"):
        catalog.call("scaled", "n", "n", "n")
    with pytest.raises(TypeError, match="gives rows"):
        catalog.call("letters", "n")
    with pytest.raises(ValueError, match="is not a name"):
        FunctionCatalog.from_dicts({"a b": {"returns": "int", "body": "1"}}).load(spark)
    with pytest.raises(Exception, match="no_such_column"):
        FunctionCatalog.from_dicts({"bad": {"returns": "int", "body": "no_such_column + 1"}}).load(spark)


def test_case_insensitive_text_compares_without_case(spark):
    from changefeed.operators.apply import apply_changes, latest_per_key
    from changefeed.operators.columns import cast_to_target

    schema = "k string, v string, op_code int, start_lsn string, seqval string"
    batch = cast_to_target(spark.createDataFrame([("aB", "1", 4, "02", "0"), ("AB", "2", 4, "03", "0"), ("straße", "3", 2, "01", "0"), (None, "4", 2, "01", "0")], schema), {"k": "citext"})
    target = cast_to_target(spark.createDataFrame([("ab", "0", "01", "0"), ("c", "0", "01", "0")], "k string, v string, start_lsn string, seqval string"), {"k": "CiText"})
    for guard in (False, True):
        merged = apply_changes(target, batch.where("k is not null"), ["k"], guard=guard)
        assert sorted((r.k, r.v) for r in merged.collect()) == [("AB", "2"), ("c", "0"), ("straße", "3")]
    assert latest_per_key(batch, ["k"], ["start_lsn"]).count() == 3
    assert batch.select("k").distinct().count() == 3 and batch.where("k = 'Ab'").count() == 2


def test_joins_on_null_keys_keep_their_rows(spark):
    from changefeed.functions.names import feed_name
    from changefeed.operators.routing import unique_collisions

    left = spark.createDataFrame([(1, None, "a"), (None, None, "b"), (2, "x", "c")], "k int, s string, v string")
    right = spark.createDataFrame([(1, None, 10), (None, None, 20), (None, "x", 30)], "k int, s string, n int")
    assert rows(X.join_nulls(left, right, ["k", "s"]), "v", "n") == [("a", 10), ("b", 20)]
    assert rows(X.join_nulls(left, right, ["k", "s"], "left"), "v", "n") == [("a", 10), ("b", 20), ("c", None)]
    names = spark.createDataFrame([("dbo", "T"), ("dbo", None)], "schema_name string, table_name string")
    assert feed_name(names).count() == 2
    routes = "sink string, source_group string, sink_env_aware boolean, source_env_aware boolean, target_sink_env string, target_known boolean, source_name string, env string, template string, value string"
    two = spark.createDataFrame([("s", "g", True, False, "dev", True, n, "dev", None, "same") for n in ("a", "b")], routes)
    assert unique_collisions(two).count() == 2
