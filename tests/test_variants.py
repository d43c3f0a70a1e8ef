"""Envelopes without a schema: what is taken from them, and which drift they show."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from changefeed.sources import variants as V
from tests.conftest import rows


def message(table: str | None, row: str, op: str = "u") -> str:
    side = "before" if op == "d" else "after"
    return f'{{"payload": {{"op": "{op}", "{side}": {row}, "source": {{"table": {f"{chr(34)}{table}{chr(34)}" if table else "null"}, "db": "d", "ts_ms": 7}}}}}}'


@pytest.fixture
def messages(spark):  # noqa: ANN001, ANN201
    texts = [
        message("Orders", '{"id": 1, "note": "x", "total": 1.5}'),
        message("Orders", '{"id": 2, "note": null, "total": "a lot"}', "d"),
        message("Orders", '{"id": "three", "flag": 1, "tags": ["a"], "a b": true}', "c"),
        message("People", '{"id": null}'),
        message("People", "null"),
        message(None, '{"id": 9}'),
        "not json", None, "{}", '{"payload": 3}',
    ]
    return V.parse_variant(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string"))


def test_fields_by_path(messages):
    flat = V.unwrap_variant(messages, {"id": "int", "total": "double", "a b": "boolean"}, ["n"], F.lit("now"))
    assert rows(flat, "n", "id", "total", "a b", "__cdc_operation", "__source_table")[:4] == [
        (0, 1, 1.5, None, "UPDATE", "Orders"), (1, 2, None, None, "DELETE", "Orders"), (2, None, None, True, "INSERT", "Orders"), (3, None, None, None, "UPDATE", "People")
    ]
    assert flat.count() == 10 and flat.where("__source_ts_ms = 7 and __source_db = 'd' and __sync_timestamp = 'now'").count() == 6
    with pytest.raises(ValueError, match="quote"):
        V.field(F.col("payload"), "a'b", "int")


def test_columns_that_messages_hold(messages):
    assert rows(V.observed_columns(messages), "table_name", "column_name", "type_name", "n") == [
        ("Orders", "a b", "BOOLEAN", 1), ("Orders", "flag", "BIGINT", 1), ("Orders", "id", "VARIANT", 3), ("Orders", "note", "STRING", 2),
        ("Orders", "tags", "ARRAY<STRING>", 1), ("Orders", "total", "VARIANT", 2), ("People", "id", "VOID", 1),
    ]


def test_drift_between_messages_and_catalog(spark, messages):
    catalog = [("orders", "ID", "int"), ("orders", "note", "nvarchar(50)"), ("orders", "flag", "bit"), ("orders", "tags", "nvarchar(max)"), ("orders", "total", "decimal(9,2)"), ("orders", "lost", "date")]
    catalog += [("people", "id", "int"), ("silent", "id", "int")]
    found = V.message_drift(V.observed_columns(messages), spark.createDataFrame(catalog, "table_name string, column_name string, type_name string"))
    assert rows(found, "table_name", "column_name", "drift") == [("Orders", "a b", "undeclared"), ("orders", "ID", "type"), ("orders", "lost", "absent"), ("orders", "total", "type")]
    nothing = V.observed_columns(messages.where("false"))
    assert V.message_drift(nothing, spark.createDataFrame(catalog, "table_name string, column_name string, type_name string")).count() == 0
