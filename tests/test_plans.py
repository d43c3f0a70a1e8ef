"""Shapes of physical plans: nothing that stops scaling slips in."""

from __future__ import annotations

import os

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from changefeed.operators.apply import apply_changes
from changefeed.sources.feeds import scan_changes
from queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")

STREAMS = {"i1_stream_changes", "i2_stream_checkpoints", "i3_stream_apply", "i5_stream_rollup", "i6_dedupe_stream", "i7_latest_state", "h13_stream_log", "a16_fan_out"}


def plan(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_joins_and_no_python_in_plans(spark, name):  # noqa: ANN001
    text = plan(entry.queries()[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert operator not in text, operator


def test_a_cursor_reaches_the_scan(spark, tmp_path):  # noqa: ANN001
    spark.range(10).selectExpr("id", "2 as op_code", "lpad(id, 20, '0') as start_lsn", "'0' as seqval").write.parquet(str(tmp_path / "f"))
    text = plan(scan_changes(spark.read.parquet(str(tmp_path / "f")), "00000000000000000005", limit=3))
    assert "GreaterThanOrEqual(start_lsn" in text and "In(op_code" in text
    assert "TakeOrderedAndProject" in text


def test_only_used_columns_are_read(spark):  # noqa: ANN001
    text = plan(entry.queries()["d2_batch_counts"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint>" in text


def test_a_staged_small_batch_leaves_the_target_unshuffled(spark, tmp_path):  # noqa: ANN001
    """The estimate of a joined batch is the product of its sides; staged, its true size plans the merge."""
    spark.range(200_000).selectExpr("id as k", "'old' as v", "'00' as start_lsn", "'00' as seqval").write.parquet(str(tmp_path / "t"))
    spark.range(100).selectExpr("id as k", "'new' as v", "4 as op_code", "'01' as start_lsn", "'00' as seqval").write.parquet(str(tmp_path / "b"))
    spark.range(50_000).selectExpr("id as j", "repeat('x', 20) as w").write.parquet(str(tmp_path / "o"))
    read = spark.read.parquet
    batch = read(str(tmp_path / "b")).join(read(str(tmp_path / "o")).where("w like 'x%'"), F.col("k") == F.col("j")).drop("j", "w")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        merged = apply_changes(read(str(tmp_path / "t")), batch, ["k"], stage=True)
        rows = merged.groupBy("v").count().collect()
        merged.collect()
        final = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r.v, r["count"]) for r in rows} == {("old", 199_900), ("new", 100)}
    assert "SortMergeJoin" not in final and "hashpartitioning" not in final



def test_latest_per_key_aggregates_before_its_shuffle(spark):  # noqa: ANN001
    text = plan(entry.queries()["e2_latest_per_key_native"](spark, SF))
    assert "partial_max_by" in text and text.count("Exchange hashpartitioning") == 1
