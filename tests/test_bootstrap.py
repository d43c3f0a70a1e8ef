"""Bootstrap runs: who is loaded, what stays, what a repeated run and a feed without position give."""

from __future__ import annotations

from pyspark.sql import functions as F

from changefeed.operators import registry as R
from changefeed.plans.bootstrap import NO_POSITION, bootstrap_tables
from changefeed.plans.partitioned import PartitionedTarget
from tests.conftest import rows
from tests.test_partitioned import files

SCHEMA = "tenant string, id long, v string, __source_start_lsn string, __source_seqval string, __cdc_operation int, __source string"


def test_only_due_slices_are_loaded_and_control_tables_follow(spark, tmp_path):  # noqa: ANN001
    target = PartitionedTarget(spark, str(tmp_path), SCHEMA, ["id"], ["tenant"])
    old = [(t, i, "old", "01", "0", 2, "mssql_cdc") for t in ("a", "b", "c", "d", "e") for i in range(3)]
    target.replace(spark.createDataFrame(old, SCHEMA), [(t,) for t in "abcde"], "before")
    before = files(target)
    feed = lambda t: (f"src_{t}", "Orders")
    due = {"a": "eligible", "b": "eligible", "c": "eligible", "d": "skipped_active"}
    plan = spark.createDataFrame([(*feed(t), s) for t, s in due.items()], "source_instance_key string, logical_table_name string, result_status string")
    tenants = spark.createDataFrame([(f"src_{t}", t) for t in "abcde"], "source_instance_key string, tenant string")
    bounds = spark.createDataFrame([("a", "09", "5"), ("b", "08", None)], "tenant string, max_lsn string, max_seqval string")  # none of c
    snapshot = spark.createDataFrame([("a", 7, "new"), ("a", 8, "new"), ("d", 1, "new"), ("c", 1, "new")], "tenant string, id long, v string")
    checkpoints = spark.createDataFrame([("a", "orders", "02", "1"), ("d", "orders", "03", "1")], "tenant string, table_name string, last_start_lsn string, last_seqval string")
    states = spark.createDataFrame(
        [(*feed("a"), "failed", None, None, None, None, None, None, "earlier")],
        "source_instance_key string, logical_table_name string, bootstrap_status string, last_started_at timestamp_ntz, last_completed_at timestamp_ntz, "
        "last_failed_at timestamp_ntz, last_rows_loaded long, last_captured_start_lsn string, last_captured_seqval string, last_error string",
    )
    switches = spark.createDataFrame([(*feed(t), False, 1) for t in "abcde"], "source_instance_key string, logical_table_name string, enabled boolean, config_version int")
    for run_id in ("one", "one", "two"):  # repeated, and run again
        done = bootstrap_tables(target, snapshot, plan, tenants, bounds, checkpoints, states, switches.drop("config_version"), switches, "orders", F.expr("timestamp_ntz'2024-02-01'"), run_id)
        assert rows(done.results, "tenant", "rows_loaded", "start_lsn", "seqval", "error") == [("a", 2, "09", "5", None), ("b", 0, "08", None, None), ("c", 0, None, None, NO_POSITION)]
        assert rows(target.read(), "tenant", "id", "v", "__source_start_lsn") == sorted([(t, i, "old", "01") for t in "cde" for i in range(3)] + [("a", 7, "new", "09"), ("a", 8, "new", "09")])
    kept = {f: at for f, at in before.items() if any(f"tenant={t}" in f for t in "cde")}
    assert len(kept) >= 3 and kept.items() <= files(target).items()  # other tenants keep name and time of their files
    assert rows(done.checkpoints) == [("a", "orders", "09", "5"), ("b", "orders", "08", None), ("d", "orders", "03", "1")]
    assert rows(done.states, "source_instance_key", "bootstrap_status", "last_rows_loaded", "last_error") == [
        ("src_a", "completed", 2, None), ("src_b", "completed", 0, None), ("src_c", "failed", None, NO_POSITION)
    ]
    on = [("src_a", True, 2), ("src_b", True, 2), ("src_c", False, 1), ("src_d", False, 1), ("src_e", False, 1)]
    assert rows(done.policies, "source_instance_key", "enabled", "config_version") == on
    assert rows(done.registrations.where("enabled"), "source_instance_key") == [("src_a",), ("src_b",)]
    assert R.FEED == ["source_instance_key", "logical_table_name"]
