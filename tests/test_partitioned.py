"""Targets in tenant partitions: batches, replays, crashes between the steps of a merge, and streams into many of them."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from changefeed.operators.routing import flag_routes
from changefeed.plans.partitioned import PartitionedTarget
from changefeed.streaming import sinks as SK
from changefeed.streaming import streams as S
from tests.conftest import rows
from tests.test_apply import BATCH, changes, model

TARGET = "tenant string, k int, v string, start_lsn string, seqval string"


def target_in(spark, folder) -> PartitionedTarget:  # noqa: ANN001
    return PartitionedTarget(spark, str(folder), TARGET, ["k"], ["tenant"])


def frame(spark, data):  # noqa: ANN001, ANN201
    """Changes whose tenant follows from the key."""
    return spark.createDataFrame(data, BATCH).withColumn("tenant", F.concat(F.lit("t "), F.col("k") % 3))


def state(target: PartitionedTarget) -> dict:
    return {r.k: (r.v, r.start_lsn, r.seqval) for r in target.read().collect()}


def files(target: PartitionedTarget) -> dict[str, dict]:
    out: dict[str, dict] = {}
    for folder, _, names in os.walk(target.path):
        out |= {f"{folder}/{n}": os.stat(f"{folder}/{n}").st_mtime_ns for n in names if n.startswith("part-")}
    return out


def test_batches_replays_and_deletes(spark, tmp_path):  # noqa: ANN001
    data = sorted(changes(120, 15, 8), key=lambda r: (r[3], r[4]))
    target = target_in(spark, tmp_path)
    assert target.read().count() == 0
    for i, part in enumerate((data[:60], data[60:])):
        target.merge(frame(spark, part), i)
    assert state(target) == model({}, data)
    target.merge(frame(spark, data[:60]), 2)  # delivered again under another number, deletes included
    assert state(target) == model({}, data)
    assert "t 0" in {r.tenant for r in target.read().collect()}
    target.merge(frame(spark, data).where("false"), 3)
    target.merge(frame(spark, data).withColumn("tenant", F.lit(None).cast("string")), 4)  # rows of no partition
    assert state(target) == model({}, data)


def test_untouched_partitions_keep_their_files(spark, tmp_path):  # noqa: ANN001
    target = target_in(spark, tmp_path)
    target.merge(frame(spark, [(k, "a", 2, "01", "0") for k in range(9)]), 0)
    before = files(target)
    target.merge(frame(spark, [(3, "b", 4, "02", "0")]), 1)
    kept = {f: at for f, at in before.items() if "t 0" not in f and "t%200" not in f}
    assert len(kept) < len(before) and kept.items() <= files(target).items()
    plan = target.stored().where(target._within([("t 0",)]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tenant" in plan or "PartitionFilters: [tenant" in plan


def test_a_crash_before_or_after_the_swap_is_mended_by_the_same_batch(spark, tmp_path, monkeypatch):  # noqa: ANN001
    target, batch = target_in(spark, tmp_path), [(1, "b", 4, "02", "0"), (2, None, 1, "02", "1"), (7, "n", 2, "02", "2")]
    target.merge(frame(spark, [(k, "a", 2, "01", "0") for k in range(6)]), 0)
    old = state(target)

    def crash(self, name) -> None:  # noqa: ANN001
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(PartitionedTarget, "_swap", crash)
        with pytest.raises(RuntimeError, match="killed"):
            target.merge(frame(spark, batch), 1)
    assert state(target) == old  # nothing is half done
    # A swap that was cut off may have lost a partition's files; the contents written for it bring them back.
    for f in files(target):
        if "t%201" in f or "t 1" in f:
            os.remove(f)
    for _ in range(2):
        target.merge(frame(spark, batch), 1)
        assert state(target) == {k: v for k, v in old.items() if k != 2} | {1: ("b", "02", "0"), 7: ("n", "02", "2")}
    target.forget(1)
    assert not os.path.exists(f"{target.root}/next/1")


def test_replaced_slices(spark, tmp_path):  # noqa: ANN001
    target = target_in(spark, tmp_path)
    target.merge(frame(spark, [(k, "a", 2, "01", "0") for k in range(9)]), 0)
    before = files(target)
    fresh = spark.createDataFrame([("t 0", 3, "s", "05", "0"), ("t 2", 5, "not asked for", "05", "0")], TARGET)
    for _ in range(2):
        assert target.replace(fresh, [("t 0",), ("t 1",)], "load") == 1
        assert rows(target.read(), "k", "v") == [(2, "a"), (3, "s"), (5, "a"), (8, "a")]
    untouched = {f: at for f, at in before.items() if "t%202" in f or "t 2" in f}
    assert untouched and untouched.items() <= files(target).items()
    assert target.replace(fresh, [], "none") == 0


@pytest.mark.parametrize("mode", ["hard", "soft"])
def test_stream_with_restarts_positions_and_log(spark, tmp_path, mode):  # noqa: ANN001
    data = sorted(changes(120, 15, 8), key=lambda r: (r[3], r[4]))
    target = target_in(spark, tmp_path / "t")

    def run() -> None:
        stream = S.stream_changes(spark, str(tmp_path / "in"), BATCH, max_per_trigger=1).withColumn("tenant", F.concat(F.lit("t "), F.col("k") % 3))
        log = lambda b: b.groupBy("tenant").agg(F.count("*").alias("records_processed"))
        SK.stream_apply(stream, target, str(tmp_path / "state"), mode=mode, feed=["tenant"], log=log, period=None).awaitTermination()

    for part in (data[:60], data[60:]):
        spark.createDataFrame(part, BATCH).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()  # each start is a restart from the same state folder
    assert state(target) == model({}, data, mode)
    notes = SK.batch_log(target)
    top = {r.tenant: (r.last_start_lsn, r.last_seqval) for r in notes.checkpoints(["tenant"]).collect()}
    assert top == {f"t {i}": max((r[3], r[4]) for r in data if r[0] % 3 == i) for i in range(3)}
    assert notes.get("log").agg(F.sum("records_processed")).first()[0] == 120
    before = files(target)
    run()
    assert files(target) == before  # nothing new, nothing written


ROUTED = "__routing_schema string, __routing_table string, k int, v string, __cdc_operation string, start_lsn string, seqval string"


def test_routed_sink_after_a_crash_between_two_targets(spark, tmp_path, monkeypatch):  # noqa: ANN001
    shape = "__routing_schema string, k int, v string, __cdc_operation string, start_lsn string, seqval string"
    data = [(f"s{i % 2}", t, i, f"{t}{i}", "UPDATE", f"{i:02d}", "0") for i in range(6) for t in ("a", "b", "gone")]
    data += [("elsewhere", "a", 1, "x", "INSERT", "01", "0"), (None, "a", 1, "x", "INSERT", "01", "0"), ("s0", "a", 0, "a0", "UPDATE", "00", "0")]
    spark.createDataFrame(data, ROUTED).coalesce(1).write.parquet(str(tmp_path / "in"))
    routes = spark.createDataFrame([(s, t, "x") for s in ("s0", "s1") for t in ("a", "b", "other")] * 2, "schema_name string, table_name string, target string")
    tables = {t: SK.RoutedTable(PartitionedTarget(spark, str(tmp_path / t), shape, ["k"], ["__routing_schema"])) for t in ("a", "b")}
    warned: list[int] = []
    listener = SK.RouteCounts(warned.append)
    merge = PartitionedTarget.merge

    def run() -> None:
        stream = S.stream_changes(spark, str(tmp_path / "in"), ROUTED, max_per_trigger=1)
        SK.routed_apply(stream, routes, tables, str(tmp_path / "state"), order=("start_lsn", "seqval"), period=None).awaitTermination()

    def fails_on_b(self, *args, **how) -> None:  # noqa: ANN001, ANN002, ANN003
        if self.root.endswith("b"):
            raise RuntimeError("killed")
        merge(self, *args, **how)

    with monkeypatch.context() as m:
        m.setattr(PartitionedTarget, "merge", fails_on_b)
        with pytest.raises(Exception, match="killed"):
            run()
    assert tables["a"].target.read().count() == 6 and tables["b"].target.read().count() == 0
    spark.streams.addListener(listener)
    try:
        run()
        until = time.monotonic() + 20
        while not warned and time.monotonic() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    batch = spark.createDataFrame(data, ROUTED)
    for t in ("a", "b"):
        want = flag_routes(batch, routes).where(F.col("__target").isNotNull() & (F.col("__routing_table") == t)).select("__routing_schema", "k", "v").distinct()
        assert rows(tables[t].target.read(), "__routing_schema", "k", "v") == rows(want)
    assert (listener.routed, listener.dropped, warned) == (13, 8, [8])
