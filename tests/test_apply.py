"""Applying changes: against a row-by-row model, replay, delete orders, skew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from changefeed.operators import apply as A
from changefeed.operators import neighbours
from changefeed.operators.monitor import latency_percentiles, offset_gaps, position_regressions
from changefeed.sources import feeds
from changefeed.spec import Position
from tests.conftest import rows

TARGET = "k int, v string, start_lsn string, seqval string"
BATCH = "k int, v string, op_code int, start_lsn string, seqval string"


def changes(n: int, keys: int, seed: int, hot: float = 0.4) -> list[tuple]:
    """Random changes with unique positions; one key takes a large share."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = 0 if rnd.random() < hot else rnd.randrange(keys)
        out.append((k, f"v{i}", rnd.choice((1, 2, 3, 4, 4)), f"{i // 3:020X}", f"{i % 3:020X}"))
    rnd.shuffle(out)
    return out


def model(target: dict, batch: list[tuple], mode: str = "hard", guard: bool = False) -> dict:
    """The same merge, one change at a time, in log order."""
    state = dict(target)
    for k, v, op, lsn, seq in sorted(batch, key=lambda r: (r[3], r[4])):
        if mode == "hard" and op == 3:
            continue
        if guard and k in target and (target[k][1], target[k][2]) >= (lsn, seq):
            continue
        if mode == "hard" and op == 1:
            state.pop(k, None)
        else:
            state[k] = (v, lsn, seq)
    return state


@pytest.mark.parametrize("stage", [False, True])
@pytest.mark.parametrize("mode", ["hard", "soft"])
@pytest.mark.parametrize("guard", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_apply_equals_the_row_by_row_model(spark, stage, mode, guard, seed):
    rnd = random.Random(seed)
    target = {k: (f"old{k}", f"{rnd.randrange(60):020X}", f"{9:020X}") for k in range(0, 40, 2)}
    batch = changes(200, 50, seed)
    t = spark.createDataFrame([(k, *v) for k, v in target.items()], TARGET)
    out = A.apply_changes(t, spark.createDataFrame(batch, BATCH), ["k"], mode, guard=guard, stage=stage)
    assert {r.k: tuple(r)[1:] for r in out.collect()} == model(target, batch, mode, guard)
    assert out.count() == len({r.k for r in out.collect()})


@pytest.mark.parametrize("stage", [False, True])
def test_delete_then_reinsert(spark, stage):
    t = spark.createDataFrame([(1, "a", "00", "00")], TARGET)
    batch = spark.createDataFrame([(1, "a", 1, "01", "00"), (1, "b", 2, "01", "01"), (2, "c", 2, "01", "02")], BATCH)
    assert rows(A.apply_changes(t, batch, ["k"], stage=stage), "k", "v") == [(1, "b"), (2, "c")]
    kept = A.apply_changes(t, batch, ["k"], delete_order="any", stage=stage)
    assert rows(kept, "k", "v") == [(2, "c")]


@pytest.mark.parametrize("stage", [False, True])
def test_a_guarded_replay_changes_nothing(spark, stage):
    batch = spark.createDataFrame(changes(120, 20, 3), BATCH)
    empty = spark.createDataFrame([], TARGET + ", gone boolean")
    once = A.apply_changes(empty, batch, ["k"], guard=True, stage=stage, tombstone="gone")
    assert {r.k: tuple(r)[1:] for r in A.live(once, "gone").collect()} == model({}, changes(120, 20, 3))
    for replay in (batch.filter(F.col("start_lsn") < f"{20:020X}"), batch.filter("op_code <> 1"), batch):
        twice = A.apply_changes(once, replay, ["k"], guard=True, stage=stage, tombstone="gone")
        assert rows(twice) == rows(once)
    assert A.expire_tombstones(once, "gone", "Z").filter("gone").isEmpty()


def test_a_repeated_key_of_the_target_becomes_one_row(spark):
    t = spark.createDataFrame([(1, "a", "00", "00"), (1, "b", "00", "00"), (2, "c", "00", "00"), (2, "d", "00", "00")], TARGET)
    batch = spark.createDataFrame([(1, "x", 4, "01", "00")], BATCH)
    assert rows(A.apply_changes(t, batch, ["k"]), "k", "v") == [(1, "x"), (2, "c"), (2, "d")]


def test_expiry_keeps_feeds_with_a_null_key(spark):
    df = spark.createDataFrame([(None, 1, "01"), ("a", 1, "01"), ("a", 2, "02")], "c string, at int, start_lsn string")
    assert rows(A.expire_changes(df, ["c"], F.lit(2), "at")) == [(None, 1, "01"), ("a", 2, "02")]


def test_batches_in_a_row_equal_one_batch(spark):
    batch = changes(150, 15, 4)
    ordered = sorted(batch, key=lambda r: (r[3], r[4]))
    state = spark.createDataFrame([], TARGET)
    for part in (ordered[:50], ordered[50:100], ordered[100:]):
        state = A.apply_changes(state, spark.createDataFrame(part, BATCH), ["k"])
    assert {r.k: tuple(r)[1:] for r in state.collect()} == model({}, batch)


def test_columns_the_batch_lacks_become_null(spark):
    t = spark.createDataFrame([(1, "a", "x")], "k int, v string, extra string")
    batch = spark.createDataFrame([(1, "b", 4, "01", "00")], BATCH)
    assert rows(A.apply_changes(t, batch, ["k"])) == [(1, "b", None)]


def test_bad_arguments(spark):
    t = spark.createDataFrame([], TARGET)
    for kw in ({"mode": "x"}, {"delete_order": "x"}):
        with pytest.raises(ValueError, match="must be"):
            A.apply_changes(t, t, ["k"], **kw)


def test_upsert_with_order_takes_the_last(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "k int, v string, n int")
    assert rows(A.upsert(t, b, ["k"], ["n"])) == [(1, "y"), (2, "b"), (3, "z")]
    assert rows(A.delete_keys(t, b, ["k"])) == [(2, "b")]


def test_checkpoints_never_go_back(spark):
    ckpt = spark.createDataFrame([("a", "t", "05", None), ("b", "t", "05", "02")], "c string, table_name string, last_start_lsn string, last_seqval string")
    batch = spark.createDataFrame([("a", "t", "05", "01"), ("b", "t", "04", "09"), ("n", "t", "01", "01")], "c string, table_name string, start_lsn string, seqval string")
    got = rows(A.advance_checkpoints(ckpt, batch, ["c", "table_name"]), "c", "last_start_lsn", "last_seqval")
    assert got == [("a", "05", "01"), ("b", "05", "02"), ("n", "01", "01")]


def test_binary_positions_order_as_unsigned(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x7f"), bytearray(b"\x00")), (1, bytearray(b"\x80"), bytearray(b"\x00"))], "k int, start_lsn binary, seqval binary")
    assert bytes(A.latest_per_key(df, ["k"], ["start_lsn", "seqval"]).first().start_lsn) == b"\x80"


def test_cursor_without_a_sequence_admits_its_lsn_again(spark):
    df = spark.createDataFrame([(i, 2, f"{i // 2:02}", f"{i % 2:02}") for i in range(8)], "id int, op_code int, start_lsn string, seqval string")
    assert [r.id for r in feeds.scan_changes(df, "01").collect()] == [2, 3, 4, 5, 6, 7]
    assert [r.id for r in feeds.scan_changes(df, "01", "00").collect()] == [3, 4, 5, 6, 7]
    assert [r.id for r in feeds.scan_changes(df, "01", "01", limit=3).collect()] == [4, 5, 6]


def test_whole_transactions_are_never_cut(spark):
    df = spark.createDataFrame([(i, 2, f"{i // 3:02}", f"{i % 3:02}") for i in range(12)], "id int, op_code int, start_lsn string, seqval string")
    seen, cursor = [], ""
    while True:
        part = feeds.scan_changes(df, cursor, composite=False, limit=4, whole_transactions=True)
        got = part.collect()
        if not got:
            break
        seen += [r.id for r in got]
        cursor = max(r.start_lsn for r in got)
    assert sorted(seen) == list(range(12))


def test_retention_gap(spark):
    ckpt = spark.createDataFrame([("a", "01", None), ("b", "05", None)], "c string, last_start_lsn string, last_seqval string")
    bounds = spark.createDataFrame([("a", "02"), ("b", "02")], "c string, min_lsn string")
    assert rows(A.retention_gaps(ckpt, bounds, ["c"]), "c") == [("a",)]


def test_bootstrap_replaces_only_its_tenants(spark):
    target = spark.createDataFrame([("a", 1, "old", None, 4), ("b", 1, "keep", None, 4)], "t string, k int, v string, __source string, __cdc_operation int")
    snap = spark.createDataFrame([("a", 1, "new"), ("a", 2, "new2"), ("z", 9, "other")], "t string, k int, v string")
    bounds = spark.createDataFrame([("a", "0A", "01")], "t string, start_lsn string, seqval string")
    out = A.bootstrap(target, snap, bounds, "t", F.lit(None).cast("timestamp"))
    assert rows(out) == [("a", 1, "new", "mssql_snapshot", 2), ("a", 2, "new2", "mssql_snapshot", 2), ("b", 1, "keep", None, 4)]


def test_expiry_never_lowers_the_mark(spark):
    df = spark.createDataFrame([("a", f"{i:02}", i) for i in range(10)], "f string, start_lsn string, changed_at int")
    assert A.expire_changes(df, ["f"], F.lit(4)).count() == 6
    assert A.expire_changes(df, ["f"], F.lit(-1)).count() == 10
    low = spark.createDataFrame([("a", "07")], "f string, low_lsn string")
    assert A.expire_changes(df, ["f"], F.lit(4), low_water=low).count() == 3


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_neighbours_equal_a_plain_window(spark, width):
    from pyspark.sql import Window as W

    rnd = random.Random(width)
    data = [(rnd.choice(["a", "b", None]), i * rnd.randrange(1, 4), i) for i in range(300)]
    data = list({(k, o): (k, o, v) for k, o, v in data}.values())
    df = spark.createDataFrame(data, "k string, o long, v long")
    w = W.partitionBy("k").orderBy("o")
    want = rows(df.select("k", "o", F.lead("v").over(w), F.lag("v").over(w)))
    bucket = F.floor(F.col("o") / width)
    got = neighbours.next_row(df, ["k"], ["o"], ["v"], bucket)
    got = neighbours.previous_row(got, ["k"], ["o"], ["v"], bucket)
    assert rows(got.select("k", "o", "next.v", "previous.v")) == want


def test_gaps_and_regressions(spark):
    log = spark.createDataFrame(
        [("t", None, 0, 0, 9), ("t", None, 0, 10, 19), ("t", None, 0, 25, 30), ("t", None, None, 99, 99)],
        "table_name string, customer_id string, kafka_partition int, min_kafka_offset long, max_kafka_offset long",
    )
    got = rows(offset_gaps(log, 7), "batch_end_offset", "gap_size")
    assert got == [(19, 5), (30, None), (9, 0)]
    moves = spark.sql(
        "select 'f' as feed, timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,id*20) as processed_at, lpad(cast(case when id = 2 then 0 else id end as string), 2, '0') as start_lsn, '0' as seqval, id from range(5)"
    )
    assert rows(position_regressions(moves, ["feed"]), "id", "previous_start_lsn") == [(2, "01")]


@pytest.mark.parametrize("width", [1.0, 100.0, 1e9])
def test_percentiles_equal_the_builtin(spark, width):
    rnd = random.Random(7)
    data = [(rnd.choice("ab"), round(rnd.expovariate(0.01), rnd.choice((0, 3)))) for _ in range(500)] + [("one", 5.0), ("a", None)]
    df = spark.createDataFrame(data, "table_name string, lag_total_ms double").withColumn("created_at", F.expr("timestamp_ntz'2024-01-02'"))
    got = latency_percentiles(df, F.expr("timestamp_ntz'2024-01-01'"), bucket_ms=width)
    want = df.filter("lag_total_ms is not null").groupBy("table_name").agg(
        F.count("*"), *[F.round(F.percentile("lag_total_ms", p), 1) for p in (0.5, 0.95, 0.99)], F.round(F.max("lag_total_ms"), 1)
    )
    assert rows(got) == rows(want)


def test_feed_bounds_and_last_position(spark):
    df = spark.createDataFrame([("a", "01", "05"), ("a", "03", "01"), ("a", "03", "02"), ("b", "02", "00")], "f string, start_lsn string, seqval string")
    assert rows(feeds.feed_bounds(df, ["f"])) == [("a", "01", "03", "02"), ("b", "02", "02", "00")]
    assert rows(feeds.last_position(df, Position())) == [("03", "02")]
