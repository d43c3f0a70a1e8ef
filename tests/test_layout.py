"""Feeds laid out by position: what a pull reads, and that it gives what a full scan gives."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from changefeed.plans import native
from changefeed.sources.feeds import scan_after_checkpoints
from changefeed.sources.layout import PositionedFeed
from changefeed.spec import TableSpec
from tests.conftest import rows

SCHEMA = "customer_id string, table_name string, pk long, op_code int, start_lsn string, seqval string"
KEYS, SPEC = native.FEED_KEYS, TableSpec("t", ["pk"])
NOW = lambda: F.expr("timestamp_ntz'2024-01-01'")


@pytest.fixture
def feed(spark, tmp_path):  # noqa: ANN001, ANN201
    out = PositionedFeed(spark, str(tmp_path), SCHEMA, KEYS, digits=3)
    for low in (0, 200):  # two appends
        data = [(f"c{i % 3}", "t", i % 17, (1, 2, 3, 4)[i % 4], f"{i // 2:04X}", f"{i % 2}") for i in range(low, low + 200)]
        out.append(spark.createDataFrame(data, SCHEMA))
    return out


def checkpoints(spark, *data):  # noqa: ANN001, ANN201
    return spark.createDataFrame(list(data), "customer_id string, table_name string, last_start_lsn string, last_seqval string")


def spoil(feed, below: str) -> int:  # noqa: ANN001
    """Make the files of lower ranges unreadable."""
    n = 0
    for folder in os.listdir(f"{feed.root}/changes"):
        if folder.startswith("__lsn_range=") and folder.split("=")[1] < below:
            for name in os.listdir(f"{feed.root}/changes/{folder}"):
                if name.startswith("part-"):
                    os.remove(f"{feed.root}/changes/{folder}/.{name}.crc")
                    with open(f"{feed.root}/changes/{folder}/{name}", "wb") as f:
                        f.write(b"spoilt")
                    n += 1
    return n


def test_a_pull_reads_ranges_from_the_lowest_cursor_on(spark, feed):  # noqa: ANN001
    cursors = checkpoints(spark, ("c0", "t", "0090", "0"), ("c1", "t", "00A3", None), ("c2", "t", "00B0", "1"))
    everything = spark.createDataFrame(feed.changes().drop("__lsn_range").collect(), SCHEMA)
    want = rows(scan_after_checkpoints(everything, cursors, KEYS))
    assert spoil(feed, "009") >= 8
    plan = feed.after(cursors)._jdf.queryExecution().executedPlan().toString()
    filters = [x.split("PushedFilters")[0] for x in plan.split("PartitionFilters: ")[1:]]
    assert any("(__lsn_range" in x and "ubquery" in x for x in filters), filters
    pulled = native.pull_positioned(feed, SPEC, cursors, NOW())
    assert rows(pulled.rows.select("customer_id", "table_name", "pk", "op_code", "start_lsn", "seqval")) == want and len(want) > 50
    assert pulled.lost.count() == 0
    text = pulled.rows._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("__lsn_range") > 0 and sum("pk#" in line and "Relation [" in line for line in text.split("\n")) == 1  # one scan of changes


def test_feeds_without_checkpoint_and_with_lost_changes(spark, feed):  # noqa: ANN001
    # c0 lost changes, so its old cursor does not matter; c1 has none and counts from its lowest position.
    cursors = checkpoints(spark, ("c0", "t", "", None), ("gone", "t", "0000", None), ("c2", "t", "00C0", "0"))
    pulled = native.pull_positioned(feed, SPEC, cursors, NOW())
    assert rows(pulled.lost, "customer_id") == [("c0",)]
    counts = dict(rows(pulled.rows.groupBy("customer_id").count()))
    assert set(counts) == {"c1", "c2"} and counts["c1"] == feed.changes().where("customer_id = 'c1' and op_code <> 3").count()
    edges = {r.customer_id: (r.min_lsn, r.max_lsn, r.max_seqval) for r in feed.bounds().collect()}
    assert edges["c0"] == ("0000", "00C7", "1")


def test_binary_positions(spark, tmp_path):  # noqa: ANN001
    schema = SCHEMA.replace("start_lsn string, seqval string", "start_lsn binary, seqval binary")
    out = PositionedFeed(spark, str(tmp_path), schema, KEYS, digits=2)
    out.append(spark.createDataFrame([("c", "t", i, 2, bytes([i, 255]), b"\x00") for i in range(20)], schema))
    cursors = spark.createDataFrame([("c", "t", bytes([7, 255]), b"\x00")], "customer_id string, table_name string, last_start_lsn binary, last_seqval binary")
    assert [r[0] for r in rows(native.pull_positioned(out, SPEC, cursors, NOW()).rows, "pk")] == sorted(range(8, 20), key=str)
