"""Streams over growing folders: several batches, restarts, redelivery, late data."""

from __future__ import annotations

import os

import duckdb
from pyspark.sql import functions as F

import queries.streaming
from changefeed.operators.monitor import activity_rollup
from changefeed.streaming import streams as S
from queries import ORACLES, QUERIES
from tests.conftest import rows
from tests.test_apply import BATCH, changes


def put(spark, folder, data, schema=BATCH):  # noqa: ANN001, ANN201
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_rollup_equals_the_batch_rollup(spark, tmp_path):
    schema = "source_instance_key string, logical_table_name string, rows_pulled long, failed boolean, pulled_at timestamp_ntz"
    base = "timestamp_ntz'2024-01-01 00:00:00'"
    pulls = spark.range(300).selectExpr(
        "concat('s', id % 2) as source_instance_key", "'t' as logical_table_name", "id % 5 as rows_pulled", "id % 7 = 0 as failed",
        f"{base} + make_interval(0, 0, 0, 0, 0, cast(id as int) * 3) as pulled_at", "id",
    )
    for i in range(3):
        part = pulls.filter((F.col("id") >= i * 100) & (F.col("id") < (i + 1) * 100)).drop("id")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.stream_changes(spark, str(tmp_path / "in"), schema, max_per_trigger=1)
    S.stream_to_files(S.stream_rollup(stream, 4, "1 day"), str(tmp_path / "out"), str(tmp_path / "state"), "update").awaitTermination()
    keys = ["source_instance_key", "logical_table_name", "bucket_start"]
    got = S.latest_output(spark, str(tmp_path / "out"), keys)
    want = activity_rollup(pulls.drop("id"), 4)
    numbers = ["pulls_total", "empty_pulls_total", "nonempty_pulls_total", "full_batches_total", "rows_total", "failures_total"]
    shape = lambda df: rows(df.select(*keys[:2], F.date_format("bucket_start", "yyyy-MM-dd HH").alias("h"), *numbers))
    assert shape(got) == shape(want)


def test_redelivered_rows_are_dropped_across_batches(spark, tmp_path):
    schema = "id long, ts timestamp_ntz"
    data = spark.range(10).selectExpr("id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts")
    for _ in range(2):
        data.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.stream_changes(spark, str(tmp_path / "in"), schema, max_per_trigger=1)
    out = S.dedupe_stream(stream, ["id"], "ts", "1 hour")
    S.stream_to_files(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out") + "/batch_*"), "id") == [(i,) for i in range(10)]


def test_live_latest_state(spark, tmp_path):
    data = sorted(changes(80, 8, 11), key=lambda r: (r[3], r[4]))
    for part in (data[40:], data[:40]):  # older changes arrive later
        put(spark, tmp_path / "in", part)
    stream = S.stream_changes(spark, str(tmp_path / "in"), BATCH, max_per_trigger=1)
    latest = S.latest_state(stream, ["k"], ["start_lsn", "seqval"])
    S.stream_to_files(latest, str(tmp_path / "out"), str(tmp_path / "state"), "update").awaitTermination()
    got = {r.k: r.v for r in S.latest_output(spark, str(tmp_path / "out"), ["k"]).collect()}
    assert got == {r[0]: r[1] for r in data}


def query_and_sql(spark, tmp_path, monkeypatch, name, events):  # noqa: ANN001, ANN201
    """Rows of a query whose shared folders lie in ``tmp_path``, and those of its SQL."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events.selectExpr(*[f"cast({c} as {t}) as {c}" for c, t in (x.split() for x in schema.split(", "))]).coalesce(1).write.parquet(str(tmp_path / "in/events.parquet"))
    monkeypatch.setattr(queries.streaming, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    got = QUERIES[name](spark, str(tmp_path / "in"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/in/events.parquet/*.parquet'")
    found = con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    return rows(got), sorted((tuple(r) for r in found), key=lambda t: tuple((v is not None, str(v)) for v in t))


def test_routed_rows_of_many_schemas_share_folders(spark, tmp_path, monkeypatch):
    events = spark.range(900).selectExpr("id as event_id", "timestamp_ntz'2024-01-01' as ts", "(id % 300) * 10 as user_id", "if(id % 2 = 0, 'view', 'click') as event_type", "id / 4 as value", "'' as props")
    got, want = query_and_sql(spark, tmp_path, monkeypatch, "i3_routed_apply", events)
    assert got == want and len({r[1] for r in got}) == 270
    folders = [x for n in ("view", "click") for x in os.listdir(tmp_path / f"routed/{n}/rows") if "=" in x]
    assert len(folders) <= 2 * 16


def test_quiet_tables_keep_their_names_when_merged(spark, tmp_path, monkeypatch):
    events = spark.range(120).selectExpr("id as event_id", "timestamp_ntz'2024-01-01' as ts", "id % 40 as user_id", "element_at(array('007', '', '7'), cast(id % 3 + 1 as int)) as event_type", "id / 4 as value", "'' as props")
    got, want = query_and_sql(spark, tmp_path, monkeypatch, "i4_debounced_merges", events)
    assert got == want and all(r[-1] for r in got)
