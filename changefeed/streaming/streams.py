"""Continuous versions: polled feeds, rollups, redelivery, latest rows. Targets are in ``sinks``, timers in ``stateful``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from changefeed.operators.apply import latest_per_key
from changefeed.operators.monitor import activity_rollup
from changefeed.plans.files import SharedFiles

# --- Fixed values -----------------------------------------------------------
SOURCE_PERIOD = "1 second"
# --- End of fixed values ----------------------------------------------------


def stream_changes(spark: SparkSession, path: str, schema: T.StructType | str, max_per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    """A change feed that is polled as files arrive, at most so many files per batch.

    ``path`` may be a folder or one file.
    """
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_per_trigger)
    if SharedFiles(spark, path).is_dir():
        return reader.load(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).load(folder)


def _trigger(period: str | None) -> dict[str, object]:
    return {"processingTime": period} if period else {"availableNow": True}


def stream_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", period: str | None = None) -> StreamingQuery:
    """Append the rows a stream emits to parquet files.

    In update mode a row may be emitted again; it carries the number of its batch in
    ``__batch``, and ``latest_output`` reads the last state.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        # A folder per batch: a repeated batch replaces its own output.
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_{batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(period))
        .start()
    )


def latest_output(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last state per key of what ``stream_to_files`` wrote."""
    return latest_per_key(spark.read.parquet(f"{path}/batch_*"), keys, ["__batch"]).drop("__batch")


def stream_rollup(pulls: DataFrame, cap: Column | int, delay: str = "2 hours") -> DataFrame:
    """Hourly pull counters of a stream; an hour is final once the watermark passes it."""
    timed = pulls.withColumn("pulled_at", F.col("pulled_at").cast("timestamp")).withWatermark("pulled_at", delay)
    rolled = activity_rollup(timed, cap, F.window("pulled_at", "1 hour"))
    return rolled.withColumn("bucket_start", F.col("bucket_start.start"))


def dedupe_stream(stream: DataFrame, identity: Sequence[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """Drop redelivered rows that arrive within ``delay`` of the first one."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(identity))


def latest_state(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The live latest row per key: a stateful aggregate, to be emitted in update mode."""
    return latest_per_key(stream, keys, order)
