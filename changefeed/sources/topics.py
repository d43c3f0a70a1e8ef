"""Broker topics as sources and sinks.

The broker's connector is a separate jar that a cluster supplies. What is ours is the
shape of the rows, so ``topic_rows`` works, and is tested, without one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def topic_options(
    servers: str,
    topics: Sequence[str] = (),
    pattern: str | None = None,
    from_oldest: bool = True,
    max_per_trigger: int | None = None,
) -> dict[str, str]:
    """Options of a subscription to a list of topics or to a topic pattern."""
    if bool(topics) == bool(pattern):
        raise ValueError("give either topics or a pattern")
    options = {
        "kafka.bootstrap.servers": servers,
        "startingOffsets": "earliest" if from_oldest else "latest",
        "failOnDataLoss": "true",
    }
    if topics:
        options["subscribe"] = ",".join(topics)
    else:
        options["subscribePattern"] = str(pattern)
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def read_topics(spark: SparkSession, servers: str, topics: Sequence[str] = (), streaming: bool = True, **kw: object) -> DataFrame:
    """Subscribe to topics, from the oldest message unless told otherwise."""
    reader = spark.readStream if streaming else spark.read
    raw = reader.format("kafka").options(**topic_options(servers, topics, **kw)).load()  # type: ignore[arg-type]
    return raw.select(
        F.col("topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
        F.col("value").cast("string").alias("value"),
    )


def topic_rows(df: DataFrame, topic: Column, key: Column, value: Column | None = None) -> DataFrame:
    """Rows as a keyed topic sink takes them: topic, key and JSON value."""
    if value is None:
        value = F.struct(*[F.col(c) for c in df.columns])
    return df.select(topic.alias("topic"), key.alias("key"), F.to_json(value).alias("value"))


def write_topics(rows: DataFrame, servers: str, checkpoint: str | None = None) -> DataStreamWriter | None:
    """Write ``topic_rows``: a batch at once, a stream as a writer to be started."""
    if rows.isStreaming:
        if not checkpoint:
            raise ValueError("a streaming topic sink needs a checkpoint location")
        return (
            rows.writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("kafka.compression.type", "snappy")
            .option("checkpointLocation", checkpoint)
        )
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    return None
