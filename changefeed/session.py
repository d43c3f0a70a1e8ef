"""Session helpers: settings we rely on, and where shared files may go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"

# Adaptive execution is what turns a join against a small registry into a broadcast
# (by measured size, never by hint) and what splits hot keys of a large join.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Bytes one shuffle partition should hold, and the most partitions a driver keeps track of well.
PARTITION_BYTES = 256 * 1024**2
MOST_PARTITIONS = 100_000


def cluster_conf(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a cluster whose largest shuffle moves about ``shuffle_bytes``.

    Partitions are sized for that shuffle; adaptive execution merges them again after
    smaller ones and splits those a hot key makes too large. Streaming state goes to RocksDB,
    whose size is not bounded by executor memory.
    """
    partitions = max(2 * cores, -(-shuffle_bytes // PARTITION_BYTES))
    return {
        **RECOMMENDED_CONF,
        "spark.sql.shuffle.partitions": str(min(partitions, MOST_PARTITIONS)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{PARTITION_BYTES // 2}b",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{PARTITION_BYTES}b",
        "spark.sql.files.maxPartitionBytes": f"{PARTITION_BYTES}b",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    }


def local_session(app: str, cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh directory below the cluster's shared folder.

    The folder is named by ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary directory of this machine is used instead; any other master, or one that is not known, raises.
    """
    base = spark.conf.get(SHARED_DIR_CONF, None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SHARED_DIR_CONF} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="changefeed-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
