"""SparkSession defaults used by tests, bench and examples.

Library code never relies on these settings for correctness: time handling is
done in UTC microseconds, so a caller's own session works the same way.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


MB = 1024 * 1024


def cluster_conf(total_cores: int, partition_bytes: int = 256 * MB, input_bytes: int = 0) -> dict[str, str]:
    """Settings for large inputs (tens of TB on hundreds of executors).

    Shuffles start with enough partitions that even the whole input shuffled
    once gives ``partition_bytes`` each (AQE merges partitions but never adds
    any), and at least three per core and 2,000; AQE coalesces them from
    measured sizes; file splits
    use the same size, so a scan task and a reduce task hold a comparable
    amount of data.  Skew handling splits partitions five times the median and
    above ``partition_bytes``.  Broadcast stays with AQE's measured threshold
    only (the static, estimate-based one is off).  """
    parts = max(2000, 3 * total_cores, -(-input_bytes // partition_bytes))
    size = str(partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": size,
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * MB),
    }


def build_session(master: str | None = None, app: str = "eventlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and materialised tables.

    The cluster names it in ``spark.checkpoint.dir``; only when it is unset
    (local tests) a scratch folder is created and registered.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) on a cluster")
        d = tempfile.mkdtemp(prefix="eventlens-ckpt-", dir=os.environ.get("EVENTLENS_SCRATCH", "/tmp"))
        sc.setCheckpointDir(d)
    return d
