"""Spark session defaults and the shared scratch location.

Every job in this package is a lazy DataFrame plan; the session only fixes
the settings the operators rely on (UTC session time zone so hour/day parts
are stable, AQE for runtime re-planning and skew-join splitting).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of global ranks are removed once their DataFrame is gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "vidmart",
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, stream checkpoints and written tables.

    On a cluster this is the shared path named by ``spark.checkpoint.dir``.
    Only a local master may go without: a private folder is then made
    and registered, so later calls in the same session reuse it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="vidmart-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path below the checkpoint root."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def scale_conf(input_bytes: int, cores: int, target_partition_mb: int = 256,
               dimension_broadcast_mb: int = 64) -> dict[str, str]:
    """Settings for a cluster run, sized from the input volume.

    Shuffle partitions are chosen so one partition holds about
    ``target_partition_mb`` of input (at least 2 waves of the cores; AQE then
    coalesces small ones and splits skewed ones); dimension tables up to
    ``dimension_broadcast_mb`` are broadcast by measured size."""
    parts = max(2 * cores, -(-input_bytes // (target_partition_mb << 20)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_mb << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.autoBroadcastJoinThreshold": str(dimension_broadcast_mb << 20),
        "spark.sql.session.timeZone": "UTC",
    }
