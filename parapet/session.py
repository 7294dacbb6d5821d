"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", partitions: int = 8, **extra: str) -> SparkSession:
    """A tuned ``local[n]`` session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("parapet")
    settings = {
        **_TUNING,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()



def cluster_settings(cores: int, shuffle_bytes: int) -> dict[str, str]:
    """Settings for a cluster job that shuffles about ``shuffle_bytes``.

    Shuffle partitions of 128 MB fit beside each other in an executor, and at least
    three per core even out their running times; adaptive execution merges small ones.
    Splits of 128 MB keep text columns, which unpack to several times that, in memory.
    """
    partitions = max(3 * cores, -(-shuffle_bytes // (128 << 20)))
    return {
        **_TUNING,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.files.maxPartitionBytes": "128m",
    }


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; on a cluster, where each machine has
    its own, the setting is asked for.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    # local[n] runs in one process; local-cluster[..] has executors with folders of their own
    local = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None
    if not local and not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="parapet-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"parapet-{purpose}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df, purpose: str):
    """Write ``df`` to the shared folder and read it back.

    Unlike ``checkpoint()`` the stored form is columnar, so later stages still
    prune columns, and it survives the loss of any executor.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
