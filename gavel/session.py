"""Session construction and shared configuration.

On a cluster the session is created by the platform; ``configure`` only adds
the settings the library relies on (UTC session time, AQE with skew-join
splitting) and never overrides a checkpoint folder the cluster already names.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every gavel job expects. AQE re-plans joins, coalesces small shuffle
# partitions and splits the partitions of hot join keys at runtime; forcing the
# split allows the extra shuffle of partial results that a later aggregate on
# the same key (closed auctions) then needs.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "gavel") -> SparkSession:
    """A local session for tests and the bench (UI off, loopback only)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", _half_of_memory())
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # remove reliable-checkpoint files once their DataFrame is unreachable
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _half_of_memory() -> str:
    """Half of the machine's memory (local mode runs everything in the driver)."""
    return f"{max(1024, os.sysconf('SC_PAGE_SIZE') * os.sysconf('SC_PHYS_PAGES') // 2 // 2**20)}m"


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULT_CONF to an existing session (cluster use)."""
    for k, v in DEFAULT_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we read it and
    keep it. Only when nothing is set (local tests) is a fresh scratch folder
    created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="gavel-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()
