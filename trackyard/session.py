"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a job relies on; applied only when the caller builds the session.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


MB = 1 << 20


def cluster_conf(shuffle_bytes: int, target_partition_bytes: int = 256 * MB) -> dict[str, str]:
    """Partition sizing for a cluster run, from the expected largest shuffle.

    AQE starts from ``initialPartitionNum`` partitions of about
    ``target_partition_bytes`` each and coalesces small stages, so one
    setting serves both the 100 TB fact scans and the small dimension
    stages.  Scan splits stay at 256 MB; a shuffle partition 5x the median
    and over 1 GB counts as skewed and is split by AQE.
    """
    parts = max(200, -(-shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(256 * MB),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * MB),
    }


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "trackyard", shuffle_bytes: int | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults above.

    On a cluster ``master`` stays None so spark-submit decides; tests pass
    ``local[*]``.  ``shuffle_bytes`` (expected largest shuffle) sizes the
    partitions with ``cluster_conf``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", "16g")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_bytes:
        for k, v in cluster_conf(shuffle_bytes).items():
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster sets it; only a local session without one gets a fresh
    scratch folder (as in tests).  On a cluster without the setting we
    refuse rather than fall back to a machine-local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="trackyard-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def tell_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster that has the package installed or shipped (--py-files) this adds nothing.
    """
    import trackyard
    root = os.path.dirname(os.path.dirname(os.path.abspath(trackyard.__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/trackyard/{name}-{uuid.uuid4().hex[:12]}"
