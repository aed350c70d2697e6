"""Spark session defaults for scanning jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Sizing notes for a large cluster:
# * shuffle partitions are left to AQE (coalesce + skew split) from a generous
#   initial number; findings are a tiny fraction of input lines so shuffles are
#   small compared to the scan.
# * maxPartitionBytes is kept at 64 MiB: a task holds whole files (content
#   rows), so smaller splits bound the per-task memory of the line explode.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "scanforge", conf: dict | None = None) -> SparkSession:
    """Return the active session or build a local one with scanning defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session that names none (tests) gets a fresh scratch folder;
    on a cluster a machine-local folder would lose files, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session
        pass
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="scanforge-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - static in some deployments
            pass
    if sc is not None:
        sc.setCheckpointDir(d)
    return d
