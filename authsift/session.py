"""Session helpers: a tuned local session for tests/bench and the shared work folder.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it.  A folder of our own is set only when that
setting is missing on a ``local`` master (tests, bench).
"""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_LOCAL_DIR: str | None = None


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "authsift") -> SparkSession:
    """Session for tests and the bench: AQE on, UTC, UI off, ANSI on (the default)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and derived tables.

    Read from the session (``spark.checkpoint.dir``, else the context's checkpoint
    dir).  Only a local master without either gets a fresh folder of its own.
    The context's checkpoint dir is pointed below it when unset, so
    ``DataFrame.checkpoint()`` writes to the same shared place.
    """
    global _LOCAL_DIR
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: a shared (cluster-visible) folder "
                "is required for checkpoints and derived tables")
        if _LOCAL_DIR is None:
            _LOCAL_DIR = tempfile.mkdtemp(prefix="authsift-")
        base = _LOCAL_DIR
    base = str(base).rstrip("/")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base + "/checkpoints")
    return base
