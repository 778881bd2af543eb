"""Session settings every operator relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# UTC days, ANSI arithmetic and adaptive execution are assumed throughout.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Only a new context can take these: checkpoint files are compressed, and go
# away once nothing on the driver refers to them.
STATIC_CONF = {
    "spark.checkpoint.compress": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "dayloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings above; `conf` uses `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in (STATIC_CONF | RUNTIME_CONF).items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Put the runtime settings onto a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for `checkpoint()`: the one the cluster names, else local only.

    A temporary folder is chosen only under a local master; on a cluster the
    executors could not read it, so the setting is required there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="dayloom-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()
