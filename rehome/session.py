"""Session settings this library is tuned for; a cluster may set its own."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution splits hot join keys at run time and turns a shuffled join into a
# broadcast one only after it has measured the side.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.scheduler.mode": "FAIR",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A definition can be megabytes of text: few rows to an Arrow batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
