"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # Date keys and cohort months are UTC by definition.
    "spark.sql.session.timeZone": "UTC",
    # Broadcast decisions, partition coalescing and skew splitting are taken from measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when the aggregate above then needs its own exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session owned by somebody else; cluster sizing stays theirs."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_spark(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session.  ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())
