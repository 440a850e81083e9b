"""Session builder with the settings the engine's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results or plans; everything else is left to the cluster.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "corvane", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the pinned settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**PINNED, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the input tables, as any Spark-readable path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
