"""Session settings the package is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Normalization projects are wide.  A generated method above HotSpot's 8000-byte
# limit is never JIT-compiled, so such stages are better off with the split
# methods that Spark emits outside whole-stage code generation.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_session(app: str = "siemloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
