"""Session settings for this engine: adaptive plans, skew handling, UTC, ANSI semantics."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "100000",
    "spark.sql.unionOutputPartitioning": "false",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def builder(app: str = "quern", **extra: str) -> SparkSession.Builder:
    """A builder with the settings above; ``extra`` overrides, with dots written as two underscores."""
    out = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        out = out.config(key, value)
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it; not needed where it is installed or on PYTHONPATH."""
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "quern.zip")  # read by the driver alone, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("quern", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
