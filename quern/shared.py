"""The folder that driver and executors share, and what is written there: intermediate tables, snapshots, copies.

Everything lies in one folder of the application, which goes when the application ends; what is read no more goes before.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a query whose result is written go with the query.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_RUNS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where that is unset (a local session, as in tests) does a temporary
    folder of this machine take its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` in the application's folder, which is deleted when the JVM of the driver ends."""
    run = f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}"
    if run not in _RUNS:
        p, fs = _file_system(spark, run)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _RUNS.add(run)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def write(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet; the shuffle files of the query go with it, as nothing reads them again."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again.

    This cuts the lineage: a lost executor costs the tasks it ran, never the stages before the table, and what non-repeatable
    steps decided (partition numbers) stays decided.
    """
    path = shared_path(df.sparkSession, name)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Delete a table of ``shared_table`` that nothing reads any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        remove(df.sparkSession, path)
