"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Names the shared folder where the session has no ``spark.checkpoint.dir``; it can be set on a running session.
SHARED = "lurescope.shared.dir"
_TABLES: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, else its :data:`SHARED`.

    Where neither is set, a ``local`` session, as in tests, keeps its tables in its own warehouse; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED, None)
    if where:
        return where
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir, or {SHARED}, to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lurescope-cuts"


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001


def _own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; what is left of it goes when the driver's JVM ends."""
    context = spark.sparkContext
    path = f"{shared_dir(spark).rstrip('/')}/lurescope-{context.applicationId}"
    if getattr(context, "_lurescope_dir", None) != path:
        at = context._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        system = at.getFileSystem(context._jsc.hadoopConfiguration())  # noqa: SLF001
        system.mkdirs(at)
        system.deleteOnExit(at)
        context._lurescope_dir = path
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes DF as a table of the shared folder and reads it back.

    Unlike an in-memory copy it survives the loss of executors; unlike ``checkpoint()`` it is columnar, and its size
    is known to the planner, so that joins with small results become broadcast joins by Spark's own size check.

    The table lives as long as a DataFrame that reads it: :func:`sweep`, called here and before every query, deletes
    those that none does any more.
    """
    spark = df.sparkSession
    sweep(spark)
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path  # noqa: SLF001
    files = out._jdf.queryExecution().analyzed().relation().location()  # noqa: SLF001
    _TABLES.append((spark.sparkContext._jvm.java.lang.ref.WeakReference(files), path))  # noqa: SLF001
    return out


def sweep(spark: SparkSession) -> int:
    """Deletes the tables of :func:`cut` that no plan refers to any more; the number of those left.

    Every plan over a table holds the list of its files, however it was derived, so the JVM's own reachability decides.
    """
    left = []
    for held, path in _TABLES:
        if held.get() is None:
            _delete(spark, path)
        else:
            left.append((held, path))
    _TABLES[:] = left
    return len(left)


def drop(df: DataFrame) -> None:
    """Deletes the table behind a result of :func:`cut` at once, for what nothing needs any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        _TABLES[:] = [t for t in _TABLES if t[1] != path]
        _delete(df.sparkSession, path)
