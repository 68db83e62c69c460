"""Session defaults and table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", app: str = "lurescope", shared: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; an existing session is reused as it is.

    SHARED is the folder for tables that cut lineage, on storage that all executors reach.
    """
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.master(master).appName(app)
    if shared:
        defaults["spark.checkpoint.dir"] = shared
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return shipped(builder.getOrCreate())


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this package sent to its Python workers once, wherever they run and whatever their path.

    The archive lies beside the driver until it ends; Spark's own file server hands it to the executors, also to new ones.
    """
    context = spark.sparkContext
    if not getattr(context, "_lurescope_shipped", False):
        package, folder = os.path.dirname(os.path.abspath(__file__)), tempfile.mkdtemp(prefix="lurescope-code-")
        atexit.register(shutil.rmtree, folder, True)
        source = os.path.join(folder, "source")
        shutil.copytree(package, os.path.join(source, os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.path.join(folder, "lurescope"), "zip", source))
        context._lurescope_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table NAME below SF_DIR; nothing is read until an action, and only the columns used."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
