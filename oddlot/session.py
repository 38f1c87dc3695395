"""Session helpers: where intermediate results are written to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, taking it from ``spark.checkpoint.dir``.

    A machine-local folder is only ever chosen for a local master; on a cluster the
    shared folder has to be configured.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="oddlot-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint directory and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def settle_plain(df: DataFrame) -> DataFrame:
    """``settle``, forgetting the estimated size of ``df``.

    That size is a product over all joins so far: where each step joins what the last one left, it would soon be a
    number of millions of digits that planning multiplies.
    """
    spark, kept = df.sparkSession, settle(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per Spark context, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_oddlot_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="oddlot-package-"), "oddlot"),
        "zip",
        os.path.dirname(package),
        os.path.basename(package),
    )
    context.addPyFile(archive)
    context._oddlot_shipped = True
