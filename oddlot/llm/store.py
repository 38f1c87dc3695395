"""Written tables in the shared checkpoint folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from oddlot.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

