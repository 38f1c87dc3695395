"""Writing results and small parameter tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddlot.sources.scan import CSV_TIMES


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.options(**CSV_TIMES).csv(path, header=True)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_params(spark: SparkSession, path: str, params: dict[str, Any]) -> None:
    """One-row parameter table; a nested dict becomes a ``map<string,double>`` column."""
    fields = []
    for name, value in params.items():
        if isinstance(value, dict):
            entries = [x for k, v in value.items() for x in (F.lit(k), F.lit(v).cast("double"))]
            fields.append((F.create_map(*entries)).alias(name))
        else:
            fields.append(F.lit(value).alias(name))
    spark.range(1).select(*fields).write.mode("overwrite").parquet(path)


def read_params(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The parameters, or ``None`` when nothing readable is stored there."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.parquet(path).first()
    except AnalysisException:
        return None
    return row.asDict(recursive=True) if row is not None else None
