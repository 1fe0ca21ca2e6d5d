"""Report sinks: small result tables as JSON, CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_report(report: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Writes a result table; Spark's commit makes it appear whole or not at all."""
    writer = report.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def read_report(spark: SparkSession, path: str, fmt: str = "json", schema: StructType | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).load(path)
