"""Table access by name below one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """``{root}/{name}.parquet``; with ``columns`` only those are read."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def columns(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """``table_name, column_name, position`` of the tables in a directory, from their schemas."""
    rows = [(n, f.name, k) for n in names for k, f in enumerate(table(spark, root, n).schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position bigint")
