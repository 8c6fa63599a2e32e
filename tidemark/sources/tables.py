"""Parquet table access. One place knows where tables lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.session import share_package


def table(spark: SparkSession, folder: str, name: str, *columns: Column | str) -> DataFrame:
    """Read one table; naming columns keeps the scan narrow even below an opaque Python stage."""
    share_package(spark)
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def run_sql(spark: SparkSession, folder: str, statement: str, *names: str) -> DataFrame:
    """Any SQL over the named tables of a folder, lazily; nothing is collected."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(statement)
