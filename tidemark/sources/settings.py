"""Named integer settings, such as the crawl's last page, in a versioned folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "setting string, value int, version bigint"


def read_setting(spark: SparkSession, path: str, name: str, default: int = 0) -> int:
    """The newest value; the default if there is none."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path).where(F.col("setting") == name).agg(F.max_by("value", "version").alias("v")).first()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = None
    return default if rows is None or rows["v"] is None else rows["v"]


def write_setting(spark: SparkSession, path: str, name: str, value: int) -> None:
    """Appends a version, so that a reader never sees a half-written table."""
    last = _last(spark, path, name)
    spark.createDataFrame([(name, value, last + 1)], SCHEMA).write.mode("append").parquet(path)


def _last(spark: SparkSession, path: str, name: str) -> int:
    try:
        row = spark.read.schema(SCHEMA).parquet(path).where(F.col("setting") == name).agg(F.max("version")).first()
        return row[0] or 0
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return 0


def all_settings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).groupBy("setting").agg(F.max_by("value", "version").alias("value"))
