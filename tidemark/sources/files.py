"""CSV, JSON and page files in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

TARGETS = ("stock_no", "stock_name")
NICKNAMES = ("stock_no", "stock_nickname", "nickname_explain")
INFOS = ("stock_no", "stock_name", "business_scope", "competitor")


def strings(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def csv_dictionary(spark: SparkSession, path: str, columns: Sequence[str] = TARGETS) -> DataFrame:
    """A dictionary file. All columns are text: codes keep their leading zeros. Headers 'no' and 'name' of older files
    are taken for stock_no and stock_name."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    raw = raw.withColumnsRenamed({"no": "stock_no", "name": "stock_name", "No": "stock_no", "Name": "stock_name"})
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_csv(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    frame.write.mode(mode).option("header", True).csv(path)


def write_pieces(frame: DataFrame, path: str, piece: str = "piece", mode: str = "errorifexists") -> None:
    """One folder per piece, text quoted."""
    frame.write.mode(mode).partitionBy(piece).option("header", True).option("quoteAll", True).csv(path)


def listed_companies(spark: SparkSession, path: str) -> DataFrame:
    """The listed companies as an exchange publishes them, a JSON array of objects with No and Name."""
    raw = spark.read.option("multiLine", True).schema("No string, Name string, stock_no string, stock_name string").json(path)
    return raw.select(F.coalesce("stock_no", "No").alias("stock_no"), F.coalesce("stock_name", "Name").alias("stock_name")).where("stock_no is not null")


def as_json(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows as JSON text beside their keys."""
    return frame.select(*keys, F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("body"))


def from_json_rows(frame: DataFrame, schema: StructType, body: str = "body") -> DataFrame:
    return frame.select(F.from_json(body, schema).alias("r")).select("r.*")
