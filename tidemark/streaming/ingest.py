"""Scraped articles as a stream: each micro-batch is classified against the buckets of the table it touches and applied."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.upsert import applied

_VERSION = "v={:012d}"
#: Parts of the table; a batch rewrites those it touches. Stored tables keep the number they were made with.
BUCKETS = 64


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions in a table's folder, through Hadoop's file system so that any shared store works."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for item in fs.listStatus(path):
        match = re.fullmatch(r"v=(\d{12})", item.getPath().getName())
        if match and fs.exists(jvm.org.apache.hadoop.fs.Path(item.getPath(), "_SUCCESS")):
            found.append(int(match.group(1)))
    return sorted(found)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("paragraph_link"), F.lit(BUCKETS)).cast("int")


def _layout(spark: SparkSession, root: str, upto: int | None = None) -> tuple[str | None, dict[int, str]]:
    """The newest folder of each bucket, and that of a version without buckets for those that none has replaced since."""
    jvm = spark.sparkContext._jvm
    base, newest = None, {}
    for version in versions(spark, root):
        if upto is None or version <= upto:
            path = jvm.org.apache.hadoop.fs.Path(f"{root}/{_VERSION.format(version)}")
            names = [item.getPath().getName() for item in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
            if any(name.endswith(".parquet") for name in names):
                base, newest = str(path), {}
            newest |= {int(name[2:]): f"{path}/{name}" for name in names if name.startswith("b=")}
    return base, newest


def read_current(spark: SparkSession, root: str, schema: StructType, buckets: Sequence[int] | None = None, upto: int | None = None) -> DataFrame:
    """The table as of a version, whole or some buckets of it."""
    base, newest = _layout(spark, root, upto)
    paths = [path for b, path in sorted(newest.items()) if buckets is None or b in buckets]
    found = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    if base:
        old = spark.read.schema(schema).parquet(base).where(~_bucket().isin(*newest) if newest else F.lit(True))
        found = found.unionByName(old if buckets is None else old.where(_bucket().isin(*buckets)))
    return found


def upsert_stream(batches: DataFrame, root: str, schema: StructType, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Run through what has arrived and stop. The table lies in ``BUCKETS`` parts by hash of the link, and a batch writes
    only the buckets it touches, as version batch_id + 1; a repeated batch writes the same version again from those before
    it, so a restart changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = [r[0] for r in batch.where("paragraph_link is not null").select(_bucket()).distinct().collect()]  # BUCKETS at most
        stored = read_current(spark, root, schema, touched, number)
        top = read_current(spark, root, schema, None, number).agg(F.max("id")).first()[0] or 0
        made = applied(stored, batch, order, top).withColumn("b", _bucket())
        made.repartition(max(1, len(touched)), "b").write.mode("overwrite").partitionBy("b").parquet(f"{root}/{_VERSION.format(number + 1)}")

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_mentions(mentions: DataFrame, time: str = "fetched_at", late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Mentions per stock and window of a stream, late rows admitted up to the watermark. Works on a static frame too."""
    stamped = mentions.withColumn("_t", F.col(time).cast("timestamp"))
    if mentions.isStreaming:
        stamped = stamped.withWatermark("_t", late)
    per = stamped.groupBy(F.window("_t", width), "stock_no").agg(F.count("*").alias("mentions"))
    return per.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "stock_no", "mentions")
