"""The reference list of stocks: lookups, merges, inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A lookup side is broadcast only up to this many rows; a larger one joins by shuffle.
BROADCAST_ROWS = 200_000
#: And only up to so many characters of its rows as text.
BROADCAST_CHARS = 64_000_000


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where a bounded count proves the side small, leave the choice to Spark otherwise."""
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
    n, chars = frame.limit(rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(frame) if n <= rows and chars <= BROADCAST_CHARS else frame


def name_lookup(targets: DataFrame) -> DataFrame:
    """(token, stock_no) by name; of codes that share a name the last one counts."""
    return targets.where("stock_name is not null and stock_name <> ''").groupBy(F.col("stock_name").alias("token")).agg(F.max("stock_no").alias("stock_no"))


def token_lookup(targets: DataFrame) -> DataFrame:
    """(token, stock_no, stock_name): names come before codes, one row per token, so that one join finds both."""
    names = name_lookup(targets).select("token", "stock_no", F.col("token").alias("stock_name"), F.lit(0).alias("prio"))
    codes = targets.where("stock_no is not null and stock_no <> ''").groupBy("stock_no").agg(F.max("stock_name").alias("stock_name"))
    codes = codes.select(F.col("stock_no").alias("token"), "stock_no", "stock_name", F.lit(1).alias("prio"))
    best = F.min(F.struct("prio", "stock_no", "stock_name")).alias("b")
    return names.unionByName(codes).groupBy("token").agg(best).select("token", "b.stock_no", "b.stock_name")


def merged_dataset(targets: DataFrame, infos: DataFrame, nicknames: DataFrame) -> DataFrame:
    """targets with infos and nicknames to the left; several nicknames give several rows."""
    info = infos.select("stock_no", "business_scope", "competitor")
    return targets.select("stock_no", "stock_name").join(info, "stock_no", "left").join(nicknames.select("stock_no", "stock_nickname", "nickname_explain"), "stock_no", "left")


def missing(targets: DataFrame, infos: DataFrame) -> DataFrame:
    """Targets that infos lack."""
    return targets.join(infos.select("stock_no"), "stock_no", "left_anti")


def insert_or_ignore(stored: DataFrame, batch: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Stored rows and those of the batch whose key is new; of equal new keys the first by ``order`` enters. Null keys
    are never inserted."""
    columns = stored.columns
    fresh = batch.where(F.col(key).isNotNull()).join(stored.select(key).distinct(), key, "left_anti")
    value = F.struct(*columns)
    first = F.min_by(value, order) if order is not None else F.min(value)
    return stored.unionByName(fresh.groupBy(key).agg(first.alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in columns]))
