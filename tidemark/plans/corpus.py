"""Queries of the general corpus operators (pN_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import nested
from tidemark.sources.tables import table


def _shredded(spark: SparkSession, folder: str, *roles: str) -> DataFrame:
    # Comments and targets need two columns; whole articles are hashed with all they have.
    articles = table(spark, folder, "articles", *(("id", "comments", "paragraph_stock_targets") if roles else ()))
    return nested.shred_forum(articles, table(spark, folder, "raw_records", "record_id", "payload"), roles or None)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each stock target, from bridge rows and the object store."""
    return nested.target_rows(_shredded(spark, folder, *nested.TARGET_ROLES))


def p3_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct object once, by its Merkle identity."""
    return nested.objects(_shredded(spark, folder))


def p3_bridges(spark: SparkSession, folder: str) -> DataFrame:
    """Every occurrence of every object with its parent."""
    return nested.bridges(_shredded(spark, folder))


def p3_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Flat comments and replies with the keys of their parents."""
    return nested.comment_rows(_shredded(spark, folder, "comment"))


QUERIES = {f.__name__: f for f in (p3_found, p3_objects, p3_bridges, p3_comments)}
