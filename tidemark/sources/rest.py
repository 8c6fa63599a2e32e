"""The data side of list, create, retrieve, update and delete: frames in, frames out. Serving them is up to a caller."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.predicates import page


def listed(frame: DataFrame, number: int = 1, size: int = 10, key: str = "id") -> DataFrame:
    return page(frame, number, size, key)


def retrieved(frame: DataFrame, ident: int, key: str = "id") -> DataFrame:
    return frame.where(F.col(key) == ident)


def created(frame: DataFrame, rows: DataFrame) -> DataFrame:
    return frame.unionByName(rows.select(*frame.columns))


def updated(frame: DataFrame, ident: int, changes: dict[str, Any], key: str = "id") -> DataFrame:
    """The named fields of one row replaced; other fields and rows stay (partial update), types stay too."""
    kinds = dict(frame.dtypes)
    put = lambda c: F.when(F.col(key) == ident, F.lit(changes[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c)
    return frame.select(*[put(c) if c in changes and c != key else F.col(c) for c in frame.columns])


def deleted(frame: DataFrame, ident: int, key: str = "id") -> DataFrame:
    return frame.where(~F.col(key).eqNullSafe(F.lit(ident)))
