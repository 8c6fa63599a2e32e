"""Article and value filters with SQL's three-valued logic: a null never passes, not even a negated test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def article_filter(
    articles: DataFrame,
    start: str | None = None,
    end: str | None = None,
    tags_not: Sequence[str] = (),
    title_not: Sequence[str] = (),
    content_not: Sequence[str] = (),
    done: bool | None = None,
    ids_not: Sequence[int] = (),
) -> DataFrame:
    """Scan of articles. Bounds are inclusive, so a bare date as ``end`` admits its first instant only. Only simple
    predicates are used, so they reach the parquet scan."""
    tests: list[Column] = []
    time = F.col("paragraph_published_time")
    if start:
        tests.append(time >= F.to_timestamp_ntz(F.lit(_full(start))))
    if end:
        tests.append(time <= F.to_timestamp_ntz(F.lit(_full(end))))
    if tags_not:
        tests.append(~F.col("paragraph_tag").isin(*tags_not))
    tests += [~F.contains("paragraph_title", F.lit(t)) for t in title_not]
    tests += [~F.contains("paragraph_content", F.lit(t)) for t in content_not]
    if done is not None:
        tests.append(F.col("done_analyze") == done)
    if ids_not:
        tests.append(~F.col("id").isin(*ids_not))
    for test in tests:
        articles = articles.where(test)
    return articles


def _full(time: str) -> str:
    return time if len(time) > 10 else f"{time} 00:00:00"


def strictly_between(frame: DataFrame, column: str, low: str, high: str) -> DataFrame:
    """Open interval, unlike the inclusive bounds above."""
    return frame.where((F.col(column) > F.to_timestamp_ntz(F.lit(_full(low)))) & (F.col(column) < F.to_timestamp_ntz(F.lit(_full(high)))))


def without_prefix(frame: DataFrame, column: str, prefix: str) -> DataFrame:
    return frame.where(~F.col(column).startswith(prefix))


def all_analysed(comments: Column) -> Column:
    """Every comment of the list is analysed; true for an empty list, null for none."""
    return F.forall(comments["analyzed"], lambda a: F.coalesce(a, F.lit(False)))


def page(frame: DataFrame, number: int, size: int = 10, key: str = "id") -> DataFrame:
    """A page of rows in order of the key; numbers start at 1."""
    return frame.orderBy(key).offset(size * (number - 1)).limit(size)
