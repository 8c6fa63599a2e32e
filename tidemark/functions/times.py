"""Forum times. Everything is without zone; what can't be parsed is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

#: Fixed value: the time given to articles without one.
DEFAULT_TIME = "2007-01-01 00:00:00"


def _ntz(value: Column) -> Column:
    return value.cast("timestamp_ntz")


def forum_time(text: Column) -> Column:
    """'Sat Jun  1 08:00:07 2024' (also with the misspelt weekday 'Tus'); the weekday isn't checked."""
    body = F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]{3}\s+", ""), r"\s+", " ")
    return _ntz(F.try_to_timestamp(body, F.lit("MMM d HH:mm:ss yyyy")))


def comment_time(text: Column, article_time: Column) -> Column:
    """'06/01 08:00' in the article's year; a full time stays as it is. 02/29 parses in leap years; a comment made in
    January on a December article keeps the article's year."""
    clean = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    grafted = F.try_to_timestamp(F.concat(F.year(article_time).cast("string"), F.lit("-"), clean), F.lit("yyyy-MM/dd HH:mm"))
    return _ntz(F.coalesce(F.try_to_timestamp(clean, F.lit("yyyy-MM-dd HH:mm")), grafted))


def or_default(time: Column) -> Column:
    return F.coalesce(time, F.to_timestamp_ntz(F.lit(DEFAULT_TIME)))


def carried_forward(time: Column, page: str, *order: str) -> Column:
    """The last known time of the same page up to this row. Rows without a page keep their own time: they have no order
    among each other, and would all meet in one task."""
    own = F.when(F.col(page).isNull(), F.struct(*order))
    return F.last(time, ignorenulls=True).over(Window.partitionBy(page, own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
