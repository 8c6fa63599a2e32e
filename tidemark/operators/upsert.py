"""Keeping stored articles current with scraped ones.

Decision per link, first match counts: stored and analysed - skip; not stored and failed - skip; not stored - insert;
stored with equal hash - skip; stored, scrape failed - skip; else overwrite all but id and the analysed flag. A batch
counts by its last good version per link; of stored duplicates the lowest id is the one that is kept current.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.collections import fingerprint
from tidemark.session import materialize

#: The fields that the change hash covers, before enrichment.
HASHED = ("paragraph_link", "paragraph_author", "paragraph_title", "paragraph_published_time", "paragraph_content", "paragraph_ip", "paragraph_country", "comments", "status")
KEPT = ("id", "done_analyze")


def article_hash(*fields: str) -> Column:
    return fingerprint(*[F.to_json(F.col(f)) if f == "comments" else F.col(f) for f in fields or HASHED])


def _quoted(text: Column) -> Column:
    """A text as JSON writes it with all but ASCII escaped."""
    signs = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def one(char: Column) -> Column:
        made = F.when(char.between(" ", "~") & ~char.isin('"', "\\"), char)
        for sign, short in signs.items():
            made = made.when(char == sign, short)
        return made.otherwise(_escape(char))

    plain = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one)
    return F.when(text.isNull(), "null").otherwise(F.concat(F.lit('"'), F.array_join(plain, ""), F.lit('"')))


def _escape(char: Column) -> Column:
    """A code point as one or two escaped UTF-16 units."""
    unit = lambda value: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(value), 4, "0")))
    code = F.ascii(char)
    over = code - 0x10000
    return F.when(code < 0x10000, unit(code)).otherwise(F.concat(unit(F.floor(over / 1024) + 0xD800), unit(over % 1024 + 0xDC00)))


def stored_hash(articles: DataFrame) -> Column:
    """The change hash in the form that existing tables hold: MD5 of the nine fields as JSON text with sorted keys, ', '
    between members and ': ' after keys, all but ASCII escaped. Comments keep the four fields they are scraped with. A
    missing time or text is null there; a time has the form of ``date_format``'s yyyy-MM-dd HH:mm:ss."""
    comment = lambda c: F.concat(
        F.lit('{"comment": '), _quoted(c["comment"]), F.lit(', "comment_score": '), F.coalesce(c["comment_score"].cast("string"), F.lit("null")),
        F.lit(', "comment_time": '), _quoted(c["comment_time"]), F.lit(', "commenter": '), _quoted(c["commenter"]), F.lit("}"),
    )
    time = F.col("paragraph_published_time")
    time = F.date_format(time, "yyyy-MM-dd HH:mm:ss") if dict(articles.dtypes)["paragraph_published_time"] != "string" else time
    value = {name: _quoted(F.col(name)) for name in HASHED} | {
        "paragraph_published_time": _quoted(time),
        "comments": F.coalesce(F.concat(F.lit("["), F.array_join(F.transform("comments", comment), ", "), F.lit("]")), F.lit("null")),
    }
    members = [F.concat(F.lit(f'"{name}": '), value[name]) for name in sorted(HASHED)]
    return F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}")))


def last_good(batch: DataFrame, order: str = "seq") -> DataFrame:
    """One row per link: the last version with status 200, else the last version."""
    rank = F.struct((F.col("status") == "200").alias("good"), F.col(order).alias("at"))
    columns = batch.columns
    return batch.where("paragraph_link is not null").groupBy("paragraph_link").agg(F.max_by(F.struct(*columns), rank).alias("r")).select("r.*")


def current(stored: DataFrame) -> DataFrame:
    """One stored row per link, that with the lowest id."""
    columns = stored.columns
    return stored.where("paragraph_link is not null").groupBy("paragraph_link").agg(F.min_by(F.struct(*columns), "id").alias("r")).select("r.*")


def classified(stored: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """(paragraph_link, action) with action insert, update, skip_analysed, skip_failed or skip_same."""
    s = current(stored).select("paragraph_link", F.col("id").alias("stored_id"), F.col("done_analyze").alias("done"), F.col("md5_hash").alias("old_hash"))
    b = last_good(batch, order).select("paragraph_link", "status", F.col("md5_hash").alias("new_hash"))
    action = (
        F.when(F.coalesce("done", F.lit(False)), "skip_analysed")
        .when(F.col("stored_id").isNull() & (F.col("status") != "200"), "skip_failed")
        .when(F.col("stored_id").isNull(), "insert")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "skip_same")
        .when(F.col("status") != "200", "skip_failed")
        .otherwise("update")
    )
    return b.join(s, "paragraph_link", "left").select("paragraph_link", action.alias("action"), "stored_id")


def applied(stored: DataFrame, batch: DataFrame, order: str = "seq", top: int | None = None) -> DataFrame:
    """The table after the batch. New ids follow the highest stored one (or ``top``, where ``stored`` is a part of the
    table), in order of link. Write the result to a new folder and switch; never over the folder being read."""
    fields = [c for c in stored.columns if c not in KEPT]
    decided = last_good(batch, order).select(*fields).join(classified(stored, batch, order), "paragraph_link")
    update = decided.where("action = 'update'").select(F.col("stored_id").alias("id"), F.struct(*fields).alias("new"))
    kept = stored.join(update, "id", "left")
    kept = kept.select(*[c if c in KEPT else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in stored.columns])
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() if top is None else F.lit(top)
    fresh = decided.where("action = 'insert'").select(*fields)
    fresh = numbered(fresh, "paragraph_link", "id")
    fresh = fresh.withColumns({"id": F.col("id") + top, "done_analyze": F.lit(False)}).select(*stored.columns)
    return kept.unionByName(fresh)


def numbered(frame: DataFrame, order: str, name: str) -> DataFrame:
    """Consecutive numbers from 1 in order of a column, without one task seeing all rows: rows are sorted by range, and
    each partition starts after the counts of those before it. The sorted rows are written once with their partition and
    place, as a second evaluation could draw other bounds. Equal values get their numbers in any order."""
    ranged = frame.repartitionByRange(order).sortWithinPartitions(order)
    marked = materialize(ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = marked.groupBy("_p").agg(F.count("*").alias("n"))
    offsets = counts.select("_p", (F.expr("sum(n) over (order by _p) - n")).alias("_o"))  # one row for each partition
    return marked.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_i") + F.col("_o") + 1).drop("_p", "_i", "_o")
