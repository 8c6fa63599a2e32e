"""Which stocks comments mention, and what follows from it: the market overview and its relatives.

A comment mentions the stocks its own targets name (name before code; an object stands for its key, then its value) and
the stocks of its article, which aren't checked against the reference list and whose names win. A stock counts once per
comment. Missing sentiment counts as 0 in the mean, as the sums are over all mentions.

Sums are over whole hundredths, so they don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.collections import first_pair, json_items, ordered_entries
from tidemark.operators.dictionary import small, token_lookup


def hundredths(sentiment: Column) -> Column:
    return F.round(F.coalesce(F.nanvl(sentiment, F.lit(0.0)), F.lit(0.0)) * 100).cast("bigint")


def exploded(articles: DataFrame, fields: Sequence[str], *columns: str) -> DataFrame:
    """One row per comment: columns of the article and the named fields of the comment. Fields are taken out of the list
    one by one before it is exploded, so that a scan reads no others."""
    zipped = F.arrays_zip(*[F.col(f"comments.{f}").alias(f) for f in fields])
    return articles.select("id", *columns, F.explode(zipped).alias("c")).select("id", *columns, *[F.col(f"c.{f}").alias(f) for f in fields])


def typed_targets(frame: DataFrame, *keys: str) -> DataFrame:
    """keys, target_pos, token, other: the elements of ``stock_targets``; ``other`` is an object's first value. Null, ""
    and {} make no row."""
    flat = frame.select(*keys, F.posexplode(json_items(F.col("stock_targets"))).alias("target_pos", "item")).where("item is not null and item <> ''")
    pair = first_pair(F.col("item"))
    flat = flat.withColumn("pair", pair).where("pair is not null or not startswith(item, '{')")
    return flat.select(*keys, "target_pos", F.coalesce("pair.key", "item").alias("token"), F.col("pair.value").alias("other"))


def resolved_targets(frame: DataFrame, targets: DataFrame, *keys: str) -> DataFrame:
    """keys, target_pos, stock_no, stock_name of the elements that name a stock exactly."""
    lookup = small(token_lookup(targets))
    # Without a second token the first is looked up again, so that no task gets all rows that have none.
    typed = typed_targets(frame, *keys).withColumn("other", F.coalesce("other", "token"))
    a = lookup.select("token", F.col("stock_no").alias("no_a"), F.col("stock_name").alias("name_a"))
    b = lookup.select(F.col("token").alias("other"), F.col("stock_no").alias("no_b"), F.col("stock_name").alias("name_b"))
    found = typed.join(a, "token", "left").join(b, "other", "left").withColumns({"stock_no": F.coalesce("no_a", "no_b"), "stock_name": F.when(F.col("no_a").isNotNull(), F.col("name_a")).otherwise(F.col("name_b"))})
    return found.where("stock_no is not null").select(*keys, "target_pos", "stock_no", "stock_name")


def _candidates(stock_targets: Column, above: Column) -> Column:
    """What a comment may mention as one list of (ord, token, other, name, own): its own targets in order, then the
    article's in stored order."""
    own = F.filter(json_items(stock_targets), lambda x: x.isNotNull() & (x != ""))
    own = F.transform(own, lambda x, i: F.struct(i.alias("i"), x.alias("item"), first_pair(x).alias("pair")))
    own = F.filter(own, lambda x: x["pair"].isNotNull() | ~x["item"].startswith("{"))
    none = F.lit(None).cast("string")
    own = F.transform(own, lambda x: F.struct(x["i"].alias("ord"), F.coalesce(x["pair"]["key"], x["item"]).alias("token"), x["pair"]["value"].alias("other"), none.alias("name"), F.lit(1).alias("own")))
    given = F.transform(ordered_entries(above), lambda e, i: F.struct((i + 1_000_000).alias("ord"), e["key"].alias("token"), none.alias("other"), e["value"].alias("name"), F.lit(0).alias("own")))
    empty = F.array().cast("array<struct<ord:int,token:string,other:string,name:string,own:int>>")
    return F.concat(F.coalesce(own, empty), F.coalesce(given, empty))


def mentions(articles: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per comment and stock: id, pos, paragraph_published_time, sent_c, stock_no, stock_name, ord, own, inherited.

    One pass over the articles; both joins are with the reference list, and the only shuffle is that of the dedupe, which
    is a hash aggregate: equal stocks of a comment have equal names by then, as the article's name is put in beforehand.
    """
    time, above = "paragraph_published_time", "paragraph_stock_targets"
    rows = exploded(articles, ("pos", "stock_sentiment", "stock_targets"), time, above)
    rows = rows.select("id", "pos", time, hundredths(F.col("stock_sentiment")).alias("sent_c"), above, F.explode(_candidates(F.col("stock_targets"), F.col(above))).alias("m"))
    # Keys are never null, so that without a broadcast no task would get all rows that have none.
    rows = rows.withColumns({"token": F.col("m.token"), "other": F.coalesce("m.other", "m.token")})
    lookup = small(token_lookup(targets))
    a = lookup.select("token", F.col("stock_no").alias("no_a"), F.col("stock_name").alias("name_a"))
    b = lookup.select(F.col("token").alias("other"), F.col("stock_no").alias("no_b"), F.col("stock_name").alias("name_b"))
    rows = rows.join(a, "token", "left").join(b, "other", "left")
    named = F.col("no_a").isNotNull()
    stock = F.when(F.col("m.own") == 0, F.col("token")).when(named, F.col("no_a")).otherwise(F.col("no_b"))
    rows = rows.withColumn("stock_no", stock).where(F.col("stock_no").isNotNull())
    given = F.coalesce(F.map_contains_key(above, F.col("stock_no")), F.lit(False))
    name = F.when(given, F.try_element_at(above, F.col("stock_no"))).when(named, F.col("name_a")).otherwise(F.col("name_b"))
    keys = ("id", "pos", time, "sent_c", "stock_no", "stock_name")
    return rows.withColumn("stock_name", name).groupBy(*keys).agg(F.min("m.ord").alias("ord"), F.max("m.own").alias("own"), F.max(1 - F.col("m.own")).alias("inherited"))


def market_overview(articles: DataFrame, targets: DataFrame, exclude: tuple[str, ...] = (), top: int = 20) -> DataFrame:
    """The stocks most talked about: stock_no, stock_name, mentions, mean_sentiment.

    The name is the one seen first (newest article, then comment order), and equal counts keep that order.
    """
    found = mentions(articles, targets).where(~F.col("stock_no").isin(*exclude)) if exclude else mentions(articles, targets)
    seen = F.struct((-F.unix_micros(F.col("paragraph_published_time").cast("timestamp"))).alias("t"), "id", "pos", "ord")
    per = found.groupBy("stock_no").agg(F.count("*").alias("mentions"), F.sum("sent_c").alias("sum_c"), F.min_by("stock_name", seen).alias("stock_name"), F.min(seen).alias("seen"))
    best = per.orderBy(F.desc("mentions"), "seen").limit(top)
    return best.select("stock_no", "stock_name", "mentions", F.round(F.col("sum_c") / F.col("mentions") / 100, 6).alias("mean_sentiment"))


def period_summary(articles: DataFrame, targets: DataFrame) -> DataFrame:
    """Per stock: articles about it, comments that name it themselves, comments that inherit it, mean sentiment."""
    found = mentions(articles, targets)
    per = found.groupBy("stock_no").agg(
        F.sum(F.col("own").cast("bigint")).alias("own_mentions"), F.sum(F.col("inherited").cast("bigint")).alias("inherited_mentions"),
        F.count("*").alias("mentions"), F.sum("sent_c").alias("sum_c"),
    )
    about = articles.select("id", F.explode(F.map_keys("paragraph_stock_targets")).alias("stock_no")).groupBy("stock_no").agg(F.count("*").alias("article_mentions"))
    joined = per.join(about, "stock_no", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("stock_no", zero("article_mentions"), zero("own_mentions"), zero("inherited_mentions"), F.round(F.try_divide("sum_c", "mentions") / 100, 6).alias("mean_sentiment"))


def daily_sentiment(articles: DataFrame, targets: DataFrame) -> DataFrame:
    """Per stock and day: mentions and mean sentiment."""
    day = F.date_trunc("day", "paragraph_published_time").cast("timestamp_ntz").alias("day")
    per = mentions(articles, targets).groupBy("stock_no", day).agg(F.count("*").alias("mentions"), F.sum("sent_c").alias("sum_c"))
    return per.select("stock_no", "day", "mentions", F.round(F.col("sum_c") / F.col("mentions") / 100, 6).alias("mean_sentiment"))


def mood_ranking(articles: DataFrame, targets: DataFrame, bullish: bool, top: int = 10, least: int = 3) -> DataFrame:
    """The stocks with the best or worst mean sentiment among those mentioned ``least`` times."""
    per = mentions(articles, targets).groupBy("stock_no").agg(F.count("*").alias("mentions"), F.sum("sent_c").alias("sum_c")).where(F.col("mentions") >= least)
    per = per.select("stock_no", "mentions", F.round(F.col("sum_c") / F.col("mentions") / 100, 6).alias("mean_sentiment"))
    return per.orderBy(F.desc("mean_sentiment") if bullish else F.asc("mean_sentiment"), F.desc("mentions"), "stock_no").limit(top)


def supporting_comments(articles: DataFrame, targets: DataFrame, stocks: DataFrame, each: int = 3) -> DataFrame:
    """For each stock of a ranking, its strongest comments: top ``each`` by distance of sentiment from 0."""
    found = mentions(articles, targets).join(small(stocks.select("stock_no")), "stock_no")
    texts = exploded(articles, ("pos", "comment"))
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by stock_no order by abs(sent_c) desc, id, pos)")).where(F.col("rank") <= each)
    return ranked.join(texts, ["id", "pos"]).select("stock_no", "rank", "id", "pos", "comment", "sent_c")


def most_pushed(articles: DataFrame, top: int = 10) -> DataFrame:
    """The articles with most pushes; computed in place on the comment list, no explode or shuffle before the top-k."""
    pushes = F.size(F.filter(F.col("comments.comment_score"), lambda s: s > 0)).cast("bigint")
    return articles.select("id", "paragraph_title", F.greatest(F.coalesce(pushes, F.lit(0)), F.lit(0)).alias("pushes")).orderBy(F.desc("pushes"), "id").limit(top)


def commenter_stats(comments: DataFrame, top: int = 10) -> DataFrame:
    """Commenters by number of scored comments, with their mean sentiment."""
    per = comments.where("commenter is not null").groupBy("commenter").agg(
        F.count("*").alias("comments"), F.sum((F.col("stock_sentiment").isNotNull()).cast("bigint")).alias("scored"), F.sum(hundredths(F.col("stock_sentiment"))).alias("sum_c")
    )
    return per.orderBy(F.desc("scored"), "commenter").limit(top).select("commenter", "comments", "scored", F.round(F.try_divide("sum_c", "scored") / 100, 6).alias("mean_sentiment"))


def rolling_windows(articles: DataFrame, days: tuple[int, ...] = (1, 15, 30)) -> DataFrame:
    """Articles and comments of the last 1, 15 and 30 days before the newest article, in one pass after the maximum."""
    newest = articles.agg(F.max("paragraph_published_time")).scalar()
    sized = articles.select("paragraph_published_time", F.greatest(F.size("comments.pos"), F.lit(0)).alias("n"))
    rows = sized.select("*", F.explode(F.array(*[F.lit(d) for d in days])).alias("days"))
    inside = rows.where(F.col("paragraph_published_time") > newest - F.make_dt_interval("days"))
    return inside.groupBy("days").agg(F.count("*").alias("articles"), F.sum("n").alias("comments"))
