"""Comments to a scorer and back: batching, pluggable scoring with retries, checks, and rewriting of articles.

A scorer takes a list of texts and returns as many (sentiment, targets). ``lexicon_scorer`` is a deterministic stand-in
for a model, good for tests and for running the pipeline end to end; it is no reproduction of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

Scorer = Callable[[list[str]], list[tuple[float, list[str]]]]
BATCH = 45

# Words of rising and falling mood of the stand-in scorer.
BULLISH = ("看好", "加碼", "樂觀", "買", "漲", "穩", "偏多", "安心")
BEARISH = ("倒貨", "停損", "偏空", "賣", "跌", "疲弱", "慌", "後悔")
SCORED = "id bigint, pos int, stock_sentiment double, stock_targets array<string>"


def lexicon_sentiment(text: Column) -> Column:
    """Words found, signed, a quarter each, within [-1, 1]; 0 for null."""
    hit = lambda word: F.when(F.contains(text, F.lit(word)), 1).otherwise(0)
    total = sum((hit(w) for w in BULLISH), F.lit(0)) - sum((hit(w) for w in BEARISH), F.lit(0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / 4.0))


def lexicon_scorer(texts: list[str]) -> list[tuple[float, list[str]]]:
    score = lambda t: max(-1.0, min(1.0, (sum(w in t for w in BULLISH) - sum(w in t for w in BEARISH)) / 4))
    return [(score(t or ""), []) for t in texts]


def batched(articles: DataFrame, size: int = BATCH) -> DataFrame:
    """(id, batch, positions, texts): comments of each article in batches by position. Arrays only, no shuffle."""
    texts = F.col("comments.comment")  # one field of the list, so a scan reads no other
    count = F.ceil(F.size(texts) / size).cast("int")
    rows = articles.where(F.size(texts) > 0).select("id", texts.alias("texts"), F.explode(F.sequence(F.lit(0), count - 1)).alias("batch"))
    first = F.col("batch") * size
    part = F.slice("texts", first + 1, F.lit(size))
    return rows.select("id", "batch", F.sequence(first, first + F.size(part) - 1).alias("positions"), part.alias("texts"))


def pending(articles: DataFrame, size: int = BATCH) -> DataFrame:
    """The batches that still hold a comment without analysis, so that an interrupted run goes on where it stopped."""
    open_at = F.transform(F.col("comments.analyzed"), lambda a, i: F.when(~F.coalesce(a, F.lit(False)), F.floor(i / size).cast("int")))
    todo = articles.select("id", F.explode(F.array_distinct(F.array_compact(open_at))).alias("batch"))
    return batched(articles, size).join(todo, ["id", "batch"], "left_semi")


def analysed_counts(articles: DataFrame) -> DataFrame:
    """(id, comments, analysed) of each article, counted in place."""
    done = F.size(F.filter(F.col("comments.analyzed"), lambda a: F.coalesce(a, F.lit(False))))
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("bigint")
    return articles.select("id", zero(F.size("comments.analyzed")).alias("comments"), zero(done).alias("analysed"))


def chunks_without_remainder(frame: DataFrame, key: str, pieces: int) -> DataFrame:
    """Rows in ``pieces`` pieces of equal size by order of key; what doesn't fill the last one is dropped, and with fewer
    rows than pieces nothing is left."""
    from tidemark.operators.upsert import numbered

    size = frame.agg(F.expr(f"count(*) div {pieces}")).scalar()
    placed = numbered(frame, key, "_n")
    return placed.withColumn("_size", size).where("_size > 0").withColumn("piece", F.expr("(_n - 1) div _size")).where(F.col("piece") < pieces).drop("_n", "_size")


def scored(batches: DataFrame, scorer: Scorer = lexicon_scorer, retries: int = 3) -> DataFrame:
    """(id, pos, stock_sentiment, stock_targets). A wrong number of results or a ValueError is retried, then fails the
    job; other errors fail at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, positions, texts in zip(pdf["id"], pdf["positions"], pdf["texts"]):
                for left in range(retries, -1, -1):
                    try:
                        results = scorer(list(texts))
                        if len(results) != len(texts):
                            raise ValueError(f"{len(results)} results for {len(texts)} comments")
                        break
                    except ValueError:
                        if not left:
                            raise
                rows += [(key, p, float(s), list(t)) for p, (s, t) in zip(positions, results)]
            yield pd.DataFrame(rows, columns=["id", "pos", "stock_sentiment", "stock_targets"])

    return batches.mapInPandas(run, SCORED)


def rewritten(articles: DataFrame, scores: DataFrame) -> DataFrame:
    """Articles with the scores put into their comments by position; comments without a score stay, and an article is
    done when all its comments are analysed."""
    per = scores.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("stock_sentiment", F.to_json("stock_targets").alias("stock_targets"))))).alias("s"))
    joined = articles.join(per, "id", "left")
    new = F.transform(
        "comments",
        lambda c, i: F.when(F.col("s").isNull() | F.get(F.array(F.try_element_at("s", i.cast("int"))), F.lit(0)).isNull(), c).otherwise(
            c.withField("stock_sentiment", F.try_element_at("s", i.cast("int"))["stock_sentiment"])
            .withField("stock_targets", F.try_element_at("s", i.cast("int"))["stock_targets"])
            .withField("analyzed", F.lit(True))
        ),
    )
    done = F.coalesce(F.forall("comments", lambda c: F.coalesce(c["analyzed"], F.lit(False))), F.col("done_analyze"))
    return joined.withColumn("comments", new).withColumn("done_analyze", done).drop("s").select(*articles.columns)


def parsed_results(text: Column) -> Column:
    """Model output as a list of (stock_sentiment, stock_targets): a list, or an object keyed by index; null if invalid."""
    one = "struct<stock_sentiment:double,stock_targets:array<string>>"
    keyed = F.from_json(text, f"map<string,{one}>")
    by_index = F.transform(F.array_sort(F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].cast("int").alias("i"), e["value"].alias("v")))), lambda e: e["v"])
    return F.when(F.trim(text).startswith("["), F.from_json(text, f"array<{one}>")).otherwise(by_index)
