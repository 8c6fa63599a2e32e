"""Names of the reference list inside texts: substrings, whole tokens, and similar tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.distance import restricted_distance_col
from tidemark.functions.text import plain_tokens

#: Lists up to this size are matched by an automaton on every worker; larger ones by joining substrings.
AUTOMATON_NAMES = 200_000
#: What a scorer is told about a comment that names nothing.
NO_MATCH = "No listed company matches."


def contained(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, token): every listed name that stands in the text, overlapping ones too. Empty names match nothing."""
    column = names.columns[0]
    listed = names.where(F.col(column).isNotNull() & (F.col(column) != "")).distinct()
    taken = listed.limit(AUTOMATON_NAMES + 1).collect()
    if len(taken) > AUTOMATON_NAMES:
        return _contained_by_join(texts, key, text, listed.toDF("token"))
    words = sorted(r[0] for r in taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word in words:
            machine.add_word(word, word)
        if words:
            machine.make_automaton()
        for batch in batches:
            owners, hits = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                if value and words:
                    found = sorted({word for _, word in machine.iter(value)})
                    owners += [i] * len(found)
                    hits += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), pa.array(hits, pa.string())], names=[key, "token"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, token string")


def _contained_by_join(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """The same by an equi-join of all substrings of the lengths that names have."""
    lengths = F.array_sort(F.collect_set(F.length("token")))
    parts = texts.where(F.col(text) != "").withColumn("_sizes", names.agg(lengths).scalar()).select(key, text, F.explode("_sizes").alias("_n"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - F.col("_n") + 1))
    cut = parts.select(key, F.explode(starts).alias("_i"), "_n", text).select(key, F.col(text).substr(F.col("_i"), F.col("_n")).alias("token"))
    return cut.distinct().join(names, "token", "left_semi").select(key, "token")


def exact_tokens(texts: DataFrame, key: str, text: str, names: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(key, token): tokens of the text that are names, each once per row."""
    column = names.columns[0]
    listed = names.where(F.col(column).isNotNull()).select(F.col(column).alias("token")).distinct()
    words = texts.select(key, F.explode(F.array_distinct(tokens if tokens is not None else plain_tokens(F.col(text)))).alias("token"))
    return words.join(listed, "token", "left_semi").select(key, "token")


def extracted(texts: DataFrame, key: str, text: str, extractor: Callable[[list[str]], list[list[tuple[str, str]]]], labels: Sequence[str], names: DataFrame) -> DataFrame:
    """(key, token): spans that an extractor labels so and that are listed names. ``extractor`` is the model: texts in, a
    list of (label, span) for each out."""
    wanted = set(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = extractor([t or "" for t in batch.column(1).to_pylist()])
            rows = [(i, span) for i, spans in enumerate(found) for span in dict.fromkeys(s for label, s in spans if label in wanted)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())), pa.array([s for _, s in rows], pa.string())], names=[key, "token"])

    column = names.columns[0]
    listed = names.where(F.col(column).isNotNull()).select(F.col(column).alias("token")).distinct()
    spans = texts.select(key, text).mapInArrow(run, f"`{key}` {dict(texts.dtypes)[key]}, token string")
    return spans.join(listed, "token", "left_semi").select(key, "token")


def similarity(distance: Column, a: Column, b: Column) -> Column:
    return F.lit(1.0) - distance / F.greatest(F.length(a), F.length(b))


def fuzzy_pairs(tokens: DataFrame, entries: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(token, stock_no, kind, entry, similarity) of tokens similar to entries (stock_no, kind, entry).

    Similarity is 1 - restricted edit distance / longer length, and must reach the threshold of the entry's kind. Distinct
    tokens only are compared, and only where two facts leave it possible: equal texts; or texts of like length that share
    a piece left untouched (k edits leave one of k + 1 pieces whole, at an offset of at most k). So this is an equi-join on
    pieces, not all pairs.
    """
    words = tokens.where("token is not null and token <> ''").select("token").distinct()
    listed = entries.where("entry is not null and entry <> ''").select("stock_no", "kind", "entry").distinct()
    floor = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in thresholds.items()], F.lit(1.0))
    # Edits that the longest admissible partner allows, counted from the entry's side.
    n = F.length("entry")
    edits = F.floor(n * (1 - floor) / floor + 1e-9).cast("int")
    cuts = listed.select("stock_no", "kind", "entry", n.alias("n"), floor.alias("floor"), edits.alias("edits"))
    # A swap of neighbours may touch two pieces, so entries are cut for twice the edits.
    cuts = cuts.withColumn("pieces", F.least(F.col("n"), 2 * F.col("edits") + 1))
    spread = cuts.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i"))
    start = F.expr("cast(floor(i * n / pieces) as int)")
    stop = F.expr("cast(floor((i + 1) * n / pieces) as int)")
    spread = spread.withColumns({"at": start, "piece": F.col("entry").substr(start + 1, stop - start)})
    sizes = spread.agg(F.array_sort(F.collect_set(F.length("piece")))).scalar()  # at most as many as an entry is long
    grams = words.withColumn("sizes", sizes).select("token", F.explode("sizes").alias("size")).where(F.length("token") >= F.col("size")).select(
        "token", F.explode(F.expr("transform(sequence(0, length(token) - size), j -> struct(j as j, substring(token, j + 1, size) as piece))")).alias("g")
    ).select("token", F.col("g.j").alias("j"), F.col("g.piece").alias("piece"))
    near = spread.join(grams, "piece").where("abs(at - j) <= edits")
    longer = F.greatest(F.length("token"), F.col("n"))
    allowed = F.floor((1 - F.col("floor")) * longer + 1e-9)
    near = near.where(F.abs(F.length("token") - F.col("n")) <= allowed)
    near = near.where(F.levenshtein("token", "entry", 64) <= 2 * allowed).select("token", "stock_no", "kind", "entry", "floor").distinct()
    measured = near.withColumn("distance", F.when(F.col("token") == F.col("entry"), 0).otherwise(restricted_distance_col("token", "entry")))
    rated = measured.withColumn("similarity", similarity(F.col("distance"), F.col("token"), F.col("entry")))
    return rated.where("similarity >= floor").select("token", "stock_no", "kind", "entry", "similarity")


def best_matches(pairs: DataFrame) -> DataFrame:
    """One row per token: the highest similarity; among equals the smaller code, then nickname before code before name."""
    order = F.when(F.col("kind") == "nickname", 0).when(F.col("kind") == "code", 1).otherwise(2)
    rank = F.struct((-F.col("similarity")).alias("s"), "stock_no", order.alias("k"), "entry")
    return pairs.groupBy("token").agg(F.min_by(F.struct("stock_no", "kind", "entry", "similarity"), rank).alias("m")).select("token", "m.*")


def context_lines(matches: DataFrame, dataset: DataFrame, nicknames: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(key, context): for each matched token a line by kind of match, then the introductions of those companies that have
    a competitor. Similarities are in per cent, rounded half to even. ``keys``: all keys wanted; those without a match say so.

    matches: key, token, stock_no, kind, entry, similarity; dataset: stock_no, stock_name, business_scope, competitor;
    nicknames: stock_no, stock_nickname, nickname_explain.
    """
    percent = F.format_string("%.2f", F.bround(F.col("similarity") * 100, 2))
    known = dataset.select("stock_no", "stock_name", "business_scope", "competitor").dropDuplicates(["stock_no"])
    names = matches.join(known, "stock_no", "left")
    if nicknames is not None:
        why = nicknames.where("stock_no is not null").groupBy("stock_no", F.col("stock_nickname").alias("entry")).agg(F.min("nickname_explain").alias("why"))
        names = names.join(why, ["stock_no", "entry"], "left")
    else:
        names = names.withColumn("why", F.lit(None).cast("string"))
    because = F.when(F.col("why").isNull(), "").otherwise(F.concat(F.lit(" ("), F.col("why"), F.lit(")")))
    line = (
        F.when(F.col("kind") == "nickname", F.format_string("%s: similar to the nickname %s of %s (%s), %s %%%s", "token", "entry", "stock_name", "stock_no", percent, because))
        .when(F.col("kind") == "code", F.format_string("%s: similar to the code of %s (%s), %s %%", "token", "stock_name", "stock_no", percent))
        .otherwise(F.format_string("%s: similar to the name %s (%s), %s %%", "token", "entry", "stock_no", percent))
    )
    about = F.when(F.col("competitor").isNotNull(), F.format_string("%s (%s): %s", "stock_name", "stock_no", F.coalesce("business_scope", F.lit(""))))
    per = names.select("key", "token", "stock_no", line.alias("line"), about.alias("about")).groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("token", "stock_no", "line"))).alias("l"), F.array_sort(F.collect_set(F.struct("stock_no", "about"))).alias("a")
    )
    text = F.concat_ws("\n", F.transform("l", lambda x: x["line"]), F.transform("a", lambda x: x["about"]))
    found = per.select("key", text.alias("context"))
    if keys is None:
        return found
    return keys.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("context", F.lit(NO_MATCH)).alias("context"))


def scored_with_context(comments: DataFrame, contexts: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[tuple[float, list[str]]]], key: str, text: str) -> DataFrame:
    """(key, stock_sentiment, stock_targets) of comments scored together with their context. ``scorer`` is the model: a list
    of (comment, context) in, as many (sentiment, targets) out; it is called per Arrow batch. Null comments count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            made = scorer(pairs)
            if len(made) != len(pairs):
                raise ValueError(f"{len(made)} results for {len(pairs)} comments")
            sentiments, targets = pa.array([float(s) for s, _ in made], pa.float64()), pa.array([list(t) for _, t in made], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sentiments, targets], names=[key, "stock_sentiment", "stock_targets"])

    rows = comments.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(contexts.select(F.col("key").alias(key), "context"), key, "left")
    rows = rows.select(key, "_text", F.coalesce("context", F.lit(NO_MATCH)).alias("context"))
    return rows.mapInArrow(run, f"`{key}` {dict(comments.dtypes)[key]}, stock_sentiment double, stock_targets array<string>")
