"""Named queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import abuse, bytepairs, canonical, cuts, forms, names, packing, spans
from tidemark.sources.tables import table


_TRAINED: dict[int, dict | None] = {}


def _reviewable(spark: SparkSession, folder: str) -> DataFrame:
    """(src, row_id, source, text) of the three fields that people write freely."""
    fields = (("comments", "comment_id", "comment"), ("articles", "id", "paragraph_content"), ("documents", "doc_id", "text"))
    parts = [table(spark, folder, src, key, "source", text).select(F.lit(src).alias("src"), F.col(key).alias("row_id"), "source", F.col(text).alias("text")) for src, key, text in fields]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _abuse_scores(spark: SparkSession, folder: str) -> DataFrame:
    texts, labels = _reviewable(spark, folder), table(spark, folder, "review_labels")
    listed = names.lexicon(table(spark, folder, "targets", "stock_name"), table(spark, folder, "nicknames", "stock_nickname"))
    sample, marks = abuse.reviewed(texts, labels)
    others = abuse.unreviewed(texts, labels) if sample else []
    # One network for equal samples in a session: its three queries needn't train anew.
    key = hash((tuple(sample), tuple(marks), tuple(others), tuple(listed)))
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = abuse.train(sample, marks, abuse.Reader(listed), others) if sample else None
    params = _TRAINED[key]
    return abuse.scored(bytepairs.spread(texts, "row_id"), params, listed)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that hold an abusive, hateful or sexually explicit passage."""
    return _abuse_scores(spark, folder).where(F.col("score") >= abuse.THRESHOLD).select("src", "row_id")


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every row."""
    return _abuse_scores(spark, folder)


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source holds such passages."""
    return abuse.rates(_abuse_scores(spark, folder))


def _cut_scores(spark: SparkSession, folder: str) -> DataFrame:
    listed = names.lexicon(table(spark, folder, "targets", "stock_name"), table(spark, folder, "nicknames", "stock_nickname"))
    texts = cuts.texts_of(table(spark, folder, "comments", "comment_id", "source", "comment"), table(spark, folder, "articles", "id", "source", "paragraph_title"))
    return cuts.scored(texts, listed)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose comment or title was cut before its end."""
    return _cut_scores(spark, folder).where("p_cut >= 0.5").select("src", "row_id")


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The probability of a cut for each row."""
    return _cut_scores(spark, folder)


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts."""
    return cuts.rates(_cut_scores(spark, folder))


def _forum_texts(spark: SparkSession, folder: str) -> DataFrame:
    return forms.forum_texts(
        table(spark, folder, "comments", "comment_id", "comment"), table(spark, folder, "articles", "id", "paragraph_title", "paragraph_content")
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows that look the same but differ in characters."""
    return forms.lookalike_pairs(_forum_texts(spark, folder))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that have a look-alike, with their class and how many differ in characters."""
    return forms.lookalike_classes(_forum_texts(spark, folder))


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The one consistent form of each text, and one for reading."""
    return forms.forms(_forum_texts(spark, folder))


def _typed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, folder, "comments", "comment_id", "stock_targets"), table(spark, folder, "targets", "stock_no", "stock_name"),
        table(spark, folder, "nicknames", "stock_no", "stock_nickname"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The code each typed stock target stands for."""
    return canonical.resolved(*_typed(spark, folder))


def p5_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Typed values that stand for no stock, with counts."""
    return canonical.unmatched(*_typed(spark, folder))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document; null and empty texts have the empty list."""
    documents = bytepairs.spread(_documents(spark, folder))
    return bytepairs.encoded(documents, documents["doc_id"], documents["text"])


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder)
    dealt = bytepairs.spread(documents)
    return packing.assignments(bytepairs.token_counts(dealt, dealt["doc_id"], dealt["text"]), documents.count())


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document or piece of one."""
    return _assigned(spark, folder)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """What each container holds and leaves unused."""
    return packing.containers(_assigned(spark, folder))


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Unused space over all containers."""
    return packing.totals(_assigned(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents with a common span of 100 or more characters."""
    return spans.shared_pairs(_documents(spark, folder))


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the class of their text and the number of others that share a span."""
    return spans.document_classes(_documents(spark, folder))


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The shared stretches of each document."""
    return spans.document_spans(_documents(spark, folder))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """For each document, how much of its text stands elsewhere too."""
    return spans.document_shares(_documents(spark, folder))


_ALL = (p1_found, p1_scores, p1_rates, p2_found, p2_scores, p2_rates, p4_found, p4_classes, p4_forms, p5_found, p5_unmatched, p6_ids, p7_packed, p7_containers, p7_totals, p8_found, p8_classes, p8_spans, p8_shares)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = {}
