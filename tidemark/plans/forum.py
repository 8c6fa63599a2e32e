"""Named queries of the forum operators over whole tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import collections as C
from tidemark.functions import text as T
from tidemark.functions import times
from tidemark.operators import dictionary, enrich, entities, mentions, predicates, upsert, vectors
from tidemark.sources import files, rest
from tidemark.sources.tables import run_sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The analysed articles that reports are about.
PERIOD = {"start": "2024-06-01", "end": "2024-12-31 23:59:59"}
TAGS_NOT = ("公告", "創作", "閒聊")
TITLE_NOT, CONTENT_NOT = ("水桶",), ("違反板規",)
EXCLUDED = ("3167",)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _analysed(spark: SparkSession, folder: str) -> DataFrame:
    return predicates.article_filter(table(spark, folder, "articles"), **PERIOD, tags_not=TAGS_NOT, title_not=TITLE_NOT, content_not=CONTENT_NOT, done=True)


_FILTER = """paragraph_published_time BETWEEN TIMESTAMP '2024-06-01 00:00:00' AND TIMESTAMP '2024-12-31 23:59:59'
    AND paragraph_tag NOT IN ('公告', '創作', '閒聊') AND paragraph_title NOT LIKE '%水桶%' AND paragraph_content NOT LIKE '%違反板規%'"""

_LOOKUP = """lookup AS (
  SELECT token, arg_min(stock_no, prio) AS stock_no, arg_min(stock_name, prio) AS stock_name FROM (
    SELECT stock_name AS token, max(stock_no) AS stock_no, stock_name, 0 AS prio FROM targets WHERE stock_name <> '' GROUP BY stock_name
    UNION ALL
    SELECT stock_no, stock_no, coalesce(max(stock_name), ''), 1 FROM targets WHERE stock_no <> '' GROUP BY stock_no) GROUP BY token)"""

_ITEMS = "CASE WHEN json_type(stock_targets) = 'ARRAY' THEN json_extract(stock_targets, '$[*]') ELSE [stock_targets::JSON] END"
_TOKEN = "CASE json_type(j) WHEN 'OBJECT' THEN json_keys(j)[1] ELSE j ->> '$' END"
_OTHER = "CASE json_type(j) WHEN 'OBJECT' THEN json_extract_string(j, '$.*')[1] END"

_MENTIONS = f"""WITH {_LOOKUP},
art AS (SELECT * FROM articles WHERE {_FILTER} AND done_analyze),
c AS (SELECT id, paragraph_published_time AS t, paragraph_stock_targets AS above, unnest(comments) AS u FROM art),
c2 AS (SELECT id, t, above, u.pos AS pos, u.stock_targets AS stock_targets,
  CAST(round(coalesce(u.stock_sentiment, 0) * 100) AS BIGINT) AS sent_c FROM c),
e AS (SELECT id, t, pos, sent_c, unnest(items) AS j, generate_subscripts(items, 1) - 1 AS ord
  FROM (SELECT *, {_ITEMS} AS items FROM c2 WHERE stock_targets IS NOT NULL)),
typed AS (SELECT id, t, pos, sent_c, ord, {_TOKEN} AS token, {_OTHER} AS other FROM e),
own AS (SELECT id, t, pos, sent_c, ord, coalesce(a.stock_no, b.stock_no) AS stock_no,
    CASE WHEN a.stock_no IS NOT NULL THEN a.stock_name ELSE b.stock_name END AS stock_name, 1 AS own
  FROM typed LEFT JOIN lookup a ON typed.token = a.token LEFT JOIN lookup b ON typed.other = b.token
  WHERE coalesce(a.stock_no, b.stock_no) IS NOT NULL),
up AS (SELECT id, t, pos, sent_c, 1000000 + row_number() OVER (PARTITION BY id, pos ORDER BY strlen(m.key), m.key) - 1 AS ord,
    m.key AS stock_no, m.value AS stock_name, 0 AS own FROM (SELECT id, t, pos, sent_c, unnest(map_entries(above)) AS m FROM c2)),
mention AS (SELECT id, pos, t, sent_c, stock_no, arg_max(stock_name, (1 - own) * 10000000 + ord) AS stock_name, min(ord) AS ord,
    max(own) AS own, max(1 - own) AS inherited
  FROM (SELECT * FROM own UNION ALL SELECT * FROM up) GROUP BY id, pos, t, sent_c, stock_no)
"""


@query(
    _MENTIONS
    + """SELECT stock_no, arg_min(stock_name, k) AS stock_name, count(*) AS mentions, round(CAST(sum(sent_c) AS DOUBLE) / count(*) / 100, 6) AS mean_sentiment
FROM (SELECT *, row_number() OVER (ORDER BY t DESC, id, pos, ord) AS k FROM mention WHERE stock_no <> '3167')
GROUP BY stock_no ORDER BY mentions DESC, min(k) LIMIT 20"""
)
def market_overview(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty stocks most talked about in the period."""
    return mentions.market_overview(_analysed(spark, folder), table(spark, folder, "targets"), EXCLUDED)


@query(
    _MENTIONS
    + """, per AS (SELECT stock_no, CAST(sum(own) AS BIGINT) AS own_mentions, CAST(sum(inherited) AS BIGINT) AS inherited_mentions, count(*) AS n, sum(sent_c) AS s FROM mention GROUP BY 1),
about AS (SELECT k AS stock_no, count(*) AS article_mentions FROM (SELECT unnest(map_keys(paragraph_stock_targets)) AS k FROM art) GROUP BY 1)
SELECT coalesce(per.stock_no, about.stock_no) AS stock_no, coalesce(article_mentions, 0) AS article_mentions, coalesce(own_mentions, 0) AS own_mentions,
  coalesce(inherited_mentions, 0) AS inherited_mentions, round(CAST(s AS DOUBLE) / n / 100, 6) AS mean_sentiment
FROM per FULL JOIN about ON per.stock_no = about.stock_no"""
)
def stock_period_summary(spark: SparkSession, folder: str) -> DataFrame:
    return mentions.period_summary(_analysed(spark, folder), table(spark, folder, "targets"))


@query(_MENTIONS + "SELECT stock_no, CAST(date_trunc('day', t) AS TIMESTAMP) AS day, count(*) AS mentions, round(CAST(sum(sent_c) AS DOUBLE) / count(*) / 100, 6) AS mean_sentiment FROM mention GROUP BY ALL")
def daily_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return mentions.daily_sentiment(_analysed(spark, folder), table(spark, folder, "targets"))


_MOOD = "SELECT stock_no, count(*) AS mentions, round(CAST(sum(sent_c) AS DOUBLE) / count(*) / 100, 6) AS mean_sentiment FROM mention GROUP BY 1 HAVING count(*) >= 3 ORDER BY mean_sentiment {}, mentions DESC, stock_no LIMIT 10"


@query(_MENTIONS + _MOOD.format("DESC"))
def bullish_top10(spark: SparkSession, folder: str) -> DataFrame:
    return mentions.mood_ranking(_analysed(spark, folder), table(spark, folder, "targets"), bullish=True)


@query(_MENTIONS + _MOOD.format("ASC"))
def bearish_top10(spark: SparkSession, folder: str) -> DataFrame:
    return mentions.mood_ranking(_analysed(spark, folder), table(spark, folder, "targets"), bullish=False)


@query(
    _MENTIONS
    + ", best AS (" + _MOOD.format("DESC") + """),
ranked AS (SELECT mention.stock_no, id, pos, sent_c, row_number() OVER (PARTITION BY mention.stock_no ORDER BY abs(sent_c) DESC, id, pos) AS rank FROM mention JOIN best USING (stock_no))
SELECT stock_no, CAST(rank AS INTEGER) AS rank, ranked.id AS id, ranked.pos AS pos, u.comment AS comment, sent_c FROM ranked JOIN c ON ranked.id = c.id AND ranked.pos = c.u.pos WHERE rank <= 3"""
)
def bullish_comments(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest comments behind the bullish ranking."""
    articles, targets = _analysed(spark, folder), table(spark, folder, "targets")
    return mentions.supporting_comments(articles, targets, mentions.mood_ranking(articles, targets, bullish=True))


@query("SELECT id, paragraph_title, coalesce(len(list_filter(comments, lambda c: c.comment_score > 0)), 0) AS pushes FROM articles ORDER BY pushes DESC, id LIMIT 10")
def article_push_top10(spark: SparkSession, folder: str) -> DataFrame:
    return mentions.most_pushed(table(spark, folder, "articles", "id", "paragraph_title", "comments"))


@query(
    """SELECT commenter, count(*) AS comments, CAST(count(stock_sentiment) AS BIGINT) AS scored,
round(CAST(sum(CAST(round(coalesce(stock_sentiment, 0) * 100) AS BIGINT)) AS DOUBLE) / nullif(count(stock_sentiment), 0) / 100, 6) AS mean_sentiment
FROM comments WHERE commenter IS NOT NULL GROUP BY 1 ORDER BY scored DESC, commenter LIMIT 10"""
)
def commenter_stats(spark: SparkSession, folder: str) -> DataFrame:
    return mentions.commenter_stats(table(spark, folder, "comments", "commenter", "stock_sentiment"))


@query(
    """SELECT days, count(*) AS articles, CAST(sum(coalesce(len(comments), 0)) AS BIGINT) AS comments
FROM articles, (SELECT unnest([1, 15, 30]) AS days), (SELECT max(paragraph_published_time) AS newest FROM articles)
WHERE paragraph_published_time > newest - to_days(CAST(days AS INTEGER)) GROUP BY days"""
)
def rolling_windows(spark: SparkSession, folder: str) -> DataFrame:
    return mentions.rolling_windows(table(spark, folder, "articles", "paragraph_published_time", "comments"))


_SCAN = "SELECT id, paragraph_link, paragraph_title, paragraph_published_time, status, done_analyze FROM articles WHERE "
_SCANNED = ("id", "paragraph_link", "paragraph_title", "paragraph_published_time", "status", "done_analyze")


@query(_SCAN + _FILTER + " AND done_analyze")
def scan_analysed(spark: SparkSession, folder: str) -> DataFrame:
    return _analysed(spark, folder).select(*_SCANNED)


@query(_SCAN + _FILTER + " AND NOT done_analyze AND id NOT IN (57, 153570)")
def scan_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Articles still to be scored, without known bad rows; the order is by time and id, which a set comparison ignores."""
    found = predicates.article_filter(table(spark, folder, "articles"), **PERIOD, tags_not=TAGS_NOT, title_not=TITLE_NOT, content_not=CONTENT_NOT, done=False, ids_not=(57, 153570))
    return found.orderBy(F.desc("paragraph_published_time"), "id").select(*_SCANNED)


@query(_SCAN + "id IN (3, 14, 15, 92, 65, 35, 89)")
def id_in_list(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles", *_SCANNED).where(F.col("id").isin(3, 14, 15, 92, 65, 35, 89))


@query(_SCAN + "paragraph_published_time > TIMESTAMP '2024-08-01 00:00:00' AND paragraph_published_time < TIMESTAMP '2024-08-07 00:00:00'")
def open_range(spark: SparkSession, folder: str) -> DataFrame:
    return predicates.strictly_between(table(spark, folder, "articles", *_SCANNED), "paragraph_published_time", "2024-08-01", "2024-08-07")


@query(_SCAN + "paragraph_published_time BETWEEN TIMESTAMP '2024-08-01 00:00:00' AND TIMESTAMP '2024-08-07 00:00:00'")
def closed_range_by_date(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds given as dates are inclusive: of the last day only midnight is in."""
    return predicates.article_filter(table(spark, folder, "articles", *_SCANNED), "2024-08-01", "2024-08-07")


@query("SELECT id, paragraph_link, paragraph_title, paragraph_published_time, status, done_analyze FROM articles ORDER BY id LIMIT 10 OFFSET 20")
def page_of_ten(spark: SparkSession, folder: str) -> DataFrame:
    return rest.listed(table(spark, folder, "articles", *_SCANNED), number=3)


@query("SELECT id, CASE WHEN id = 7 THEN 'changed' ELSE paragraph_title END AS paragraph_title, CASE WHEN id = 7 THEN true ELSE done_analyze END AS done_analyze FROM articles WHERE id <> 9")
def update_and_delete(spark: SparkSession, folder: str) -> DataFrame:
    """A partial update of one row and the deletion of another."""
    changed = rest.updated(table(spark, folder, "articles", "id", "paragraph_title", "done_analyze"), 7, {"paragraph_title": "changed", "done_analyze": True})
    return rest.deleted(changed, 9)


@query("SELECT stock_no, stock_name FROM targets WHERE NOT starts_with(stock_no, '0')")
def prefix_exclude(spark: SparkSession, folder: str) -> DataFrame:
    return predicates.without_prefix(table(spark, folder, "targets"), "stock_no", "0")


@query("SELECT id FROM articles WHERE list_count(list_filter(comments, lambda c: NOT coalesce(c.analyzed, false))) = 0")
def all_analysed(spark: SparkSession, folder: str) -> DataFrame:
    """Articles all of whose comments are analysed; an empty list counts, a missing one doesn't."""
    return table(spark, folder, "articles", "id", "comments").where(predicates.all_analysed(F.col("comments"))).select("id")


@query(
    """SELECT t.stock_no, t.stock_name, i.business_scope, i.competitor, n.stock_nickname, n.nickname_explain
FROM targets t LEFT JOIN infos i ON t.stock_no = i.stock_no LEFT JOIN nicknames n ON t.stock_no = n.stock_no"""
)
def dataset_merge(spark: SparkSession, folder: str) -> DataFrame:
    return dictionary.merged_dataset(*[table(spark, folder, n) for n in ("targets", "infos", "nicknames")])


@query("SELECT stock_no, stock_name FROM targets WHERE stock_no NOT IN (SELECT stock_no FROM infos WHERE stock_no IS NOT NULL)")
def missing_targets(spark: SparkSession, folder: str) -> DataFrame:
    return dictionary.missing(table(spark, folder, "targets"), table(spark, folder, "infos"))


@query(
    """SELECT stock_no, stock_name FROM infos UNION ALL
SELECT stock_no, stock_name FROM targets WHERE stock_no NOT IN (SELECT stock_no FROM infos WHERE stock_no IS NOT NULL)"""
)
def insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    """Targets inserted into the companies known already; existing rows stay."""
    return dictionary.insert_or_ignore(table(spark, folder, "infos", "stock_no", "stock_name"), table(spark, folder, "targets", "stock_no", "stock_name"), "stock_no")


@query("SELECT stock_name AS token, max(stock_no) AS stock_no FROM targets WHERE stock_name <> '' GROUP BY 1")
def dup_name_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return dictionary.name_lookup(table(spark, folder, "targets"))


_COMMENT_TYPED = f"""WITH e AS (SELECT comment_id, unnest(items) AS j, generate_subscripts(items, 1) - 1 AS target_pos
  FROM (SELECT comment_id, {_ITEMS} AS items FROM comments WHERE stock_targets IS NOT NULL)),
typed AS (SELECT comment_id, target_pos, {_TOKEN} AS token, {_OTHER} AS other FROM e
  WHERE json_type(j) <> 'NULL' AND NOT (json_type(j) = 'OBJECT' AND len(json_keys(j)) = 0) AND NOT (json_type(j) = 'VARCHAR' AND (j ->> '$') = ''))"""


@query(_COMMENT_TYPED + " SELECT comment_id, CAST(target_pos AS INTEGER) AS target_pos, token, other FROM typed")
def hetero_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Targets typed as strings, numbers or objects, bare or in lists, as one flat table."""
    return mentions.typed_targets(table(spark, folder, "comments", "comment_id", "stock_targets"), "comment_id")


@query(
    _COMMENT_TYPED
    + f""", {_LOOKUP} SELECT comment_id, CAST(target_pos AS INTEGER) AS target_pos, coalesce(a.stock_no, b.stock_no) AS stock_no,
  nullif(CASE WHEN a.stock_no IS NOT NULL THEN a.stock_name ELSE b.stock_name END, '') AS stock_name
FROM typed LEFT JOIN lookup a ON typed.token = a.token LEFT JOIN lookup b ON typed.other = b.token WHERE coalesce(a.stock_no, b.stock_no) IS NOT NULL"""
)
def name_then_code_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return mentions.resolved_targets(table(spark, folder, "comments", "comment_id", "stock_targets"), table(spark, folder, "targets"), "comment_id")


@query("SELECT a.id AS id, t.token AS token FROM articles a JOIN (SELECT stock_no AS token FROM targets UNION SELECT stock_name FROM targets WHERE stock_name <> '') t ON contains(a.paragraph_title, t.token)")
def title_contains_names(spark: SparkSession, folder: str) -> DataFrame:
    """Codes and names that stand anywhere in a title, overlapping ones too."""
    known = table(spark, folder, "targets")
    names = known.select(F.col("stock_no").alias("token")).unionByName(known.select(F.col("stock_name").alias("token")))
    return entities.contained(table(spark, folder, "articles", "id", "paragraph_title"), "id", "paragraph_title", names)


@query(
    r"""SELECT DISTINCT id, token FROM (SELECT id, unnest(string_split_regex(coalesce(paragraph_content, ''), '[^\p{L}\p{N}]+')) AS token FROM articles)
WHERE token IN (SELECT stock_no FROM targets UNION ALL SELECT stock_name FROM targets WHERE stock_name IS NOT NULL)"""
)
def content_token_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of the content that are codes or names, whole."""
    known = table(spark, folder, "targets")
    names = known.select(F.col("stock_no").alias("token")).unionByName(known.select(F.col("stock_name").alias("token")))
    return entities.exact_tokens(table(spark, folder, "articles", "id", "paragraph_content"), "id", "paragraph_content", names)


THRESHOLDS = {"nickname": 0.65, "name": 0.65, "code": 0.9}


def _fuzzy(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    comments = table(spark, folder, "comments", "comment_id", "comment", "stock_targets")
    typed = mentions.typed_targets(comments.select("comment_id", "stock_targets"), "comment_id").select("comment_id", "token")
    typed = typed.unionByName(comments.select("comment_id", F.explode(T.plain_tokens(F.col("comment"))).alias("token")))
    known, nicks = table(spark, folder, "targets"), table(spark, folder, "nicknames")
    entries = known.select("stock_no", F.lit("code").alias("kind"), F.col("stock_no").alias("entry"))
    entries = entries.unionByName(known.select("stock_no", F.lit("name").alias("kind"), F.col("stock_name").alias("entry")))
    entries = entries.unionByName(nicks.select("stock_no", F.lit("nickname").alias("kind"), F.col("stock_nickname").alias("entry")))
    return typed, entities.best_matches(entities.fuzzy_pairs(typed, entries, THRESHOLDS))


@query()
def fuzzy_best_match(spark: SparkSession, folder: str) -> DataFrame:
    """The most similar entry of each token of the comments and their typed targets, by restricted edit distance. DuckDB
    has no such distance on characters, so tests compare with brute force."""
    return _fuzzy(spark, folder)[1]


@query()
def fuzzy_context(spark: SparkSession, folder: str) -> DataFrame:
    """The lines a scorer gets with a comment: what its tokens resemble, and what those companies do."""
    typed, best = _fuzzy(spark, folder)
    dataset = table(spark, folder, "infos", "stock_no", "stock_name", "business_scope", "competitor")
    matches = typed.select(F.col("comment_id").alias("key"), "token").distinct().join(best, "token")
    keys = table(spark, folder, "comments", F.col("comment_id").alias("key"))
    return entities.context_lines(matches, dataset, table(spark, folder, "nicknames"), keys)


@query("SELECT id, CASE WHEN regexp_extract(coalesce(paragraph_title, ''), '\\[([^\\]]+)\\]', 1) = '' THEN 'Unknown' ELSE regexp_extract(paragraph_title, '\\[([^\\]]+)\\]', 1) END AS tag FROM articles")
def tag_extract(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles", "id", "paragraph_title").select("id", T.title_tag(F.col("paragraph_title")).alias("tag"))


@query(
    """SELECT doc_id, CASE WHEN len(h) = 0 THEN 'Unknown' ELSE h[-1] END AS ip FROM (SELECT doc_id,
regexp_extract_all(concat('來自: 10.0.0.', doc_id % 250, ' (A)' , chr(10), coalesce(source, ''), chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('來自: 172.16.0.', doc_id % 199) ELSE '' END), '來自:\\s*(\\d{1,3}(?:\\.\\d{1,3}){3})', 1) AS h FROM documents)"""
)
def last_ip(spark: SparkSession, folder: str) -> DataFrame:
    """The last sender line of a footer decides. The tables hold no footers, so one is made for every document."""
    footer = F.concat(
        F.lit("來自: 10.0.0."), (F.col("doc_id") % 250).cast("string"), F.lit(" (A)\n"), F.coalesce("source", F.lit("")), F.lit("\n"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("來自: 172.16.0."), (F.col("doc_id") % 199).cast("string"))).otherwise(""),
    )
    return table(spark, folder, "documents", "doc_id", "source").select("doc_id", T.last_sender_ip(footer).alias("ip"))


@query("SELECT id, array_to_string(array_pop_back(string_split(x, '；')), '；') AS head FROM (SELECT id, replace(paragraph_content, '。', '；') AS x FROM articles) WHERE contains(x, '；') UNION ALL SELECT id, replace(paragraph_content, '。', '；') FROM articles WHERE NOT contains(replace(paragraph_content, '。', '；'), '；')")
def last_marker_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Text before the last marker; here sentence ends serve as marker, as contents come without footer."""
    text = F.replace("paragraph_content", F.lit("。"), F.lit("；"))
    rows = table(spark, folder, "articles", "id", "paragraph_content").where(F.col("paragraph_content").isNotNull())
    return rows.select("id", T.cut_at_last(text, "；").alias("head"))


@query("SELECT comment_id, length(regexp_replace(comment, '^[\\s\\x{3000}\\x{00a0}\\x{202f}\\x{2000}-\\x{200a}\\x{0085}]+|[\\s\\x{3000}\\x{00a0}\\x{202f}\\x{2000}-\\x{200a}\\x{0085}]+$', '', 'g')) AS n FROM comments")
def strip_unicode(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "comments", "comment_id", "comment").select("comment_id", F.length(T.strip(F.col("comment"))).cast("bigint").alias("n"))


@query("SELECT article_id, CAST(sum(CASE WHEN comment_score > 0 THEN 1 WHEN comment_score < 0 THEN -1 ELSE 0 END) AS BIGINT) AS balance FROM comments GROUP BY 1")
def push_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Pushes less boos per article, marks mapped to scores."""
    mark = F.when(F.col("comment_score") > 0, T.PUSH).when(F.col("comment_score") < 0, T.BOO).otherwise("→")
    return table(spark, folder, "comments", "article_id", "comment_score").groupBy("article_id").agg(F.sum(T.push_score(mark)).alias("balance"))


@query("SELECT stock_no, CASE WHEN length(stock_name) > 3 THEN concat(substring(stock_name, 1, 4), chr(10), substring(stock_name, 5)) ELSE stock_name END AS label, concat('https://forum.example', '/stock/', stock_no) AS url FROM targets")
def labels_and_urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "targets").select("stock_no", T.wrapped_label(F.col("stock_name")).alias("label"), T.absolute_url("https://forum.example", F.concat(F.lit("/stock/"), "stock_no")).alias("url"))


@query(
    """SELECT comment_id, coalesce(try_strptime(comment_time, '%Y-%m-%d %H:%M'),
  CASE WHEN regexp_matches(comment_time, '^\\d{2}/\\d{2} \\d{2}:\\d{2}$') THEN try_strptime(concat(year(fetched_at), '-', comment_time), '%Y-%m/%d %H:%M') END) AS at FROM comments"""
)
def comment_time_graft(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "comments", "comment_id", "comment_time", "fetched_at").select("comment_id", times.comment_time(F.col("comment_time"), F.col("fetched_at")).alias("at"))


@query("SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS at FROM events")
def parse_forum_time(spark: SparkSession, folder: str) -> DataFrame:
    """Times written as a forum page shows them (with a misspelt weekday) and read back."""
    shown = F.concat(F.lit("Tus "), F.date_format("ts", "MMM d HH:mm:ss yyyy"))
    return table(spark, folder, "events", "event_id", "ts").select("event_id", times.forum_time(shown).alias("at"))


@query("SELECT id, coalesce(CASE WHEN status = '200' THEN paragraph_published_time END, TIMESTAMP '2007-01-01 00:00:00') AS at FROM articles")
def default_time(spark: SparkSession, folder: str) -> DataFrame:
    known = F.when(F.col("status") == "200", F.col("paragraph_published_time"))
    return table(spark, folder, "articles", "id", "status", "paragraph_published_time").select("id", times.or_default(known).alias("at"))


@query(
    """SELECT id, last_value(CASE WHEN year(paragraph_published_time) > 2007 THEN paragraph_published_time END IGNORE NULLS)
OVER (PARTITION BY page_url ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at FROM articles"""
)
def carry_forward_time(spark: SparkSession, folder: str) -> DataFrame:
    """An unknown time takes the last known one of its listing page."""
    known = F.when(F.year("paragraph_published_time") > 2007, F.col("paragraph_published_time"))
    return table(spark, folder, "articles", "id", "page_url", "paragraph_published_time").select("id", times.carried_forward(known, "page_url", "id").alias("at"))


@query(
    """SELECT id, CAST(b AS INTEGER) AS batch, CAST(least(45, len(comments) - 45 * b) AS INTEGER) AS n FROM articles, range(0, 40) r(b) WHERE 45 * b < len(comments)"""
)
def batch45(spark: SparkSession, folder: str) -> DataFrame:
    """Comments of each article in batches of 45."""
    return enrich.batched(table(spark, folder, "articles", "id", "comments")).select("id", "batch", F.size("texts").alias("n"))


@query(
    """SELECT doc_id, CAST((rn - 1) // size AS BIGINT) AS piece FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, (SELECT count(*) // 60 FROM documents) AS size FROM documents)
WHERE size > 0 AND (rn - 1) // size < 60"""
)
def chunk_drop_remainder(spark: SparkSession, folder: str) -> DataFrame:
    """Sixty pieces of equal size; the remainder is dropped."""
    return enrich.chunks_without_remainder(table(spark, folder, "documents", "doc_id"), "doc_id", 60).select("doc_id", F.col("piece").cast("bigint").alias("piece"))


@query("SELECT id, list_transform(comments, lambda c: c.comment) AS texts FROM articles WHERE len(comments) > 0")
def regroup_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Batching and regrouping by position gives the comments back in order."""
    rows = enrich.batched(table(spark, folder, "articles", "id", "comments")).select("id", F.explode(F.arrays_zip("positions", "texts")).alias("z"))
    per = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("z.positions").alias("p"), F.col("z.texts").alias("t")))).alias("l"))
    return per.select("id", F.transform("l", lambda x: x["t"]).alias("texts"))


@query(
    """SELECT DISTINCT id, CAST((p - 1) // 7 AS INTEGER) AS batch FROM (SELECT id, unnest(comments) AS u, generate_subscripts(comments, 1) AS p FROM articles) WHERE NOT coalesce(u.analyzed, false)"""
)
def pending_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of seven that still hold a comment without analysis."""
    return enrich.pending(table(spark, folder, "articles", "id", "comments"), 7).select("id", "batch")


@query("SELECT id, coalesce(len(comments), 0) AS comments, coalesce(len(list_filter(comments, lambda c: c.analyzed)), 0) AS analysed FROM articles")
def analysed_counts(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.analysed_counts(table(spark, folder, "articles", "id", "comments"))


@query("SELECT stock_no, count(*) AS n FROM targets JOIN nicknames USING (stock_no) GROUP BY stock_no HAVING count(*) > 2")
def plain_sql(spark: SparkSession, folder: str) -> DataFrame:
    """A statement handed through as it is."""
    return run_sql(spark, folder, "SELECT stock_no, count(*) AS n FROM targets JOIN nicknames USING (stock_no) GROUP BY stock_no HAVING count(*) > 2", "targets", "nicknames")


def _lexicon_sql(text: str) -> str:
    hits = " + ".join(f"contains({text}, '{w}')::INT" for w in enrich.BULLISH) + " - " + " - ".join(f"contains({text}, '{w}')::INT" for w in enrich.BEARISH)
    return f"greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({hits}) / 4.0::DOUBLE))"


@query(f"SELECT comment_id, {_lexicon_sql("coalesce(comment, '')")} AS sentiment FROM comments")
def lexicon_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "comments", "comment_id", "comment").select("comment_id", enrich.lexicon_sentiment(F.col("comment")).alias("sentiment"))


@query(f"SELECT id, u.pos AS pos, {_lexicon_sql("coalesce(u.comment, '')")} AS stock_sentiment FROM (SELECT id, unnest(comments) AS u FROM articles)")
def scored_comments(spark: SparkSession, folder: str) -> DataFrame:
    """All comments through the scorer interface in batches of 45, results checked for number."""
    return enrich.scored(enrich.batched(table(spark, folder, "articles", "id", "comments"))).select("id", "pos", "stock_sentiment")


@query(f"SELECT id, len(comments) AS n, coalesce(len(comments) = 0, done_analyze) OR (comments IS NOT NULL) AS done, list_transform(comments, lambda c: {_lexicon_sql("coalesce(c.comment, '')")}) AS sentiments, list_transform(comments, lambda c: '[]') AS targets, list_transform(comments, lambda c: c.commenter) AS commenters FROM articles")
def rewritten_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Scores put back into the articles, which are done once all comments are analysed."""
    articles = table(spark, folder, "articles", "id", "comments", "done_analyze")
    done = enrich.rewritten(enrich.rewritten(articles, enrich.scored(enrich.batched(articles))), enrich.scored(enrich.batched(articles)))
    return done.select("id", F.when(F.col("comments").isNotNull(), F.size("comments").cast("bigint")).alias("n"), F.col("done_analyze").alias("done"), F.col("comments.stock_sentiment").alias("sentiments"), F.col("comments.stock_targets").alias("targets"), F.col("comments.commenter").alias("commenters"))


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All articles as stored, and all again as a later crawl finds them: those with comments have changed since, and one
    mirror gives its own links."""
    columns = ("id", "paragraph_link", "paragraph_title", "status", "md5_hash", "done_analyze")
    articles = table(spark, folder, "articles", *columns, "source", "comments_token_count")
    link = F.when(F.col("source") == "mirror_west", F.concat("paragraph_link", F.lit("#m"))).otherwise(F.col("paragraph_link"))
    hashed = F.when(F.col("comments_token_count") > 0, F.concat("md5_hash", F.lit("x"))).otherwise(F.col("md5_hash"))
    batch = articles.withColumns({"seq": F.col("id"), "paragraph_link": link, "md5_hash": hashed})
    return articles.select(*columns), batch.select("paragraph_link", "paragraph_title", "status", "md5_hash", "seq")


_UPSERT = """WITH stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paragraph_link ORDER BY id) AS rn FROM articles WHERE paragraph_link IS NOT NULL) WHERE rn = 1),
batch AS (SELECT * FROM (SELECT id, link AS paragraph_link, paragraph_title, status, CASE WHEN comments_token_count > 0 THEN md5_hash || 'x' ELSE md5_hash END AS md5_hash,
  row_number() OVER (PARTITION BY link ORDER BY CASE WHEN status = '200' THEN 0 ELSE 1 END, id DESC) AS rn
  FROM (SELECT *, CASE WHEN source = 'mirror_west' THEN paragraph_link || '#m' ELSE paragraph_link END AS link FROM articles) WHERE link IS NOT NULL) WHERE rn = 1),
decided AS (SELECT b.paragraph_link, b.paragraph_title, b.status, b.md5_hash, s.id AS stored_id, CASE WHEN coalesce(s.done_analyze, false) THEN 'skip_analysed' WHEN s.id IS NULL AND b.status <> '200' THEN 'skip_failed'
  WHEN s.id IS NULL THEN 'insert' WHEN s.md5_hash IS NOT DISTINCT FROM b.md5_hash THEN 'skip_same' WHEN b.status <> '200' THEN 'skip_failed' ELSE 'update' END AS action
  FROM batch b LEFT JOIN stored s ON b.paragraph_link = s.paragraph_link)"""


@query(_UPSERT + " SELECT paragraph_link, action, stored_id FROM decided")
def upsert_classify(spark: SparkSession, folder: str) -> DataFrame:
    return upsert.classified(*_versions(spark, folder))


@query(
    _UPSERT
    + """ SELECT a.id, a.paragraph_link, coalesce(d.paragraph_title, a.paragraph_title) AS paragraph_title, coalesce(d.status, a.status) AS status, coalesce(d.md5_hash, a.md5_hash) AS md5_hash, a.done_analyze
FROM articles a LEFT JOIN (SELECT * FROM decided WHERE action = 'update') d ON a.id = d.stored_id
UNION ALL SELECT (SELECT max(id) FROM articles) + row_number() OVER (ORDER BY paragraph_link), paragraph_link, paragraph_title, status, md5_hash, false FROM decided WHERE action = 'insert'"""
)
def upsert_apply(spark: SparkSession, folder: str) -> DataFrame:
    return upsert.applied(*_versions(spark, folder))


@query("SELECT id, md5(concat_ws(chr(31), coalesce('=' || paragraph_link, '~'), coalesce('=' || paragraph_title, '~'), coalesce('=' || status, '~'))) AS fingerprint FROM articles")
def change_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles", "id", "paragraph_link", "paragraph_title", "status").select("id", upsert.article_hash("paragraph_link", "paragraph_title", "status").alias("fingerprint"))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT query_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_cosine_similarity(q.v, i.v) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, i.v) DESC, i.vec_id) AS rank FROM (SELECT * FROM e WHERE vec_id % 20 = 0) q, e i) WHERE rank <= 5"""
)
def vector_top5(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every twentieth one, among all, exactly."""
    items = table(spark, folder, "embeddings", "vec_id", "embedding")
    return vectors.nearest(items.where("vec_id % 20 = 0"), items).withColumn("score", F.round("score", 6))


@query("SELECT 'code' AS type, 'test' AS model, stock_no AS no, stock_name AS name, stock_no AS text FROM targets UNION ALL SELECT 'name', 'test', stock_no, stock_name, stock_name FROM targets WHERE stock_name IS NOT NULL")
def two_projection_collection(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "targets")
    return vectors.collection(known, known, "test")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}]|[^\P{L}\x{4e00}-\x{9fff}]+|\p{N}+|[^\s\p{L}\p{N}]')) AS INTEGER) AS tokens FROM documents")
def token_count(spark: SparkSession, folder: str) -> DataFrame:
    """The default, pluggable count of tokens."""
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query(
    r"""SELECT id, CAST(coalesce(list_sum(list_transform(comments, lambda c: len(regexp_extract_all(coalesce(c.comment, ''), '[\x{4e00}-\x{9fff}]|[^\P{L}\x{4e00}-\x{9fff}]+|\p{N}+|[^\s\p{L}\p{N}]')))), 0) AS BIGINT) AS tokens FROM articles"""
)
def comments_token_count(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of all comments of an article, 0 for none, without exploding them."""
    total = F.aggregate("comments.comment", F.lit(0).cast("bigint"), lambda acc, c: acc + T.token_count(c))
    return table(spark, folder, "articles", "id", "comments").select("id", F.coalesce(total, F.lit(0)).alias("tokens"))


@query("SELECT DISTINCT article_id, comment, commenter FROM comments")
def distinct_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Comments without those fetched again."""
    return table(spark, folder, "comments", "article_id", "comment", "commenter").distinct()


@query("SELECT stock_no, count(*) AS n, string_agg(stock_nickname, '、' ORDER BY stock_nickname) AS nicknames FROM nicknames GROUP BY 1")
def nickname_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Nicknames of each code in one ordered line."""
    return table(spark, folder, "nicknames").groupBy("stock_no").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("stock_nickname")), "、").alias("nicknames"))


@query("SELECT stock_no, k AS competitor_no, competitor ->> ('$.\"' || k || '\"') AS competitor_name FROM (SELECT stock_no, competitor, unnest(json_keys(competitor)) AS k FROM infos WHERE competitor IS NOT NULL)")
def competitors(spark: SparkSession, folder: str) -> DataFrame:
    """Competitor maps as rows."""
    rows = table(spark, folder, "infos", "stock_no", "competitor").where(F.col("competitor").isNotNull())
    return rows.select("stock_no", F.explode(F.from_json("competitor", "map<string,string>")).alias("competitor_no", "competitor_name"))


@query(
    """SELECT id, coalesce(nullif(paragraph_tag, ''), 'Unknown') AS tag, count(*) OVER (PARTITION BY paragraph_author) AS by_author FROM articles"""
)
def articles_per_author(spark: SparkSession, folder: str) -> DataFrame:
    """Each article with the number of its author's; counted first and joined, so no author's rows gather in one window."""
    rows = table(spark, folder, "articles", "id", "paragraph_tag", "paragraph_author").withColumn("a", F.coalesce("paragraph_author", F.lit("\0")))
    per = rows.groupBy("a").agg(F.count("*").alias("by_author"))
    return rows.join(per, "a").select("id", F.coalesce(F.when(F.col("paragraph_tag") == "", None).otherwise(F.col("paragraph_tag")), F.lit("Unknown")).alias("tag"), "by_author")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, folder: str) -> DataFrame:
    """A number read from JSON text."""
    return table(spark, folder, "events", "event_id", "props").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    _MENTIONS
    + ", best AS (" + _MOOD.format("ASC") + """),
ranked AS (SELECT mention.stock_no, id, pos, sent_c, row_number() OVER (PARTITION BY mention.stock_no ORDER BY abs(sent_c) DESC, id, pos) AS rank FROM mention JOIN best USING (stock_no))
SELECT stock_no, CAST(rank AS INTEGER) AS rank, ranked.id AS id, ranked.pos AS pos, u.comment AS comment, sent_c FROM ranked JOIN c ON ranked.id = c.id AND ranked.pos = c.u.pos WHERE rank <= 3"""
)
def bearish_comments(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest comments behind the bearish ranking."""
    articles, targets = _analysed(spark, folder), table(spark, folder, "targets")
    return mentions.supporting_comments(articles, targets, mentions.mood_ranking(articles, targets, bullish=False))


_STRIPPED = "regexp_replace(comment, '^[\\s\\x{3000}\\x{00a0}\\x{202f}\\x{2000}-\\x{200a}\\x{0085}]+|[\\s\\x{3000}\\x{00a0}\\x{202f}\\x{2000}-\\x{200a}\\x{0085}]+$', '', 'g')"


@query(f"SELECT comment_id, substr({_STRIPPED}, 2) AS rest FROM comments")
def drop_first(spark: SparkSession, folder: str) -> DataFrame:
    """Comments without their first character."""
    return table(spark, folder, "comments", "comment_id", "comment").select("comment_id", T.drop_first(F.col("comment")).alias("rest"))


@query("SELECT doc_id, CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END AS text FROM documents")
def without_last_newline(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", T.without_last_newline(F.col("text")).alias("text"))


@query("SELECT comment_id, replace(stock_targets, chr(34), chr(39)) AS text FROM comments")
def single_quoted(spark: SparkSession, folder: str) -> DataFrame:
    """Targets as a model writes them inside JSON, with escaped quotes, read with single ones."""
    escaped = F.replace("stock_targets", F.lit('"'), F.lit('\\"'))
    return table(spark, folder, "comments", "comment_id", "stock_targets").select("comment_id", T.single_quoted(escaped).alias("text"))


@query("SELECT comment_id, printf('%.3f', CAST(comment_score AS DOUBLE)) AS score FROM comments WHERE comment_score IS NOT NULL")
def fixed_decimals(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "comments", "comment_id", "comment_score").where(F.col("comment_score").isNotNull())
    return rows.select("comment_id", T.rounded(F.col("comment_score").cast("double")).alias("score"))


@query("SELECT comment_id, stock_sentiment AS first, CAST(NULL AS DOUBLE) AS second FROM comments")
def model_output(spark: SparkSession, folder: str) -> DataFrame:
    """Sentiments written as a model answers, keyed by index and out of order, and read back in order."""
    one = lambda s: F.concat(F.lit('{"stock_sentiment": '), F.coalesce(s.cast("string"), F.lit("null")), F.lit(', "stock_targets": []}'))
    text = F.concat(F.lit('{"1": '), one(F.lit(None)), F.lit(', "0": '), one(F.col("stock_sentiment")), F.lit("}"))
    read = table(spark, folder, "comments", "comment_id", "stock_sentiment").select("comment_id", enrich.parsed_results(text).alias("r"))
    return read.select("comment_id", F.col("r")[0]["stock_sentiment"].alias("first"), F.col("r")[1]["stock_sentiment"].alias("second"))


@query("SELECT stock_no, stock_name AS name, 1 AS size FROM targets WHERE stock_name IS NOT NULL")
def alternating_map(spark: SparkSession, folder: str) -> DataFrame:
    """[name, code, a leftover] as {code: name}."""
    rows = table(spark, folder, "targets").where("stock_name is not null")
    made = C.alternating_map(F.array("stock_name", "stock_no", F.lit("left")))
    return rows.select("stock_no", F.try_element_at(made, F.col("stock_no")).alias("name"), F.size(made).alias("size"))


@query("SELECT stock_no, stock_no AS first, stock_name AS second, 2 AS size FROM targets")
def index_map(spark: SparkSession, folder: str) -> DataFrame:
    """{'0': code, '1': name}."""
    made = C.index_map(F.array("stock_no", "stock_name"))
    return table(spark, folder, "targets").select("stock_no", made["0"].alias("first"), made["1"].alias("second"), F.size(made).alias("size"))


@query("SELECT comment_id, list_filter(string_split(comment, '，'), lambda x: x <> '') AS parts FROM comments WHERE comment IS NOT NULL")
def without_empty(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses of comments without empty ones."""
    rows = table(spark, folder, "comments", "comment_id", "comment").where("comment is not null")
    return rows.select("comment_id", C.without_empty(F.split("comment", "，")).alias("parts"))


@query(
    """SELECT id, CAST(coalesce(len(map_keys(paragraph_stock_targets)), 0) + CASE WHEN coalesce(list_contains(map_keys(paragraph_stock_targets), '1181'), false) THEN 0 ELSE 1 END AS INTEGER) AS size,
'right' AS name FROM articles"""
)
def merged_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of articles united with another map, which wins."""
    made = C.merged(F.col("paragraph_stock_targets"), F.create_map(F.lit("1181"), F.lit("right")))
    return table(spark, folder, "articles", "id", "paragraph_stock_targets").select("id", F.size(made).alias("size"), F.try_element_at(made, F.lit("1181")).alias("name"))


@query("SELECT stock_no, stock_name || '？' || business_scope AS scope, stock_name || '{\"' || stock_no || '\":\"' || stock_name || '\"}' AS named FROM infos")
def scraped_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Headings put before what stands under them, and a map after its text."""
    pairs = F.when(F.col("stock_name").isNotNull(), F.create_map("stock_no", "stock_name"))
    return table(spark, folder, "infos", "stock_no", "stock_name", "business_scope").select(
        "stock_no", T.titled(F.col("stock_name"), F.col("business_scope")).alias("scope"), T.with_map(F.col("stock_name"), pairs).alias("named")
    )


@query("SELECT article_id, max(comment_time) AS newest, max(pos) AS last_pos FROM comments GROUP BY 1")
def newest_comment(spark: SparkSession, folder: str) -> DataFrame:
    """Largest values per group, as charts need them for their axes."""
    return table(spark, folder, "comments", "article_id", "comment_time", "pos").groupBy("article_id").agg(F.max("comment_time").alias("newest"), F.max("pos").alias("last_pos"))


@query(
    """SELECT CAST(date_trunc('day', fetched_at) AS TIMESTAMP) AS window_start, source AS stock_no, count(*) AS mentions FROM comments WHERE fetched_at IS NOT NULL GROUP BY ALL"""
)
def windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming window aggregate on a static frame."""
    from tidemark.streaming.ingest import windowed_mentions

    return windowed_mentions(table(spark, folder, "comments", "fetched_at", F.col("source").alias("stock_no")).where(F.col("fetched_at").isNotNull()))


@query()
def article_bodies_json(spark: SparkSession, folder: str) -> DataFrame:
    """Articles as JSON rows, nulls kept; tests check the round trip."""
    return files.as_json(table(spark, folder, "articles"), "id")


@query("SELECT comment_id, list_transform(list_filter(range(0, len(t)), lambda i: i % 45 = 0), lambda i: t[i + 1:i + 45]) AS parts FROM (SELECT comment_id, string_split_regex(coalesce(comment, ''), '，') AS t FROM comments)")
def chunked_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays cut into arrays of 45."""
    return table(spark, folder, "comments", "comment_id", "comment").select("comment_id", C.chunk(F.split(F.coalesce("comment", F.lit("")), "，"), 45).alias("parts"))
