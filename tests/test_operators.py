import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.distance import restricted_distance
from tidemark.operators import dictionary, enrich, entities, mentions, predicates, upsert, vectors

COMMENT = "struct<comment_score:int,commenter:string,comment:string,comment_time:string,stock_sentiment:double,stock_targets:string,pos:int,analyzed:boolean>"
ARTICLE = f"id bigint, paragraph_published_time timestamp_ntz, comments array<{COMMENT}>, paragraph_stock_targets map<string,string>, done_analyze boolean"
TARGETS = [("1", "one"), ("2", "two"), ("3", "same"), ("4", "same"), ("0050", "fund"), ("5", None)]


def comment(pos, targets, sentiment=None, analyzed=True, text="c"):
    return (1, "u", text, None, sentiment, targets, pos, analyzed)


def frames(spark, rows):
    return spark.createDataFrame(rows, ARTICLE), spark.createDataFrame(TARGETS, "stock_no string, stock_name string")


def test_overview_rules(spark):
    t = datetime(2024, 8, 1)
    rows = [
        (1, t, [comment(0, '["one", "1", {"two": "1"}, {"nobody": "2"}, {"nobody": "nothing"}, {}, "", null, 2]', 0.5), comment(1, None, None), comment(2, "[]", 0.1)], {"1": "written", "77": "unlisted"}, True),
        (2, datetime(2024, 8, 2), [comment(0, '["same"]', -1.0), comment(1, '"0050"', 0.25)], None, True),
        (3, t, None, {"1": "x"}, True), (4, t, [], {"1": "x"}, True),
    ]
    articles, targets = frames(spark, rows)
    got = [tuple(r) for r in mentions.market_overview(articles, targets).collect()]
    assert got == [("1", "written", 3, 0.2), ("77", "unlisted", 3, 0.2), ("4", "same", 1, -1.0), ("0050", "fund", 1, 0.25), ("2", "two", 1, 0.5)]
    assert [r.stock_no for r in mentions.market_overview(articles, targets, ("1",), 2).collect()] == ["77", "4"]
    assert mentions.market_overview(articles.limit(0), targets).count() == 0
    assert "TakeOrderedAndProject" in mentions.market_overview(articles, targets)._jdf.queryExecution().executedPlan().toString()


def test_token_lookup_prefers_names_and_last_code(spark):
    got = {r.token: r.stock_no for r in dictionary.token_lookup(spark.createDataFrame(TARGETS + [("one", "2")], "stock_no string, stock_name string")).collect()}
    assert got["same"] == "4" and got["one"] == "1" and got["2"] == "one" and got["5"] == "5"


def test_filters_are_three_valued(spark):
    df = spark.createDataFrame([(1, "a", "t", "c"), (2, None, "t", "c"), (3, "a", None, "c"), (4, "b", "bad", "c")], "id bigint, paragraph_tag string, paragraph_title string, paragraph_content string")
    assert [r.id for r in predicates.article_filter(df, tags_not=["b"], title_not=["bad"], ids_not=[9]).collect()] == [1]
    assert [r.id for r in predicates.page(df, 2, 3).collect()] == [4] and predicates.page(df, 3, 3).count() == 0


def test_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", True, datetime(2024, 1, 1))], "id bigint, paragraph_tag string, done_analyze boolean, paragraph_published_time timestamp_ntz")
    df.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = predicates.article_filter(spark.read.parquet(str(tmp_path / "t")), "2024-01-01", "2024-02-01", ["b"], done=True)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(paragraph_published_time" in plan and "EqualTo(done_analyze,true)" in plan


def test_scans_read_only_the_comment_fields_they_need(spark, tmp_path):
    articles, targets = frames(spark, [(1, datetime(2024, 1, 1), [comment(0, '"one"', 0.5)], {"2": "two"}, True)])
    articles.write.parquet(str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a"))
    schema = lambda df: df._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].splitlines()[0]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    overview = schema(mentions.market_overview(stored, targets))
    assert "stock_targets" in overview and "comment:" not in overview and "commenter" not in overview
    assert "comment:" not in schema(mentions.rolling_windows(stored)) and "stock_targets" not in schema(enrich.batched(stored))
    plan = mentions.mentions(stored, targets)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan.split("Project")[0] and plan.count("FileScan") == 1


def test_insert_or_ignore(spark):
    stored = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string")
    batch = spark.createDataFrame([("2", "new", 1), ("3", "first", 1), ("3", "second", 2), (None, "x", 1)], "k string, v string, seq int")
    assert sorted(tuple(r) for r in dictionary.insert_or_ignore(stored, batch, "k", F.col("seq")).collect()) == [("1", "a"), ("2", "b"), ("3", "first")]
    assert dictionary.insert_or_ignore(stored.limit(0), batch.limit(0), "k").count() == 0


STORED = "id bigint, paragraph_link string, paragraph_title string, status string, md5_hash string, done_analyze boolean"
BATCH = "paragraph_link string, paragraph_title string, status string, md5_hash string, seq int"


def versions(spark):
    stored = spark.createDataFrame([(1, "done", "t", "200", "h", True), (2, "same", "t", "200", "h", False), (3, "failed", "t", "200", "h", False), (4, "changed", "t", "200", "h", False), (5, "changed", "dup", "200", "h", False), (6, None, "t", "200", "h", False)], STORED)
    batch = spark.createDataFrame([("done", "n", "200", "x", 1), ("same", "n", "200", "h", 1), ("failed", None, "502", "x", 1), ("changed", "new", "200", "x", 1), ("new", "old version", "200", "y", 1), ("new", "n", "200", "z", 2), ("new", None, "502", "w", 3), ("gone", None, "502", "v", 1), (None, "n", "200", "x", 1)], BATCH)
    return stored, batch


def test_upsert(spark):
    stored, batch = versions(spark)
    actions = {r.paragraph_link: r.action for r in upsert.classified(stored, batch).collect()}
    assert actions == {"done": "skip_analysed", "same": "skip_same", "failed": "skip_failed", "changed": "update", "new": "insert", "gone": "skip_failed"}
    once = sorted(tuple(r) for r in upsert.applied(stored, batch).collect())
    assert [(r[0], r[2], r[5]) for r in once] == [(1, "t", True), (2, "t", False), (3, "t", False), (4, "new", False), (5, "dup", False), (6, "t", False), (7, "n", False)]
    again = upsert.applied(spark.createDataFrame(once, STORED), batch)
    assert sorted(tuple(r) for r in again.collect()) == once
    empty = spark.createDataFrame([], STORED)
    assert [(r.id, r.paragraph_link) for r in upsert.applied(empty, batch).orderBy("id").collect()] == [(1, "changed"), (2, "done"), (3, "new"), (4, "same")]
    assert sorted(tuple(r) for r in upsert.applied(stored, batch.limit(0)).collect()) == sorted(tuple(r) for r in stored.collect())


def test_numbered(spark):
    df = spark.createDataFrame([(f"{i:04d}",) for i in range(777)], "k string").repartition(7)
    assert [r.n for r in upsert.numbered(df, "k", "n").orderBy("k").collect()] == list(range(1, 778))
    assert upsert.numbered(df.limit(0), "k", "n").count() == 0


@pytest.mark.parametrize("conf", [{}, {"spark.sql.adaptive.enabled": "false"}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}])
def test_numbered_keeps_many_wide_rows(spark, conf):
    n = 400_000
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, n, 1, 16).select(F.md5(F.col("id").cast("string")).alias("k"), *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(i)), 256).alias(f"w{i}") for i in range(3)])
        out = upsert.numbered(df, "k", "n").selectExpr("count(*) as c", "count(distinct n) as d", "min(n) as a", "max(n) as z").first()
        assert tuple(out) == (n, n, 1, n)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_stored_hash_is_that_of_json_with_sorted_keys(spark):
    import hashlib
    import json

    comments = [{"comment_score": 1, "commenter": "a", "comment": '漲"😀\\\n/x\t\x7f\x01', "comment_time": "2024-06-01 08:00"}, {"comment_score": None, "commenter": None, "comment": "", "comment_time": None}]
    rows = [("http://x/1", "甲", "[標的] 😀", datetime(2024, 6, 1, 8, 0, 7), "line\r\n二", "1.2.3.4", "Unknown", comments, "200"), ("l", None, None, None, None, None, None, [], "502")]
    fields = [f for f in upsert.HASHED]
    schema = "paragraph_link string, paragraph_author string, paragraph_title string, paragraph_published_time timestamp_ntz, paragraph_content string, paragraph_ip string, paragraph_country string, comments array<struct<comment_score int, commenter string, comment string, comment_time string>>, status string"
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(upsert.stored_hash(df)).collect()]
    for row, h in zip(rows, got):
        data = dict(zip(fields, row)) | {"paragraph_published_time": row[3] and row[3].strftime("%Y-%m-%d %H:%M:%S")}
        assert h == hashlib.md5(json.dumps(data, sort_keys=True).encode()).hexdigest()


@pytest.mark.parametrize("count", [0, 1, 44, 45, 46, 90, 91])
def test_batches_and_back(spark, count):
    articles, _ = frames(spark, [(1, None, [comment(i, None, None, False, f"看好{i}") for i in range(count)], None, False), (2, None, None, None, False)])
    batches = enrich.batched(articles)
    assert sorted(len(r.texts) for r in batches.collect()) == sorted([45] * (count // 45) + ([count % 45] if count % 45 else []))
    out = {r.id: r for r in enrich.rewritten(articles, enrich.scored(batches)).collect()}
    assert [(c.comment, c.stock_sentiment) for c in out[1].comments] == [(f"看好{i}", 0.25) for i in range(count)]
    assert all(c.analyzed for c in out[1].comments) and out[2].comments is None and out[2].done_analyze is False
    assert enrich.rewritten(enrich.rewritten(articles, enrich.scored(batches)), enrich.scored(batches.limit(0))).where("id = 1").first().done_analyze is True


def test_pending_batches_resume(spark):
    rows = [(1, None, [comment(i, None, None, i < 10 or i > 20) for i in range(30)], None, False), (2, None, [], None, False), (3, None, None, None, False), (4, None, [comment(0, None)], None, True)]
    articles, _ = frames(spark, rows)
    assert sorted((r.id, r.batch, len(r.texts)) for r in enrich.pending(articles, 7).collect()) == [(1, 1, 7), (1, 2, 7)]
    assert {r.id: (r.comments, r.analysed) for r in enrich.analysed_counts(articles).collect()} == {1: (30, 19), 2: (0, 0), 3: (0, 0), 4: (1, 1)}


def test_models_plug_in(spark, tmp_path):
    items = vectors.collection(frames(spark, [])[1], frames(spark, [])[1], "m")
    vectors.write_collection(vectors.embedded(items.where("type = 'code'"), lambda texts: [[float(len(t)), 1.0] for t in texts]), str(tmp_path / "v"))
    vectors.write_collection(vectors.embedded(items.where("type = 'name'"), lambda texts: [[float(len(t)), 1.0] for t in texts]), str(tmp_path / "v"), recreate=False)
    stored = spark.read.parquet(str(tmp_path / "v"))
    assert stored.count() == items.count() == 11 and stored.where("no = '0050' and type = 'code'").first().embedding == [4.0, 1.0]
    texts = spark.createDataFrame([(1, "one two"), (2, None)], "id bigint, t string")
    extractor = lambda batch: [[("ORG", "one"), ("ORG", "one"), ("GPE", "two"), ("ORG", "none")] if t else [] for t in batch]
    names = spark.createDataFrame([("one",), ("two",), (None,)], "n string")
    assert [tuple(r) for r in entities.extracted(texts, "id", "t", extractor, ["ORG", "CARDINAL"], names).collect()] == [(1, "one")]


def test_scorer_is_retried_then_fails(spark):
    articles, _ = frames(spark, [(1, None, [comment(0, None)], None, False)])
    with pytest.raises(Exception, match="0 results for 1 comments"):
        enrich.scored(enrich.batched(articles), lambda texts: []).collect()


def test_model_output_shapes(spark):
    texts = ['[{"stock_sentiment": 0.5, "stock_targets": ["a"]}]', '{"1": {"stock_sentiment": -1, "stock_targets": []}, "0": {"stock_sentiment": 1, "stock_targets": ["b"]}}', "bad", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(enrich.parsed_results(F.col("t")).alias("r")).collect()
    assert [[x.stock_sentiment for x in r.r] if r.r else r.r for r in rows][:2] == [[0.5], [1.0, -1.0]] and not rows[3].r


def test_fuzzy_join_loses_nothing(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 9)))
    tokens, entries = [word() for _ in range(150)] + [None, ""], [(str(i), rng.choice(["name", "code"]), word()) for i in range(150)] + [("x", "name", None), ("y", "name", "")]
    limits = {"name": 0.65, "code": 0.9}
    got = {tuple(r) for r in entities.fuzzy_pairs(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame(entries, "stock_no string, kind string, entry string"), limits).collect()}
    want = {(t, no, k, e, 1.0 - restricted_distance(t, e) / max(len(t), len(e))) for t in tokens if t for no, k, e in entries if e and 1.0 - restricted_distance(t, e) / max(len(t), len(e)) >= limits[k]}
    assert got == want


def test_known_similarities_and_context(spark):
    tokens = spark.createDataFrame([("第一",), ("台灣",), ("GG",)], "token string")
    entries = spark.createDataFrame([("1", "name", "第一銅"), ("2", "name", "台灣大"), ("3", "nickname", "GG"), ("4", "nickname", "gg")], "stock_no string, kind string, entry string")
    best = entities.best_matches(entities.fuzzy_pairs(tokens, entries, {"name": 0.65, "nickname": 0.65}))
    assert {r.token: (r.stock_no, round(r.similarity, 4)) for r in best.collect()} == {"第一": ("1", 0.6667), "台灣": ("2", 0.6667), "GG": ("3", 1.0)}
    dataset = spark.createDataFrame([("1", "第一銅", "copper", "{}"), ("3", "Three", None, None)], "stock_no string, stock_name string, business_scope string, competitor string")
    nicks = spark.createDataFrame([("3", "GG", "sounds alike"), ("3", "other", "x"), (None, "GG", "y")], "stock_no string, stock_nickname string, nickname_explain string")
    keys = spark.createDataFrame([(1,), (2,)], "key int")
    context = {r.key: r.context for r in entities.context_lines(best.withColumn("key", F.lit(1)), dataset, nicks, keys).collect()}
    lines = context[1].split("\n")
    assert "GG: similar to the nickname GG of Three (3), 100.00 % (sounds alike)" in lines and "第一銅 (1): copper" in lines
    assert "第一: similar to the name 第一銅 (1), 66.67 %" in lines and not [x for x in lines if x.startswith("Three")] and context[2] == entities.NO_MATCH
    comments = spark.createDataFrame([(1, "GG"), (2, None)], "id int, t string")
    scorer = lambda pairs: [(float(len(t)), c.split("\n")[:1]) for t, c in pairs]
    got = {r.id: (r.stock_sentiment, r.stock_targets[0]) for r in entities.scored_with_context(comments, spark.createDataFrame(list(context.items()), "key int, context string"), scorer, "id", "t").collect()}
    assert got[1][0] == 2.0 and got[2] == (0.0, entities.NO_MATCH)


def test_contained_finds_overlapping_names(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, None), (3, ""), (4, "xyz")], "id bigint, t string")
    names = spark.createDataFrame([("abc",), ("bc",), ("c",), ("",), (None,), ("zz",)], "n string")
    want = [(1, "abc"), (1, "bc"), (1, "c")]
    assert sorted(tuple(r) for r in entities.contained(texts, "id", "t", names).collect()) == want
    listed = names.where("n <> ''").toDF("token")
    assert sorted(tuple(r) for r in entities._contained_by_join(texts, "id", "t", listed).collect()) == want
    assert entities.contained(texts, "id", "t", names.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2000, 7])
def test_nearest_equals_brute_force(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(1)
    m = rng.integers(-3, 4, (60, 4)).astype(float)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(100, None), (101, []), (102, [0.0] * 4), (103, [1.0])]
    items = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in vectors.nearest(items.where("vec_id % 20 = 0"), items, top=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, round(r.score, 9)))
    norm = np.linalg.norm(m, axis=1)
    for q in (0, 20, 40):
        if norm[q]:
            score = [(round(-(m[q] @ m[i]) / norm[q] / norm[i], 9), i) for i in range(60) if norm[i]]
            assert [s for _, _, s in sorted(got[q])] == [-s for s, _ in sorted(score)[:3]]
    assert set(got) <= {0, 20, 40}
    assert vectors.nearest(items.limit(0), items).count() == 0
