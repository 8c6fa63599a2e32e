import subprocess
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.sources import files, pages, rest, settings
from tidemark.streaming import ingest

PAGE = """<html><div id="main-content" class="bbs-screen"><div class="article-metaline"><span class="article-meta-tag">作者</span><span class="article-meta-value">who (x)</span></div>
<div class="article-metaline"><span class="article-meta-tag">標題</span><span class="article-meta-value">[標的] 5777</span></div>
<div class="article-metaline"><span class="article-meta-tag">時間</span><span class="article-meta-value">Tus Jun  4 08:00:07 2024</span></div>body <b>text</b>
--
※ 發信站, 來自: 1.2.3.4 (北)
<div class="push"><span class="hl push-tag">推 </span><span class="f3 push-userid">u1</span><span class="f3 push-content">: good</span><span class="push-ipdatetime"> 06/05 09:10
</span></div><div class="push"><span class="push-tag">噓 </span><span class="push-content">: bad</span><span class="push-ipdatetime">02/30 09:10</span></div>
<div class="push"><span class="push-tag">推 </span><span class="push-userid">u3</span></div></div></html>"""


def test_pages(spark):
    served = {"h/a": (200, PAGE), "h/b": (301, "moved"), "h/c": (200, "<html></html>")}
    urls = spark.createDataFrame([(u,) for u in served], "url string")
    rows = {r.paragraph_link: r for r in pages.articles(pages.fetched(urls, lambda u: served[u])).collect()}
    a = rows["h/a"]
    assert (a.paragraph_author, a.paragraph_title, a.paragraph_tag, a.paragraph_ip, a.paragraph_country, a.status) == ("who (x)", "[標的] 5777", "標的", "1.2.3.4", "北", "200")
    assert a.paragraph_published_time == datetime(2024, 6, 4, 8, 0, 7) and a.paragraph_content == "body text"
    assert [tuple(c) for c in a.comments] == [(1, "u1", " good", "2024-06-05 09:10"), (-1, "Unknown", " bad", None)]
    assert rows["h/b"].status == rows["h/c"].status == "502" and rows["h/b"].paragraph_published_time == datetime(2007, 1, 1)
    listing = spark.createDataFrame([("p", '<div class="title">\n<a href="/x">1</a></div><div class="title">deleted</div><div class="title"><a href="/y">2</a></div>'), ("q", None)], "url string, html string")
    assert [(r.position, r.link) for r in pages.listing_links(listing, "https://h").collect()] == [(0, "https://h/x"), (1, "https://h/y")]
    assert [r.page for r in pages.page_range(spark, 60, 3).collect()] == [57, 58, 59] and pages.page_range(spark, 2, 50).count() == 2
    assert pages.discover_end(5, lambda n: 200 if n < 9 else 404) == 9
    assert listing.select(pages.tag_texts(F.col("html"), "a").alias("t")).first().t == ["1", "2"]


def test_listing_pages_as_a_data_source(spark, tmp_path):
    from tidemark.session import share_package
    from tidemark.sources.live import ListingPages

    for n in (3, 4, 6):
        (tmp_path / f"index{n}.html").write_text(f"page {n}")
    share_package(spark)
    spark.dataSource.register(ListingPages)
    df = spark.read.format("listing_pages").option("template", f"file://{tmp_path}/index{{page}}.html").option("start", 3).option("end", 7).option("run", 2).load()
    assert [(r.page, r.status, r.html) for r in df.orderBy("page").collect()] == [(3, "200", "page 3"), (4, "200", "page 4"), (5, "502", None), (6, "200", "page 6")]


def test_files(spark, tmp_path):
    targets = spark.createDataFrame([("0050", 'a "quoted", name'), ("00900", None)], "stock_no string, stock_name string")
    files.write_csv(targets, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in files.csv_dictionary(spark, str(tmp_path / "t")).collect()) == [("0050", 'a "quoted", name'), ("00900", None)]
    (tmp_path / "old.csv").write_text("no,name\n0051,b\n")
    assert [tuple(r) for r in files.csv_dictionary(spark, str(tmp_path / "old.csv")).collect()] == [("0051", "b")]
    files.write_pieces(targets.withColumn("piece", F.lit(1)), str(tmp_path / "p"))
    assert (tmp_path / "p" / "piece=1").is_dir()
    (tmp_path / "listed.json").write_text('[{"No": "1", "Name": "a"}, {"No": null}]')
    assert [tuple(r) for r in files.listed_companies(spark, str(tmp_path / "listed.json")).collect()] == [("1", "a")]
    body = files.as_json(targets, "stock_no")
    assert sorted(map(tuple, files.from_json_rows(body, targets.schema).collect()), key=repr) == sorted(map(tuple, targets.collect()), key=repr)


def test_rest_and_settings(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", i) for i in range(1, 26)], "id bigint, title string, n int")
    assert [r.id for r in rest.listed(df, 3).collect()] == list(range(21, 26))
    changed = rest.updated(rest.created(df, df.where("id = 1").withColumn("id", F.lit(99).cast("bigint"))), 2, {"title": "x", "id": 5})
    assert changed.where("title = 'x'").count() == 1 and changed.where("id = 2").first().title == "x" and changed.schema == df.schema
    assert rest.deleted(changed, 99).count() == 25 and rest.retrieved(df, 7).first().title == "t7"
    path = str(tmp_path / "settings")
    assert settings.read_setting(spark, path, "end_index", 3) == 3
    settings.write_setting(spark, path, "end_index", 10)
    settings.write_setting(spark, path, "end_index", 8)
    settings.write_setting(spark, path, "other", 1)
    assert settings.read_setting(spark, path, "end_index") == 8 and settings.all_settings(spark, path).count() == 2


def test_stream_of_upserts(spark, tmp_path):
    from test_operators import BATCH, STORED, versions

    stored, batch = versions(spark)
    root, inbox = str(tmp_path / "articles"), tmp_path / "in"
    stored.limit(0).write.parquet(f"{root}/v=000000000000")
    batch.write.parquet(str(inbox / "a"))
    source = lambda: spark.readStream.schema(BATCH).option("recursiveFileLookup", True).parquet(str(inbox))
    run = lambda: ingest.upsert_stream(source(), root, spark.createDataFrame([], STORED).schema, str(tmp_path / "check")).awaitTermination()
    run()
    schema = spark.createDataFrame([], STORED).schema
    first = sorted(tuple(r) for r in ingest.read_current(spark, root, schema).collect())
    assert [r[1] for r in first] == ["changed", "done", "new", "same"]
    run()
    assert sorted(tuple(r) for r in ingest.read_current(spark, root, schema).collect()) == first
    spark.createDataFrame([("done", "newer", "200", "q", 9)], BATCH).write.parquet(str(inbox / "b"))
    run()
    assert {r.paragraph_link: r.paragraph_title for r in ingest.read_current(spark, root, schema).collect()}["done"] == "newer"


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 5), "a"), (datetime(2024, 1, 1, 7), "a"), (datetime(2024, 1, 2, 1), "b"), (None, "a")]
    df = spark.createDataFrame(rows, "fetched_at timestamp_ntz, stock_no string")
    df.write.parquet(str(tmp_path / "m"))
    stream = ingest.windowed_mentions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "m")))
    stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.stock_no, r.mentions) for r in spark.table("windows").collect()) == [("a", 2), ("b", 1)]


def test_core_does_not_need_the_text_operators():
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('p4')]; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()[-1]) > 40
    for path in (root / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(root / "tidemark").parts:
            assert "tidemark.llm" not in path.read_text(), path
