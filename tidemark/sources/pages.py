"""Crawled pages: ranges of listing pages, fetching behind an interface, and parsing of listings, articles and profiles.

Fetching is a function from URL to (status, html) so that nothing here needs a network; ``Pages`` makes it a Spark data
source whose partitions are page numbers. Parsing of fixed patterns uses built-in regular expressions; only comment
blocks, which nest tags, go through the standard HTML parser in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import text as T
from tidemark.functions import times

Fetch = Callable[[str], tuple[int, str]]


def page_range(spark: SparkSession, end: int, past: int = 50) -> DataFrame:
    """Numbers of the newest pages: from end - past up to, not including, end; never below 0."""
    return spark.range(max(0, end - past), max(0, end)).withColumnRenamed("id", "page")


def discover_end(start: int, status: Callable[[int], int]) -> int:
    """The first page number after ``start`` that isn't there. Driver-side: it asks the site, not the data."""
    number = start
    while status(number) == 200:
        number += 1
    return number


def fetched(urls: DataFrame, fetch: Fetch, column: str = "url") -> DataFrame:
    """url, status, html. Anything but 200, redirects included, counts as failed (502) and has no page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [fetch(u) for u in pdf[column]]
            yield pd.DataFrame({"url": pdf[column], "status": ["200" if s == 200 else "502" for s, _ in got], "html": [h if s == 200 else None for s, h in got]})

    return urls.select(column).mapInPandas(run, "url string, status string, html string")


def listing_links(pages: DataFrame, host: str) -> DataFrame:
    """One row per linked title of a listing page; titles without a link are deleted articles and give none."""
    links = F.regexp_extract_all("html", F.lit(r'<div class="title">\s*<a href="([^"]+)"'), F.lit(1))
    return pages.where("html is not null").select("url", F.posexplode(links).alias("position", "path")).select("url", "position", T.absolute_url(host, F.col("path")).alias("link"))


def tag_texts(html: Column, tag: str) -> Column:
    """Texts of all elements of a tag, inner tags removed."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", "")))


def meta_value(html: Column, label: str) -> Column:
    """The value beside a label in an article's head."""
    found = F.regexp_extract(html, rf'article-meta-tag">{label}</span>\s*<span class="article-meta-value">([^<]*)<', 1)
    return F.when(found == "", None).otherwise(found)


class _Article(HTMLParser):
    """Comment blocks and the main text of an article page."""

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[str] = []
        self.pushes: list[dict[str, str]] = []
        self.main: list[str] = []
        self.found = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        names = (a.get("class") or "").split()
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            return
        mark = "main" if a.get("id") == "main-content" else next((n for n in names if n.startswith("push")), names[0] if names else "")
        self.found |= mark == "main"
        if mark == "push":
            self.pushes.append({})
        self.stack.append(mark)

    def handle_endtag(self, tag: str) -> None:
        if self.stack and tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.stack.pop()

    def handle_data(self, data: str) -> None:
        if "push" in self.stack:
            last = self.stack[-1]
            if last.startswith("push-"):
                self.pushes[-1][last] = self.pushes[-1].get(last, "") + data
        elif "main" in self.stack and not any(s.startswith("article-meta") for s in self.stack):
            self.main.append(data)


_BODY = "url string, status string, html string, main string, comments array<struct<mark:string,commenter:string,comment:string,comment_time:string>>"


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        mains, comments = [], []
        for html in pdf["html"]:
            page = _Article()
            page.feed(html or "")
            mains.append("".join(page.main) if page.found else None)
            # A comment without mark, text or time is dropped; one without a name stays.
            comments.append([
                {"mark": p["push-tag"], "commenter": p.get("push-userid", "").strip() or T.UNKNOWN, "comment": p["push-content"], "comment_time": p["push-ipdatetime"]}
                for p in page.pushes if {"push-tag", "push-content", "push-ipdatetime"} <= p.keys()
            ])
        yield pdf[["url", "status", "html"]].assign(main=mains, comments=comments)


def articles(pages: DataFrame) -> DataFrame:
    """Pages (url, status, html) as articles. A page without main content is an error row: status 502, no comments.
    Unreadable times take the default; comments then have no time but stay."""
    body = pages.select("url", "status", "html").mapInPandas(_parsed, _BODY)
    time = times.forum_time(meta_value(F.col("html"), "時間"))
    footer = F.substring_index("main", T.FOOTER, -1)
    made = body.select(
        F.col("url").alias("paragraph_link"), F.coalesce(meta_value(F.col("html"), "作者"), F.lit(T.UNKNOWN)).alias("paragraph_author"),
        meta_value(F.col("html"), "標題").alias("paragraph_title"), time.alias("_time"), T.cut_at_last(F.col("main")).alias("paragraph_content"),
        T.last_sender_ip(footer).alias("paragraph_ip"), T.last_sender_country(footer).alias("paragraph_country"), F.col("comments").alias("_comments"),
        F.when(F.col("main").isNull(), "502").otherwise(F.col("status")).alias("status"),
    )
    comment = lambda c: F.struct(
        T.push_score(c["mark"]).alias("comment_score"), c["commenter"].alias("commenter"), T.drop_first(c["comment"]).alias("comment"),
        F.date_format(times.comment_time(c["comment_time"], F.col("_time")), "yyyy-MM-dd HH:mm").alias("comment_time"),
    )
    made = made.withColumn("comments", F.transform("_comments", comment))
    made = made.withColumn("paragraph_published_time", times.or_default(F.col("_time"))).drop("_time", "_comments")
    return made.withColumn("paragraph_tag", T.title_tag(F.col("paragraph_title")))
