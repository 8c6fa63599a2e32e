"""Listing pages as a Spark data source: a partition is a run of page numbers, each fetched by the task that holds it.

    spark.dataSource.register(ListingPages)
    spark.read.format("listing_pages").option("template", "https://host/index{page}.html").option("start", 10).option("end", 60).load()

Redirects count as failures, as in ``pages``. ``file:`` addresses work too, which is how tests run without a network.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: object) -> None:
        return None


def fetch(url: str, timeout: float = 30.0) -> tuple[int, str]:
    """(status, text) of a page; 0 where nothing answered."""
    try:
        with urllib.request.build_opener(_NoRedirect).open(url, timeout=timeout) as answer:
            return getattr(answer, "status", None) or 200, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, ""
    except (urllib.error.URLError, OSError):
        return 0, ""


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.template = options["template"]
        self.start, self.end, self.run = int(options["start"]), int(options["end"]), max(1, int(options.get("run", 5)))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((a, min(a + self.run, self.end))) for a in range(self.start, self.end, self.run)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in range(*partition.value):
            url = self.template.format(page=page)
            status, html = fetch(url)
            yield page, url, "200" if status == 200 else "502", html if status == 200 else None


class ListingPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return "page bigint, url string, status string, html string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)
