"""Paged listings as a data source. In a batch: one partition for each page, read until the listing ends. As a stream: on from where it ended.

Live collection is not part of this library: pages come from a folder of JSON files (page N in
N.json), as dumped by whatever fetched them. The folder may be on any file system that Spark reads.
A page is a list of records, or an object with its records under "jobs" and the number of all
records under "hits". The scan ends at the first page that is missing, empty or can't be read, when
the records so far are as many as the hits, and after ``max_pages``; what came before is kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "page int, position int, record string"


class PagedListing(DataSource):
    """spark.read.format("paged_listing").option("path", folder).option("max_pages", 25).load()"""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("max_pages", 25)))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("max_pages", 25)))


class _Reader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> list[InputPartition]:
        """The pages are opened in order on the driver for where the listing ends; their records are read in tasks."""
        pages, fetched = [], 0
        for number in range(1, self.most + 1):
            page = records_of(_content(self.folder, number))
            if page is None or not page[0]:
                break
            pages.append(InputPartition(number))
            fetched += len(page[0])
            if page[1] is not None and fetched >= page[1]:
                break
        return pages or [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            records, _ = records_of(_content(self.folder, partition.value)) or ([], None)
            for i, record in enumerate(records):
                yield partition.value, i, json.dumps(record, ensure_ascii=False)


class _StreamReader(SimpleDataSourceStreamReader):
    """A listing that grows, read on from where the last trigger ended: the offset is a page and how many of its records were read.

    A page is opened once by each trigger that gets to it, on the driver; a trigger takes ``max_pages`` pages at most,
    which bounds what the driver holds. A page that isn't there yet, or can't be read, ends the trigger, not the stream.
    """

    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def initialOffset(self) -> dict:
        return {"page": 1, "position": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        number, position, rows = start["page"], start["position"], []
        for _ in range(self.most):
            records, _hits = records_of(_content(self.folder, number)) or ([], None)
            rows += [(number, i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records[position:], position)]
            position = max(position, len(records))
            following = records_of(_content(self.folder, number + 1))
            if not following or not following[0]:
                break  # the last page so far may still grow
            number, position = number + 1, 0
        return iter(rows), {"page": number, "position": position}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same rows again, after a failure; a page that has grown since gives what it gave then."""
        for number in range(start["page"], end["page"] + 1):
            records, _ = records_of(_content(self.folder, number)) or ([], None)
            first = start["position"] if number == start["page"] else 0
            last = end["position"] if number == end["page"] else len(records)
            for i, record in enumerate(records[first:last], first):
                yield number, i, json.dumps(record, ensure_ascii=False)


def _content(folder: str, number: int) -> bytes | None:
    """A page's bytes, null if it isn't there or can't be read."""
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    try:
        with store.open_input_stream(f"{root.rstrip('/')}/{number}.json") as f:
            return f.read()
    except OSError:
        return None


def records_of(content: bytes | None) -> tuple[list, int | None] | None:
    """A page's records and the number of hits it tells, or null if it is no page."""
    try:
        page = json.loads(content or b"")
    except ValueError:
        return None
    if isinstance(page, dict):
        hits = page.get("hits")
        return page.get("jobs") or [], hits if isinstance(hits, int) else None
    return (page, None) if isinstance(page, list) else None


def search(spark: SparkSession, folder: str, keywords: str, location: str, max_pages: int = 25) -> DataFrame:
    """The pages of one search, with what was searched for beside each record."""
    rows = spark.read.format("paged_listing").option("path", folder).option("max_pages", max_pages).load()
    return rows.withColumns({"keywords": F.lit(keywords), "search_location": F.lit(location)})
