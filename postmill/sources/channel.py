"""Exports of a channel as a data source of Spark's: pages of messages by id, newest first, in batches and as a stream."""

from __future__ import annotations

import datetime as dt
import json
import re

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import MESSAGE_WITH_ENTITIES

#: Ids that one page spans.
PAGE = 1000


def write_export(messages: DataFrame, path: str, page: int = PAGE, mode: str = "errorifexists") -> None:
    """JSON lines in folders page=<id div page>, one file or more each: the place of a message follows from its id. Null ids are left out."""
    paged = messages.where("id is not null").withColumn("page", F.floor(F.col("id") / page).cast("long"))
    paged.repartition("page").write.mode(mode).partitionBy("page").json(path)


class Pages:
    """The pages below a path, on any file system that Arrow knows."""

    def __init__(self, path: str):
        self.path = path

    def numbers(self) -> list[int]:
        system, base = pafs.FileSystem.from_uri(self.path)
        found = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return sorted(int(m[1]) for x in found if (m := re.search(r"page=(-?\d+)$", x.path)))

    def messages(self, number: int):
        """The messages of a page as dicts, in order of the files' lines."""
        system, base = pafs.FileSystem.from_uri(self.path)
        for x in sorted(system.get_file_info(pafs.FileSelector(f"{base}/page={number}")), key=lambda x: x.path):
            if x.is_file and re.search(r"/[^._][^/]*\.json$", x.path):
                with system.open_input_stream(x.path) as f:
                    yield from (json.loads(line) for line in f.read().splitlines() if line.strip())


def row_of(m: dict) -> tuple:
    date = m.get("date")
    when = dt.datetime.fromisoformat(date) if date else None
    entities = m.get("entities")
    marks = None if entities is None else [{k: e.get(k) for k in ("type", "offset", "length", "url")} for e in entities]
    return (m["id"], when, *(m.get(k) for k in ("text", "url", "contact_links", "views", "forwards", "channel")), marks)


class Page(InputPartition):
    def __init__(self, number: int, above: int, upto: int | None):
        super().__init__(number)
        self.number, self.above, self.upto = number, above, upto


def read_page(pages: Pages, part: Page | None):
    """The messages of a page within its bounds; Spark asks for no page (None) where there is none."""
    for m in pages.messages(part.number) if part else ():
        if m["id"] > part.above and (part.upto is None or m["id"] <= part.upto):
            yield row_of(m)


class ExportReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages, self.newest = Pages(options["path"]), options.get("newest")

    def partitions(self):
        numbers, above = self.pages.numbers(), -(1 << 63)
        if self.newest is not None:
            # ids of the newest pages alone, until there are enough
            newest, ids, kept = int(self.newest), [], []
            for number in reversed(numbers if newest > 0 else []):
                kept.append(number)
                ids += [m["id"] for m in self.pages.messages(number)]
                if len(ids) >= newest:
                    above = sorted(ids)[-newest] - 1
                    break
            numbers = kept
        return [Page(x, above, None) for x in numbers]

    def read(self, partition: Page | None):
        return read_page(self.pages, partition)


class ExportStream(DataSourceStreamReader):
    """Offsets are ids of messages: a batch holds the ids above the last one's, so a restart goes on exactly there."""

    def __init__(self, options: dict):
        self.pages, self.size = Pages(options["path"]), int(options.get("page", PAGE))

    def initialOffset(self) -> dict:
        return {"id": -(1 << 62)}

    def latestOffset(self) -> dict:
        numbers = self.pages.numbers()
        return {"id": max((m["id"] for m in self.pages.messages(numbers[-1])), default=-(1 << 62))} if numbers else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        first, last = start["id"] // self.size, end["id"] // self.size
        return [Page(x, start["id"], end["id"]) for x in self.pages.numbers() if first <= x <= last]

    def read(self, partition: Page | None):
        return read_page(self.pages, partition)


class ChannelExport(DataSource):
    """format("channel_export"), options: path (a URI), newest (how many of the greatest ids; batch), page (as written; stream).

    A task reads one page. The newest messages are chosen by the ids of the last pages, and no other page is opened. New messages of a
    stream have greater ids than all before them, as a channel numbers them."""

    @classmethod
    def name(cls) -> str:
        return "channel_export"

    def schema(self) -> str:
        return MESSAGE_WITH_ENTITIES

    def reader(self, schema) -> ExportReader:
        return ExportReader(dict(self.options))

    def streamReader(self, schema) -> ExportStream:
        return ExportStream(dict(self.options))


def read_export(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    spark.dataSource.register(ChannelExport)
    reader = spark.read.format("channel_export").option("path", path)
    return (reader.option("newest", newest) if newest is not None else reader).load()


def read_export_stream(spark: SparkSession, path: str, page: int = PAGE) -> DataFrame:
    spark.dataSource.register(ChannelExport)
    return spark.readStream.format("channel_export").option("path", path).option("page", page).load()
