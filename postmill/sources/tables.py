"""The jobs table as clustered files, and reads that look at few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.publication import ready_for_publication

#: Columns by whose values single rows are looked up.
LOOKED_UP = ("id", "dedup_hash", "source_post_hash", "location")


def write_clustered(jobs: DataFrame, path: str, files: int | None = None, row_group_bytes: int = 32 << 20, mode: str = "errorifexists") -> None:
    """Files by ranges of posted_at, rows in each by location, so that the least and greatest values of files and row groups
    serve as indexes on both; Bloom filters on ids, hashes and locations let a lookup skip row groups without the value.

    Null times come first, null locations first in their file. ``files``: how many ranges (by default as Spark chooses)."""
    ranges = ("posted_at", "id")
    dealt = jobs.repartitionByRange(files, *ranges) if files else jobs.repartitionByRange(*ranges)
    writer = dealt.sortWithinPartitions("location", "posted_at", "id").write.mode(mode).option("parquet.block.size", row_group_bytes)
    for column in (c for c in LOOKED_UP if c in jobs.columns):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def by_location(jobs: DataFrame, location: str, since=None, until=None) -> DataFrame:
    """The jobs of a place, posted from ``since`` on and before ``until``, newest first within each task; every condition reaches the scan."""
    found = jobs.where(F.col("location") == location)
    found = found.where(F.col("posted_at") >= F.lit(since)) if since is not None else found
    found = found.where(F.col("posted_at") < F.lit(until)) if until is not None else found
    return found.sortWithinPartitions(F.desc("posted_at"), "id")


def ready_from_clustered(jobs: DataFrame, posts: DataFrame, chat: str, n: int) -> DataFrame:
    """``ready_for_publication`` in two reads of a clustered table: the n rows are chosen by four narrow columns, and whole
    rows are then read from the row groups alone whose times and ids can hold them. n ids come to the driver."""
    chosen = ready_for_publication(jobs.select("id", "title", "posted_at", "created_at"), posts, chat, n).select("id", "posted_at").collect()
    if not chosen:
        return jobs.where("false")
    times = [r.posted_at for r in chosen if r.posted_at is not None]
    within = F.col("posted_at").between(F.lit(min(times)), F.lit(max(times))) if times else F.lit(False)
    within = within | F.col("posted_at").isNull() if len(times) < len(chosen) else within
    return jobs.where(within & F.col("id").isin([r.id for r in chosen])).orderBy("posted_at", "created_at", "id")
