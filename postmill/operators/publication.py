"""Choosing what to publish and recording that it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_control

#: Titles that stand for a post that was not parsed.
BLOCKED_TITLES = ("raw_post", "placeholder")


def title_is_stored_ok(title: Column) -> Column:
    """The storage's filter: blanks alone are trimmed."""
    return ~F.lower(F.trim(title)).isin(*BLOCKED_TITLES)


def title_is_eligible(title: Column) -> Column:
    """The publisher's filter: not empty and not blocked after a full trim."""
    plain = F.lower(trim_control(title))
    return (plain != "") & ~plain.isin(*BLOCKED_TITLES)


def ready_for_publication(jobs: DataFrame, posts: DataFrame, chat: str, n: int) -> DataFrame:
    """The n oldest jobs that a chat has not had: an anti join, then a top-k without a full sort. Ties go to the smaller id."""
    had = posts.where(F.col("channel_chat_id") == chat).select(F.col("job_id").alias("id"))
    return jobs.where(title_is_stored_ok(F.col("title"))).join(had, "id", "left_anti").orderBy("posted_at", "created_at", "id").limit(n)


def latest_published(posts: DataFrame) -> DataFrame:
    return posts.groupBy(F.col("job_id").alias("id")).agg(F.max("published_at").alias("_latest"))


def merge_latest_published(jobs: DataFrame, posts: DataFrame) -> DataFrame:
    """Jobs with telegram_published_at moved on (never back) to the newest of their posts."""
    joined = jobs.join(latest_published(posts), "id", "left")
    return joined.withColumn("telegram_published_at", F.greatest("telegram_published_at", "_latest")).select(*jobs.columns)


def new_posts(posts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that are first for their (job, chat) and not among posts, one for each: of rows that repeat the first time
    and id one stays. Null times and ids come last; null keys are a key of their own, which no post has."""
    keys = ["job_id", "channel_chat_id"]
    rest = [c for c in candidates.columns if c not in keys]
    order = F.struct(*(y for c in ("published_at", "id") for y in (F.col(c).isNull(), F.col(c))))
    first = candidates.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(*keys, "_first.*")
    return first.join(posts.select(*keys), keys, "left_anti").select(*candidates.columns)


def mark_published(jobs: DataFrame, posts: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, posts) after recording the candidates; a job moves on only for posts that were really added. Idempotent."""
    added = new_posts(posts, candidates)
    return merge_latest_published(jobs, added), posts.unionByName(added)


def cascade_delete(posts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Posts whose job is still there."""
    return posts.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi").select(*posts.columns)


def find_by_id(jobs: DataFrame, id_: str) -> DataFrame:
    """The job of an id; the filter reaches the file scan."""
    return jobs.where(F.col("id") == id_).limit(1)
