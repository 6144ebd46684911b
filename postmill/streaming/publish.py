"""Delivery of captions with a second attempt as plain text, and rounds of publication by the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_html
from ..operators.caption import render
from ..operators.dedup import scratch_tables, written
from ..schemas import ATTEMPTS, CHANNEL_POSTS
from .ingest import publish_round, read_table

#: Fixed value: what a refusal for a caption's markup says.
MARKUP = "can't parse entities"
ERRORS = "round BIGINT, error STRING, at TIMESTAMP"


def resending(deliver, attempts_path: str, footer: str, banner: str | None = None):
    """A ``send`` for ``publish_round``: captions with markup go to ``deliver``; what is refused for its markup goes once more
    as plain text, and only that is.

    ``deliver`` takes (key, channel_chat_id, caption, html) and returns (key, message_id, error). A key names one delivery of a job to a
    chat in one form, the same in every attempt, so a receiver that knows it does not show a job twice when a task
    that has sent is run again. Every attempt is recorded at ``attempts_path``; a delivery that succeeded in an earlier round whose
    end was lost is taken from there and not sent again. Jobs that could not be delivered give no post and stay ready."""

    def send(chosen: DataFrame, chat: str, now) -> DataFrame:
        spark = chosen.sparkSession
        known = read_table(spark, attempts_path, ATTEMPTS).where("message_id is not null").select("job_id", "channel_chat_id", "message_id", F.col("caption").alias("sent"))
        rows = chosen.select(F.col("id").alias("job_id"), F.lit(chat).alias("channel_chat_id"), render(footer).alias("caption"))
        rows = written(rows.join(known.dropDuplicates(["job_id", "channel_chat_id"]), ["job_id", "channel_chat_id"], "left"))

        def attempt(rows: DataFrame, html: bool) -> DataFrame:
            keyed = rows.select("job_id", "channel_chat_id", "caption", F.lit(html).alias("html"), F.sha2(F.concat_ws("|", "job_id", "channel_chat_id", F.lit("html" if html else "plain")), 256).alias("key"))
            answers = deliver(keyed.select("key", "channel_chat_id", "caption", "html"))
            said = written(keyed.join(answers.select("key", F.col("message_id").cast("long").alias("message_id"), "error").dropDuplicates(["key"]), "key", "left"))
            said.select("key", "job_id", "channel_chat_id", "caption", "html", "message_id", "error", F.lit(now).cast("timestamp").alias("at")).write.mode("append").parquet(attempts_path)
            return said

        first = attempt(rows.where("message_id is null").drop("message_id", "sent"), True)
        refused = first.where(F.col("message_id").isNull() & F.contains(F.lower("error"), F.lit(MARKUP)))
        second = attempt(refused.withColumn("caption", strip_html(F.col("caption"))), False)
        done = [rows.where("message_id is not null").select("job_id", "channel_chat_id", "message_id", F.col("sent").alias("caption"))]
        done += [x.where("message_id is not null").select("job_id", "channel_chat_id", "message_id", "caption") for x in (first, second)]
        posts = done[0].unionByName(done[1]).unionByName(done[2])
        values = {
            "id": F.sha2(F.concat_ws("|", "job_id", "channel_chat_id"), 256), "telegram_message_id": F.col("message_id"), "banner_image_path": F.lit(banner).cast("string"),
            "published_at": F.lit(now).cast("timestamp"), "created_at": F.lit(now).cast("timestamp"),
        }
        names = [x.split()[0] for x in CHANNEL_POSTS.split(", ")]
        return posts.select(*(values[c].alias(c) if c in values else F.col(c) for c in names))

    return send


def run_publication(spark: SparkSession, jobs, posts_path: str, chat: str, n: int, send, checkpoint: str, errors_path: str, interval: str = "30 seconds"):
    """Start rounds of publication, one each ``interval``, as a stream whose clock is Spark's rate source and whose progress
    lies in the checkpoint; ``jobs`` is called for the current table in each round. What a round raises is recorded at
    ``errors_path`` (round, error, at), and the next one runs; its jobs are still ready then."""

    def one(_: DataFrame, number: int) -> None:
        now = spark.sql("SELECT current_timestamp() AS now").first().now
        try:
            with scratch_tables(spark):
                publish_round(spark, jobs(), posts_path, chat, n, send, now)
        except Exception as e:
            if "InterruptedException" in str(e):  # the stream is being stopped; the round is made again when it starts
                raise
            spark.createDataFrame([(number, f"{type(e).__name__}: {e}"[:1000], now)], ERRORS).write.mode("append").parquet(errors_path)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(one).start()
