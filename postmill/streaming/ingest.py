"""The streaming forms: raw jobs into the jobs table under its unique keys, and publication in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import conflict_free_append, scratch_tables, written
from ..operators.jobs import parse_all, to_jobs
from ..operators.publication import new_posts, ready_for_publication, title_is_eligible
from ..schemas import CHANNEL_POSTS, JOBS, OUTCOMES

KEYS = ["id", "dedup_hash", "source_post_hash"]
#: Folders that the table of keys is dealt over.
BUCKETS = 64
KEY_TABLE = "key BINARY, batch BIGINT, bucket INT"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path; empty where nothing has been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def keys_of(jobs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, bucket) of each unique key of each job: 32 bytes that hold the kind and the value, and the folder they belong to."""
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KEYS))
    listed = jobs.select(*keep, F.explode(every).alias("x")).where("x.value is not null")
    keyed = listed.select(*keep, F.unhex(F.sha2(F.concat_ws(":", "x.kind", "x.value"), 256)).alias("key"))
    return keyed.withColumn("bucket", F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int") % BUCKETS)


def unseen(jobs: DataFrame, row: str, keys_path: str, batch: int) -> DataFrame:
    """The jobs that share no key with an earlier batch.

    The jobs table itself is not read: keys lie in a table of 32 bytes a key, dealt over BUCKETS folders by their first
    bytes. Only folders that the batch's keys fall into are scanned (their numbers, at most BUCKETS, come to the driver), and
    a folder's keys meet the batch's in a semi join, where the smaller side is broadcast if its size allows."""
    spark = jobs.sparkSession
    own = written(keys_of(jobs, (row,)))
    touched = [r.bucket for r in own.select("bucket").distinct().collect()]
    stored = read_table(spark, keys_path, KEY_TABLE).where((F.col("batch") != batch) & F.col("bucket").isin(touched))
    taken = own.join(stored.select("key"), "key", "left_semi").select(row).distinct()
    return jobs.join(taken, row, "left_anti")


def ingest_batch(raw: DataFrame, batch: int, path: str, created_at=None, parse=parse_all) -> DataFrame:
    """Parse a micro-batch by the cascade of all parsers and append the jobs that no key of the table has yet, in order of
    post, under batch=<number>; the outcome of each message (Inserted, Duplicate, or Invalid with its reason) goes to
    <path>_outcomes, the keys of what was inserted to <path>_keys, each under the same number.

    Inserts follow the order of posted_at, source_url and place in the batch, each free of the keys of all before it, also where
    a message makes several jobs. A built-in stream de-duplication would not do: a job that is refused for one key must
    not take its other key, so what a key's state is depends on the other key's.

    A batch that is run again after a failure overwrites its three folders and is held against the others' keys only, so
    the result is that of one run. The tables in between are deleted at the end."""
    spark = raw.sparkSession
    created_at = created_at if created_at is not None else F.current_timestamp()
    with scratch_tables(spark):
        rows = written(raw.withColumn("row_", F.monotonically_increasing_id()))
        parsed = written(parse(rows))
        jobs = written(to_jobs(parsed, created_at, keep=("row_",)).withColumn("job_", F.monotonically_increasing_id()))
        fresh = unseen(jobs, "job_", f"{path}_keys", batch)
        new = written(conflict_free_append(fresh, fresh.where("false"), KEYS, ["posted_at", "source_url", "row_", "job_"]))
        new.drop("row_", "job_").write.mode("overwrite").parquet(f"{path}/batch={batch}")
        stored = keys_of(new).repartition("bucket").sortWithinPartitions("bucket", "key")
        stored.write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{path}_keys/batch={batch}")
        said = parsed.groupBy("row_").agg(F.max("ok").alias("ok"), F.min("reason").alias("reason"))
        said = rows.select("row_", "source", "url", "posted_at").join(said, "row_", "left").join(new.select("row_").distinct().withColumn("in_", F.lit(True)), "row_", "left")
        outcome = F.when(F.col("in_"), "Inserted").when(F.col("ok"), "Duplicate").otherwise("Invalid")
        told = said.select("source", "url", "posted_at", outcome.alias("outcome"), F.when(F.coalesce(F.col("ok"), F.lit(False)), None).otherwise(F.col("reason")).alias("reason"))
        told.write.mode("overwrite").parquet(f"{path}_outcomes/batch={batch}")
    return spark.read.schema(JOBS).parquet(f"{path}/batch={batch}")


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(source, url, posted_at, outcome, reason, batch) of all messages that the jobs table at ``path`` was offered."""
    return read_table(spark, f"{path}_outcomes", f"{OUTCOMES}, batch BIGINT")


def run_ingest_stream(raw_stream: DataFrame, path: str, checkpoint: str, once: bool = True, parse=parse_all):
    """Start the stream; at-least-once delivery and a sink that may repeat a batch give each job once."""
    writer = raw_stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: ingest_batch(df, n, path, parse=parse) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def publish_round(spark: SparkSession, jobs: DataFrame, posts_path: str, chat: str, n: int, send, now) -> DataFrame:
    """One round of publication: the n oldest jobs that are ready go to ``send`` (DataFrame -> DataFrame of posts).

    The chosen jobs and what was sent are written first, so each job is sent by one action; what is returned is read back.
    A task that is lost while it sends is run again: ``send`` should pass the job's id on as a key of its delivery."""
    posts = read_table(spark, posts_path, CHANNEL_POSTS)
    chosen = written(ready_for_publication(jobs, posts, chat, n).where(title_is_eligible(F.col("title"))))
    added = written(new_posts(posts, written(send(chosen, chat, now))))
    added.write.mode("append").parquet(posts_path)
    return added
