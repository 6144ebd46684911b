"""Scans and sinks: channel exports as JSON lines, the raw-job topic, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MESSAGE, RAW_JOB, RAW_REQUIRED

TOPIC = "jobs.raw"


def read_messages(spark: SparkSession, path: str, schema: str = MESSAGE) -> DataFrame:
    """A channel export; the schema is fixed, nothing is inferred. MESSAGE_WITH_ENTITIES also reads the entities."""
    return spark.read.schema(schema).json(path)


def read_messages_stream(spark: SparkSession, path: str, files_per_trigger: int = 100, schema: str = MESSAGE) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def write_messages(messages: DataFrame, path: str) -> None:
    messages.write.mode("errorifexists").json(path)


def encode_raw(raw: DataFrame, key: str | None = TOPIC) -> DataFrame:
    """(key, value): one JSON object a row without null fields."""
    return raw.select(F.lit(key).cast("string").alias("key"), F.to_json(F.struct(*raw.columns)).alias("value"))


def decode_raw(value: Column) -> Column:
    """A raw job from JSON; null where it cannot be read or lacks a required field."""
    job = F.from_json(value.cast("string"), RAW_JOB, {"mode": "PERMISSIVE"})
    there = F.lit(True)
    for c in RAW_REQUIRED:
        there = there & job[c].isNotNull()
    return F.when(there, job)


def decoded(events: DataFrame) -> DataFrame:
    """The raw jobs of a topic's rows (value); undecodable ones are left out."""
    return events.select(decode_raw(F.col("value")).alias("job")).where("job is not null").select("job.*")


def undecodable(events: DataFrame) -> DataFrame:
    """The rows that ``decoded`` leaves out, for a dead-letter table."""
    return events.where(decode_raw(F.col("value")).isNull())


def kafka_options(servers: str, topic: str = TOPIC, starting: str = "earliest", group: str | None = None, poll_records: int | None = None) -> dict[str, str]:
    """Options of a topic source. ``group`` is the consumer group that brokers see (Spark keeps its own offsets in the
    checkpoint), ``poll_records`` the most records that a consumer fetches at a time."""
    more = {"kafka.group.id": group, "kafka.max.poll.records": poll_records and str(poll_records)}
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "false"} | {k: v for k, v in more.items() if v}


def sink_options(servers: str, topic: str = TOPIC) -> dict[str, str]:
    """Options of the topic sink: every replica acknowledges, and a producer's retries add nothing twice."""
    return {"kafka.bootstrap.servers": servers, "kafka.acks": "all", "kafka.enable.idempotence": "true", "topic": topic}


def read_topic(spark: SparkSession, servers: str, topic: str = TOPIC, starting: str = "earliest", most: int | None = None) -> DataFrame:
    """A batch scan of a topic; needs Spark's Kafka package on the class path."""
    df = spark.read.format("kafka").options(**kafka_options(servers, topic, starting)).load()
    return df.limit(most) if most else df


def read_topic_stream(spark: SparkSession, servers: str, topic: str = TOPIC, per_trigger: int = 100_000, group: str | None = None, poll_records: int | None = None) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, group=group, poll_records=poll_records)).option("maxOffsetsPerTrigger", per_trigger).load()


def run_decoding(events: DataFrame, sink, dead_path: str, checkpoint: str):
    """Start a stream of a topic's rows (value): decoded raw jobs go to ``sink`` (DataFrame, number of the batch), rows that
    cannot be decoded to ``dead_path`` under the same number, so that a batch that is run again writes them once."""

    def both(rows: DataFrame, number: int) -> None:
        undecodable(rows).write.mode("overwrite").json(f"{dead_path}/batch={number}")
        sink(decoded(rows), number)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(both).trigger(availableNow=True).start()


def write_topic(raw: DataFrame, servers: str, topic: str = TOPIC) -> None:
    encode_raw(raw).write.format("kafka").options(**sink_options(servers, topic)).save()
