"""Clustered tables that are read in part, decoding with all faults, resent captions, rounds by the clock, topic options."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.decoding import decode_accumulating
from postmill.operators.publication import find_by_id, new_posts, ready_for_publication
from postmill.schemas import ATTEMPTS, CHANNEL_POSTS, JOBS, RAW_JOB
from postmill.sources.messages import encode_raw, kafka_options, run_decoding, sink_options
from postmill.sources.tables import by_location, ready_from_clustered, write_clustered
from postmill.streaming.ingest import read_table
from postmill.streaming.publish import ERRORS, resending, run_publication

NOW = dt.datetime(2026, 3, 1, 10)


def jobs(spark, n):
    values = {
        "id": F.sha2(F.col("i").cast("string"), 256), "title": F.concat(F.lit("Job & <co> "), F.col("i").cast("string")), "company": F.lit("Nur"), "description": F.lit("x" * 50), "source": F.lit("s"),
        "location": F.concat(F.lit("place "), (F.col("i") % 50).cast("string")), "source_url": F.concat(F.lit("u/"), F.col("i").cast("string")), "posted_at": F.timestamp_seconds(F.lit(1704067200) + (F.col("i") * 7919) % 100_000 * 60),
        "created_at": F.lit(NOW), "dedup_hash": F.sha2(F.concat(F.lit("d"), F.col("i").cast("string")), 256), "source_post_hash": F.sha2(F.concat(F.lit("p"), F.col("i").cast("string")), 256),
    }
    fields = T._parse_datatype_string(JOBS)
    return spark.range(n).withColumnRenamed("id", "i").select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def test_posts_that_repeat_in_all_columns_are_added_once(spark):
    at = lambda d: dt.datetime(2026, 3, d)
    schema = "id string, job_id long, channel_chat_id string, published_at timestamp"
    rows = [("1-2", 1, "R", at(2)), ("1-2", 1, "R", at(2)), ("1-3", 1, "R", at(2)), ("1-1", 1, "R", None), ("2-2", 2, "R", at(1)), ("3-2", None, "R", at(1)), ("4-2", 4, "A", None), ("4-2", 4, "A", None)]
    posts = spark.createDataFrame([("2-1", 2, "R", at(3)), ("9-1", None, "R", at(1))], schema)
    added = new_posts(posts, spark.createDataFrame(rows, schema)).collect()
    assert sorted(added, key=lambda r: r.id) == [rows[0], rows[5], rows[6]]


def scanned(df):
    """(rows, files) that the file scans of a query read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    found = [leaves.apply(i).metrics() for i in range(leaves.size())]
    value = lambda name: sum(m.apply(name).value() for m in found if m.contains(name))
    return value("numOutputRows"), value("numFiles")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table") / "jobs")
    write_clustered(jobs(spark, 20_000), path, files=5, row_group_bytes=64 << 10)
    return spark.read.schema(JOBS).parquet(path)


def test_reads_skip_row_groups(spark, table, monkeypatch):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        key = jobs(spark, 20_000).where("source_url = 'u/777'").first().id
        one = find_by_id(table, key)
        assert one.first().source_url == "u/777" and scanned(one)[0] < 5000
        assert find_by_id(table, "nobody").collect() == []
        place = by_location(table, "place 7")
        assert place.count() == 400 and scanned(place)[0] < 10_000
        since, until = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)
        part = by_location(table, "place 7", since, until)
        want = {r.id for r in jobs(spark, 20_000).where((F.col("location") == "place 7") & (F.col("posted_at") >= since) & (F.col("posted_at") < until)).collect()}
        assert {r.id for r in part.collect()} == want and want and scanned(part)[0] < 2500
        had = [r.id for r in table.orderBy("posted_at", "created_at", "id").limit(3).collect()]
        posts = spark.createDataFrame([(x, "chat") for x in had[:2]] + [(had[2], "other")], "job_id string, channel_chat_id string")
        got = ready_from_clustered(table, posts, "chat", 10)
        assert got.collect() == ready_for_publication(table, posts, "chat", 10).collect() and scanned(got)[0] < 10_000
        assert ready_from_clustered(table.where("false"), posts, "chat", 10).collect() == []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_clustered_tables_hold_nulls(spark, tmp_path):
    odd = jobs(spark, 5).withColumns({"posted_at": F.when(F.col("source_url") != "u/1", F.col("posted_at")), "location": F.when(F.col("source_url") != "u/2", F.col("location"))})
    write_clustered(odd, str(tmp_path / "t"))
    back = spark.read.schema(JOBS).parquet(str(tmp_path / "t"))
    assert sorted(map(str, back.collect())) == sorted(map(str, odd.collect()))
    posts = spark.createDataFrame([], CHANNEL_POSTS)
    assert [r.source_url for r in ready_from_clustered(back, posts, "c", 2).collect()] == [r.source_url for r in ready_for_publication(back, posts, "c", 2).collect()]


def test_all_faults_of_all_fields(spark):
    schema = T._parse_datatype_string("title STRING, n BIGINT, share DOUBLE, at TIMESTAMP, ok BOOLEAN, links ARRAY<STRING>")
    fine = {"title": "a", "n": 5, "share": 1, "at": "2024-01-02T03:04:05Z", "ok": True, "links": ["x"], "extra": [1]}
    texts = [
        json.dumps(fine), json.dumps({"title": "a", "n": 1}), json.dumps({"title": None, "n": "5", "share": "x", "at": "never", "ok": 1, "links": [1]}), json.dumps({"n": 1.5, "links": "x", "at": 5, "share": 2.5}),
        "oops", "[1]", "5", "null", None, "", json.dumps({"title": "", "n": 10**30}), json.dumps({"title": "t", "n": 2, "links": []}), json.dumps({"title": {"x": 1}, "n": None, "ok": None}), "{" * 50,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", decode_accumulating(F.col("t"), schema, ("title", "n")).alias("x"))
    got = {r.i: r.x for r in df.collect()}
    faults = {i: [tuple(p) for p in x.problems] for i, x in got.items()}
    assert faults[0] == [] and (got[0].value.title, got[0].value.n, got[0].value.share, got[0].value.ok, got[0].value.links) == ("a", 5, 1.0, True, ["x"]) and got[0].value.at == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert faults[1] == [] and got[1].value.links is None
    assert faults[2] == [("title", "null"), ("n", "expected bigint"), ("share", "expected double"), ("at", "expected timestamp"), ("ok", "expected boolean"), ("links", "expected array<string>")] and got[2].value is None
    assert faults[3] == [("title", "missing"), ("n", "expected bigint"), ("at", "expected timestamp"), ("links", "expected array<string>")]
    for i in (4, 5, 6, 7, 8, 9, 13):
        assert faults[i] == [("", "no JSON object")]
    assert faults[10] == [("n", "expected bigint")] and faults[11] == [] and got[11].value.links == []
    assert faults[12] == [("title", "expected string"), ("n", "null")]


class Receiver:
    """A chat that refuses markup in some captions, fails for some, and knows a delivery by its key. Its state is a folder of files."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, rows):
        folder = self.folder

        def run(batches):
            import os
            import zlib

            import pyarrow as pa

            for batch in batches:
                out = []
                for key, caption, html in zip(*(batch.column(x).to_pylist() for x in ("key", "caption", "html")), strict=True):
                    with open(f"{folder}/calls", "a") as f:
                        f.write(f"{key}\n")
                    n = int(caption.split("<co>" if not html else "&lt;co&gt;")[1].split()[0].split("<")[0])
                    if n % 3 == 0 and html:
                        out.append((key, None, "Bad Request: Can't parse entities: unsupported tag"))
                    elif n % 5 == 4:
                        out.append((key, None, "Too Many Requests"))
                    else:
                        with open(f"{folder}/shown-{key}", "w") as f:
                            f.write(caption)
                        out.append((key, zlib.crc32(key.encode()), None))
                assert os.path.isdir(folder)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], names=["key", "message_id", "error"])

        return rows.mapInArrow(run, "key string, message_id long, error string")


def test_refused_captions_are_sent_again_as_plain_text(spark, tmp_path):
    folder = tmp_path / "chat"
    folder.mkdir()
    send = resending(Receiver(folder), str(tmp_path / "attempts"), "footer")
    chosen = jobs(spark, 10)
    posts = send(chosen, "chat", NOW)
    assert [f.name for f in posts.schema] == [x.split()[0] for x in CHANNEL_POSTS.split(", ")]
    numbers = {r.id: int(r.source_url[2:]) for r in chosen.collect()}
    sent = {numbers[r.job_id]: r for r in posts.collect()}
    assert set(sent) == {0, 1, 2, 3, 5, 6, 7, 8}
    assert all(("<b>" in r.caption) == (n % 3 != 0) and ("&lt;co&gt;" in r.caption) == (n % 3 != 0) for n, r in sent.items())
    tried = read_table(spark, str(tmp_path / "attempts"), ATTEMPTS).collect()
    assert len(tried) == 14 and sum(not r.html for r in tried) == 4 and sum(r.message_id is None for r in tried) == 6
    # the same task once more: what was delivered is not sent again, what was not gets another attempt
    before = len((folder / "calls").read_text().splitlines())
    again = {numbers[r.job_id]: r for r in send(chosen, "chat", NOW).collect()}
    assert {n: (r.id, r.telegram_message_id, r.caption) for n, r in again.items()} == {n: (r.id, r.telegram_message_id, r.caption) for n, r in sent.items()}
    assert len((folder / "calls").read_text().splitlines()) - before == 3
    assert len([x for x in folder.iterdir() if x.name.startswith("shown")]) == 8


def test_rounds_go_on_after_one_that_fails(spark, tmp_path):
    calls = []

    def send(chosen, chat, now):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("no answer")
        return chosen.select(F.concat(F.lit("p"), "id").alias("id"), F.col("id").alias("job_id"), F.lit(chat).alias("channel_chat_id"), F.lit(1).cast("bigint").alias("telegram_message_id"), F.col("title").alias("caption"), F.lit(None).cast("string").alias("banner_image_path"), F.lit(now).alias("published_at"), F.lit(now).alias("created_at"))

    table = jobs(spark, 10)
    stream = run_publication(spark, lambda: table, str(tmp_path / "posts"), "chat", 2, send, str(tmp_path / "cp"), str(tmp_path / "errors"), "1 second")
    until = time.time() + 90
    while read_table(spark, str(tmp_path / "posts"), CHANNEL_POSTS).count() < 4 and time.time() < until:
        time.sleep(0.5)
    stream.stop()
    posts, errors = read_table(spark, str(tmp_path / "posts"), CHANNEL_POSTS), read_table(spark, str(tmp_path / "errors"), ERRORS).collect()
    assert len(calls) >= 3 and [r.error for r in errors] == ["RuntimeError: no answer"]
    done = [r.job_id for r in posts.orderBy("published_at").collect()]
    oldest = [r.id for r in table.orderBy("posted_at", "created_at", "id").limit(len(done)).collect()]
    assert len(done) >= 4 and sorted(done) == sorted(oldest)


def test_topic_options_and_dead_letters(spark, tmp_path):
    assert kafka_options("h:1,h:2", "t", "latest", "raw-event-listener", 100) == {
        "kafka.bootstrap.servers": "h:1,h:2", "subscribe": "t", "startingOffsets": "latest", "failOnDataLoss": "false", "kafka.group.id": "raw-event-listener", "kafka.max.poll.records": "100",
    }
    assert set(kafka_options("h:1")) == {"kafka.bootstrap.servers", "subscribe", "startingOffsets", "failOnDataLoss"}
    assert sink_options("h:1", "t") == {"kafka.bootstrap.servers": "h:1", "kafka.acks": "all", "kafka.enable.idempotence": "true", "topic": "t"}
    raw = spark.createDataFrame([("t", None, "text", None, None, "s", f"u{i}", NOW, None) for i in range(3)], RAW_JOB)
    events = encode_raw(raw).unionByName(spark.createDataFrame([("jobs.raw", "{oops"), ("jobs.raw", '{"title":"t"}'), ("jobs.raw", None)], "key string, value string"))
    events.coalesce(1).write.json(str(tmp_path / "topic"))
    stream = spark.readStream.schema("key string, value string").json(str(tmp_path / "topic"))
    for _ in range(2):
        run_decoding(stream, lambda df, n: df.write.mode("overwrite").json(f"{tmp_path}/good/batch={n}"), f"{tmp_path}/dead", str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.url for r in spark.read.schema(RAW_JOB).json(f"{tmp_path}/good").collect()) == ["u0", "u1", "u2"]
    assert spark.read.schema("key string, value string").json(f"{tmp_path}/dead").count() == 3
