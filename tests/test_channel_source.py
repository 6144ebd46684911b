"""Exports as a data source: whole, the newest alone, and as a stream that goes on where it stopped."""

import datetime as dt

from postmill.schemas import MESSAGE_WITH_ENTITIES
from postmill.sources import channel
from postmill.sources.channel import Pages, read_export, read_export_stream, write_export

NOW = dt.datetime(2026, 3, 1, 10)


def messages(spark, ids):
    rows = [(i, NOW if i % 2 else None, f"post {i} 😀\n" if i % 3 else None, f"u{i}", ["a", "b"] if i % 4 else None, i, None, "c", [("text_url", 1, 2, "x"), ("url", 0, None, None)] if i % 5 == 0 else None) for i in ids]
    return spark.createDataFrame(rows, MESSAGE_WITH_ENTITIES)


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_exports_are_read_by_pages(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/export"
    assert read_export(spark, path).collect() == []
    ids = [*range(0, 95, 2), *range(200, 230), 501]
    write_export(messages(spark, ids), path, 10)
    got = read_export(spark, path)
    assert got.rdd.getNumPartitions() == 14
    assert key(got.collect()) == key(messages(spark, ids).collect())
    opened = []
    real = Pages.messages
    monkeypatch.setattr(Pages, "messages", lambda self, number: opened.append(number) or real(self, number))
    newest = channel.ExportReader({"path": path, "newest": "33"})
    assert [p.number for p in newest.partitions()] == [50, 22, 21, 20, 9] and opened == [50, 22, 21, 20, 9]
    assert sorted(r.id for r in read_export(spark, path, 33).collect()) == sorted(ids)[-33:]
    assert len(read_export(spark, path, 1000).collect()) == len(ids) and read_export(spark, path, 0).collect() == []


def test_a_stream_goes_on_after_its_last_id(spark, tmp_path):
    path, out = f"file://{tmp_path}/export", str(tmp_path / "out")

    def run():
        stream = read_export_stream(spark, path, 10).writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").trigger(once=True).start(out)
        stream.awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    write_export(messages(spark, range(0, 25)), path, 10)
    assert run() == list(range(25))
    write_export(messages(spark, range(25, 61)), path, 10, mode="append")
    assert run() == list(range(61)) == run()
