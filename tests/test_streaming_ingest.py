"""Micro-batches under unique keys: all kinds of posts, outcomes, repeated and restarted batches, and what is read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import dedup
from postmill.operators.dedup import conflict_free_append, key_components
from postmill.operators.structured import parse_structured
from postmill.schemas import JOBS, RAW_JOB
from postmill.streaming.ingest import ingest_batch, outcomes, read_table, run_ingest_stream

NOW = dt.datetime(2026, 3, 1, 10)
LABELLED = "\n".join(["Lavozim: Kassir", "🏢 Ish joyi: XON BOZOR", "💰 Maosh: 3 mln", "📍 Manzil: Urganch", "Ish vaqti: 09:00 - 18:00", "Murojaat uchun: @xon_hr", "Tel: +998 97 666 44 22"])
NARRATIVE = "\n".join(["#ish", '"Nur" fabrikasi', "Jamoamizga qo'shilishni xohlaysizmi", "Oylik maoshlar razryadga qarab:", "2-razryad: 3 mln", "✓ Har oyda premiya", "Manzil: Xiva", "Tel: +998901112233"])
LISTED = "\n".join(["#ish", "Anor jamoasiga xodimlar ishga taklif qilinadi", "Bo'sh ish o'rinlari:", "• oshpaz", "• yordamchi", "Ish joyi: Anor", "Talablar:", "• Tajriba 3 yil", "Oylik: 3 mln", "Manzil: Xiva", "Mo'ljal: bozor", "Ish vaqti: 09:00 - 18:00", "Bog'lanish:", "@hr_onex", "Tel: +998901112244"])
FIELDS = "\n".join(["Lavozim: Sotuvchi", "Maosh: 4 mln", "Manzil: Gurlan", "Mo'ljal: bozor", "Ish vaqti: 08:00 - 17:00", "Talablar: tajriba", "Tel: +998901112255", "Murojaat: @shop_hr"])


def raw(spark, *posts):
    """(title, text, number) as raw jobs of xorazm_ish."""
    rows = [(title, None, text, None, None, "xorazm_ish", f"https://t.me/xorazm_ish/{n}", NOW + dt.timedelta(minutes=n), None) for title, text, n in posts]
    return spark.createDataFrame(rows, RAW_JOB)


POSTS = [("raw_post", LABELLED, 1), ("tikuvchi", NARRATIVE, 2), ("placeholder", LISTED, 3), ("raw_post", FIELDS, 4), ("raw_post", "salom", 5), ("raw_post", LABELLED, 6), ("raw_post", LABELLED, 1)]


def state(spark, path):
    jobs = sorted((r.source_url, r.title) for r in read_table(spark, path, JOBS).collect())
    said = sorted((int(r.url.split("/")[-1]), r.outcome, r.reason) for r in outcomes(spark, path).collect())
    return jobs, said


def test_all_kinds_of_posts_restarts_and_repeated_batches(spark, tmp_path):
    path = str(tmp_path / "jobs")
    folder = tmp_path / "in"
    raw(spark, *POSTS).coalesce(1).write.json(str(folder))
    stream = spark.readStream.schema(RAW_JOB).json(str(folder))
    run_ingest_stream(stream, path, str(tmp_path / "cp")).awaitTermination()
    jobs, said = state(spark, path)
    titles = {t for _, t in jobs}
    assert {"Kassir", "Tikuvchi", "Oshpaz", "Yordamchi", "Sotuvchi"} <= titles and len(jobs) == 5
    assert [x[:2] for x in said] == [(1, "Duplicate"), (1, "Inserted"), (2, "Inserted"), (3, "Inserted"), (4, "Inserted"), (5, "Invalid"), (6, "Duplicate")]
    assert [x[2] is not None for x in said] == [False] * 5 + [True, False]
    # a restart without news changes nothing; then news of which some are known, by the strict parser alone
    run_ingest_stream(stream, path, str(tmp_path / "cp")).awaitTermination()
    assert state(spark, path) == (jobs, said)
    news = raw(spark, ("raw_post", LABELLED, 9), ("raw_post", LABELLED.replace("Kassir", "Haydovchi"), 10), ("raw_post", LABELLED, 1), ("raw_post", NARRATIVE, 11))
    news.coalesce(1).write.mode("append").json(str(folder))
    run_ingest_stream(stream, path, str(tmp_path / "cp"), parse=parse_structured).awaitTermination()
    after, told = state(spark, path)
    assert set(after) - set(jobs) == {("https://t.me/xorazm_ish/10", "Haydovchi")}
    assert [x[:2] for x in told if x not in said or x[0] > 6] == [(9, "Duplicate"), (10, "Inserted"), (11, "Invalid")] and len(told) == len(said) + 4
    # the last batch once more, as after a failure between its writes
    ingest_batch(news, 1, path, parse=parse_structured)
    assert state(spark, path) == (after, told)


def test_a_refused_job_takes_no_key(spark, tmp_path):
    """Post 2 repeats the content of post 1 and is refused; its second version, with another content, is inserted."""
    path = str(tmp_path / "jobs")
    for n, posts in enumerate([[("raw_post", LABELLED, 1)], [("raw_post", LABELLED, 2)], [("raw_post", LABELLED.replace("Kassir", "Oshpaz"), 2)], [("raw_post", LABELLED, 2)]]):
        ingest_batch(raw(spark, *posts), n, path, parse=parse_structured)
    assert [(r.outcome, r.batch) for r in outcomes(spark, path).orderBy("batch").collect()] == [("Inserted", 0), ("Duplicate", 1), ("Inserted", 2), ("Duplicate", 3)]
    assert len(state(spark, path)[0]) == 2


def test_a_batch_reads_keys_and_not_the_table(spark, tmp_path, monkeypatch):
    from postmill.streaming import ingest

    path = str(tmp_path / "jobs")
    ingest_batch(raw(spark, *POSTS[:1]), 0, path, parse=parse_structured)
    read, plans = [], []
    real = ingest.read_table
    monkeypatch.setattr(ingest, "read_table", lambda s, p, schema: read.append(p) or real(s, p, schema))
    found = ingest.unseen

    def looked(jobs, row, keys_path, batch):
        out = found(jobs, row, keys_path, batch)
        plans.append(out._jdf.queryExecution().toString())
        return out

    monkeypatch.setattr(ingest, "unseen", looked)
    spark.conf.set("spark.sql.maxMetadataStringLength", "3000")
    ingest_batch(raw(spark, ("raw_post", LABELLED, 1)), 1, path, parse=parse_structured)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert read == [f"{path}_keys"]
    scan = next(x for x in plans[0].splitlines() if "FileScan" in x and "jobs_keys" in x)
    assert "PartitionFilters" in scan and "bucket" in scan and "ReadSchema: struct<key:binary>" in scan
    assert f"{path}/" not in plans[0].replace(f"{path}_keys", "")


def test_no_tables_are_left_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "scratch_dir", lambda s: f"file://{tmp_path}/scratch")
    ingest_batch(raw(spark, *POSTS), 0, str(tmp_path / "jobs"), parse=parse_structured)
    assert list((tmp_path / "scratch").iterdir()) == []
    assert read_table(spark, str(tmp_path / "jobs"), JOBS).count() == 1


def one_by_one(rows, keys):
    seen, out = [set() for _ in range(keys)], []
    for row in sorted(rows):
        if all(v is None or v not in s for v, s in zip(row[1:], seen, strict=True)):
            out.append(row[0])
            for v, s in zip(row[1:], seen, strict=True):
                s.add(v)
    return out


@pytest.mark.parametrize("most", [50_000, 5])
def test_a_long_chain_ends_in_few_rounds(spark, monkeypatch, most):
    """Row i shares one key with the row before and one with the next; a third key is free or null."""
    monkeypatch.setattr(dedup, "TOGETHER", most)
    written, real = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df: written.append(1) or real(df))
    n = 1000 if most > 5 else 24
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}", None if i % 3 else f"c{i}") for i in range(n)] + [(n + i, None, None, None) for i in range(3)]
    batch = spark.createDataFrame(rows, "id long, h string, s string, t string")
    got = sorted(r.id for r in conflict_free_append(batch, batch.where("false"), ["h", "s", "t"], ["id"]).collect())
    assert got == one_by_one(rows, 3)
    if most > 5:
        assert len(written) <= 70


def test_random_conflicts_and_components(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *range(60)]), rng.randrange(80)) for i in range(300)]
    batch = spark.createDataFrame(rows, "id long, h long, s long")
    assert sorted(r.id for r in conflict_free_append(batch, batch.where("false"), ["h", "s"], ["id"]).collect()) == one_by_one(rows, 2)
    parent = list(range(300))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for col in (1, 2):
        first = {}
        for row in rows:
            if row[col] is not None:
                parent[root(row[0])] = root(first.setdefault(row[col], row[0]))
    want = {}
    for i in range(300):
        want.setdefault(root(i), []).append(i)
    got = {}
    for r in key_components(batch.withColumn("_row", F.col("id")), ["h", "s"]).collect():
        got.setdefault(r._comp, []).append(r._row)
    assert sorted(map(sorted, got.values())) == sorted(want.values()) and all(min(v) == k for k, v in got.items())
