"""Registrations from files, one routing pass for all rules, and broken rules that cost only their own messages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postmill.functions.contacts import entity_links, message_links
from postmill.operators.channel_posts import vacancies
from postmill.operators.jobs import Registry, raw_passthrough
from postmill.operators.listing_posts import notices
from postmill.operators.registry import outcomes_table, read_registrations
from postmill.schemas import MESSAGE, MESSAGE_WITH_ENTITIES
from postmill.sources.messages import read_messages, write_messages

NOW = dt.datetime(2026, 3, 1, 10)


def write(folder, name, text):
    (folder / name).mkdir()
    (folder / name / "config.yaml").write_text(text, encoding="utf-8")


def test_registrations_are_read_from_files(spark, tmp_path):
    assert read_registrations(spark, str(tmp_path)).collect() == []
    write(tmp_path, "only_config", "channel: config_only_channel\nsource: config_only_source\nenabled: true\n")
    write(tmp_path, "quoted", "# a comment\nchannel: \"@chan\"  # the channel\r\nenabled: No\r\n")
    write(tmp_path, "no_source", "channel: 'plain'\nrule: postmill.operators.jobs:raw_passthrough")
    write(tmp_path, "broken_rule", "channel: other\nrule: postmill.operators.nothing:here\n")
    write(tmp_path, "broken_file", "source: x\n")
    write(tmp_path, "second", "channel: plain\nsource: late\n")
    write(tmp_path, "third", "channel: other\nsource: third\n")
    write(tmp_path, "__hidden", "channel: hidden\n")
    (tmp_path / "without").mkdir()
    (tmp_path / "file.txt").write_text("x")
    rows = {r.plugin_name: tuple(r)[1:] for r in read_registrations(spark, str(tmp_path)).collect()}
    assert rows["only_config"] == ("config_only_channel", "config_only_source", True, None)
    assert rows["quoted"] == ("@chan", "@chan", False, None) and rows["no_source"][:3] == ("plain", "plain", True)
    assert rows["broken_file"] == (None, "x", True, None) and "__hidden" not in rows
    r = Registry.discovered(spark, str(tmp_path), {"third": raw_passthrough})
    assert {x.plugin_name: x.outcome for x in outcomes_table(spark, r).collect()} == {
        "only_config": "loaded", "quoted": "disabled", "no_source": "loaded", "broken_rule": "broken", "broken_file": "broken", "second": "duplicate channel", "third": "loaded",
    }
    assert sorted(tuple(x)[:3] for x in r.table(spark).collect()) == [("no_source", "plain", "plain"), ("only_config", "config_only_channel", "config_only_source"), ("third", "other", "third")]
    assert set(r.rules) == {"plain", "third"}
    with pytest.raises(FileNotFoundError):
        read_registrations(spark, str(tmp_path / "nowhere"))


def many(spark, n=400, channels=5):
    rows = [(i, NOW, f"post {i}", f"https://t.me/c{i % channels}/{i}", None, 1, 1, f"c{i % channels}") for i in range(n)]
    return spark.createDataFrame(rows, MESSAGE)


def test_all_rules_read_the_messages_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    messages = many(spark).mapInArrow(counting, MESSAGE)
    r = Registry()
    for i in range(5):
        r.register(f"p{i}", f"c{i}", f"s{i}", (lambda i: lambda df: raw_passthrough(df).withColumn("title", F.lit(f"by {i}")))(i) if i else None)
    raw, dead = r.dispatch(messages)
    assert sorted((x.title, x.n) for x in raw.groupBy("title").agg(F.count("*").alias("n")).collect()) == [("by 1", 80), ("by 2", 80), ("by 3", 80), ("by 4", 80), ("raw_post", 80)]
    assert dead.count() == 0 and read.value == 400


def test_a_rule_that_raises_costs_its_own_messages(spark):
    def broken(df):
        raise RuntimeError("no such rule\nat all")

    def picky(df):
        bad = F.raise_error(F.lit("bad message")).cast("string")
        return raw_passthrough(df).withColumn("title", F.when(F.col("description") == "post 7", bad).otherwise(F.lit("picked")))

    r = Registry()
    r.register("a", "c0", "s0", broken)
    r.register("b", "c2", "s2", picky)
    r.register("c", "c1", "s1", raw_passthrough)
    raw, dead = r.dispatch(many(spark))
    raw, dead = raw.collect(), dead.collect()
    gone = {(x.plugin_name, x.id) for x in dead}
    assert {i for p, i in gone if p == "a"} == set(range(0, 400, 5)) and {x.error for x in dead if x.plugin_name == "a"} == {"RuntimeError: no such rule"}
    lost = {i for p, i in gone if p == "b"}
    assert 7 in lost and len(lost) <= 3 and not [x for x in gone if x[0] == "c"]
    kept = sorted(int(x.description.split()[1]) for x in raw)
    assert kept == sorted(set(range(1, 400, 5)) | (set(range(2, 400, 5)) - lost))


def entity(kind, offset, length, url=None):
    return (kind, offset, length, url)


def test_links_of_entities(spark, tmp_path):
    text = "\n   😀👍🏽 Ariza https://a.example/form1 yoki anketa t.me/chan \n"
    at = text.strip().index("https")
    marks = [entity("text_url", 2, 5, "https://forms.gle/example"), entity("url", at, len("https://a.example/form")), entity("text_url", 0, 4, "https://t.me/Xorazm_ish"), entity("bold", 0, 3, "https://no.example"), entity("url", -5, 2), entity("url", 500, 9), entity("text_url", 0, 1, None), entity("text_url", None, None, "t.me/+abc.")]
    rows = [(1, NOW, text, "https://t.me/xorazm_ish/1", ["https://exported.example/1"], 1, 1, "@xorazm_ish", marks), (2, NOW, None, None, None, 1, 1, "c", None), (3, NOW, "x", None, None, 1, 1, "c", [])]
    write_messages(spark.createDataFrame(rows, MESSAGE_WITH_ENTITIES), str(tmp_path / "m"))
    df = read_messages(spark, str(tmp_path / "m"), MESSAGE_WITH_ENTITIES)
    got = {r.id: r for r in df.select("id", entity_links(F.col("text"), F.col("entities")).alias("e"), message_links(F.col("contact_links"), F.col("text"), F.array("channel", F.lit("chan")), F.col("url"), F.col("entities")).alias("x")).collect()}
    assert got[1].e == ["https://forms.gle/example", "https://a.example/form", "https://t.me/Xorazm_ish", "😀👍", "t.me/+abc."]
    assert got[1].x == ["https://exported.example/1", "https://forms.gle/example", "https://a.example/form", "https://t.me/+abc", "https://a.example/form1"]
    assert got[2].e == got[2].x == got[3].e == got[3].x == []


def test_rules_keep_hidden_links(spark):
    one = "\n#ish\nTest kompaniyasiga operator ishga taklif qilinadi.\nAriza topshirish:\n👤 Onlayn anketa\n"
    two = "\nXususiy firmaga, quyidagi lavozimlar bo'yicha ishga taklif qilamiz !!!\n\n📲 Savdo bo'limi operatori\n📝 Xo'jalik bo'limi xodimi\n\nAnketa to'ldirish\n"
    hidden = [entity("text_url", 3, 5, "https://forms.gle/example"), entity("text_url", 0, 4, "https://t.me/Xorazm_ish")]
    rows = [(1, NOW, one, "https://t.me/xorazm_ish/1", None, 1, 1, "@xorazm_ish", hidden), (2, NOW, two, "https://t.me/bor/2", None, 1, 1, "bor", hidden[:1]), (3, NOW, "salom", "https://t.me/raw/3", None, 1, 1, "raw", hidden[:1])]
    r = Registry()
    r.register("a", "@xorazm_ish", "xorazm_ish", vacancies)
    r.register("b", "bor", "bor", notices)
    r.register("c", "raw", "raw")
    got = {x.source: x for x in r.ingest(spark.createDataFrame(rows, MESSAGE_WITH_ENTITIES)).collect()}
    assert got["xorazm_ish"].contact_links == ["https://forms.gle/example"]
    assert (got["bor"].title, got["bor"].contact_links) == ("Savdo bo'limi operatori / Xo'jalik bo'limi xodimi", ["https://forms.gle/example"])
    assert (got["raw"].title, got["raw"].contact_links) == ("raw_post", ["https://forms.gle/example"])
