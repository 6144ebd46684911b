import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from postmill.functions import contacts, hashing, lines, text
from postmill.operators import caption, dedup, jobs, publication
from postmill.operators.structured import parse_structured
from postmill.schemas import CHANNEL_POSTS, JOBS, MESSAGE, RAW_JOB
from postmill.sources.messages import decoded, encode_raw, kafka_options, read_messages, undecodable, write_messages
from postmill.streaming.ingest import publish_round, read_table, run_ingest_stream

NOW = dt.datetime(2026, 3, 1, 10)


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.x for r in df.select("i", make(F.col("c")).alias("x")).orderBy("i").collect()]


def test_text_functions(spark):
    assert column(spark, [" A  B\t’x ", None], text.normalize_key) == ["a b 'x", None]
    assert column(spark, ["  iOS dasturchi", "🔥 sotuvchi", "123", "", "шофёр"], text.sentence_case) == ["IOS dasturchi", "🔥 Sotuvchi", "123", "", "Шофёр"]
    assert column(spark, ["🔥 Lavozim: Kassir ✅", "ish lavozimi - Oshpaz"], text.clean_title) == ["Kassir", "Oshpaz"]
    assert column(spark, ["• bir ✔", "1) ikki", "— uch"], text.clean_content_line) == ["bir", "ikki", "uch"]
    assert column(spark, ["«Lider»", '"A"b'], text.strip_wrapped_quotes) == ["Lider", 'A"b']
    assert column(spark, ["Mаош: 5 mln", "Maosh: 5"], text.repair_mixed_label) == ["Маош: 5 mln", "Maosh: 5"]
    assert column(spark, ['<b>a</b> &lt;x&gt; <a href="u">y</a> &amp;lt;'], text.strip_html) == ["a <x> y &lt;"]
    assert column(spark, ["a😀b"], text.utf16_length) == [4]
    assert column(spark, ["@chan", "-1001", "abc"], text.parse_chat_id) == [("@chan", None), (None, -1001), (None, None)]
    assert [int(x) for x in column(spark, [1, 500, 501], text.round_money, "int")] == [500, 500, 1000]


def test_contacts(spark):
    assert column(spark, ["tel +998 90 123-45-67, 998901234567 va 12345678; 12"], contacts.phones) == [["+998901234567", "12345678"]]
    assert column(spark, ["x (998) +998 90 123-45-67"], contacts.uzbek_phones) == [["+998901234567"]]
    assert column(spark, ["@hr_one a@b.uz @abc @HR_one"], lambda c: contacts.usernames(c, F.array(F.lit("own")))) == [["hr_one", "HR_one"]]
    assert column(spark, ["<t.me/abc>.", "https://x.uz/a).", "ftp://x", None], contacts.normalize_link) == ["https://t.me/abc>", "https://x.uz/a)", None, None]
    assert column(spark, ["see https://t.me/own/5 https://x.uz/q, t.me/own t.me/other"], lambda c: contacts.visible_links(c, F.array(F.lit("own")), F.lit("https://t.me/own/5"))) == [["https://x.uz/q", "https://t.me/other"]]


def test_lines(spark):
    assert column(spark, ["a\r\n\n b \n"], lines.split_lines) == [["a", "b"]]
    assert column(spark, [["a", "b", "a"]], lines.ordered_distinct, "array<string>") == [["a", "b"]]
    assert column(spark, [["x", "stop", "y"], ["x"]], lambda c: lines.take_until(c, lambda x: x == "stop"), "array<string>") == [["x"], ["x"]]
    assert column(spark, [["-", "a", "-", "b", "-"], ["-"], []], lambda c: lines.trim_edges(c, lambda x: x == "-"), "array<string>") == [["a", "-", "b"], [], []]
    assert column(spark, ["• a\nb"], lambda c: lines.merge_multiline(c, F.lit("b\nc"))) == ["a\nb\nc"]
    assert column(spark, [["A", "b", "c"]], lambda c: lines.subtract_lines(c, F.array(F.lit("a")), F.lower), "array<string>") == [["b", "c"]]


def raw(spark, *texts, source="xorazm_ish"):
    rows = [("raw_post", None, t, None, None, source, f"https://t.me/{source}/{i + 1}", NOW, ["https://forms.example/1"]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, RAW_JOB)


POST = "\n".join(["🔥 Ish!", "#vakansiya", "Lavozim: Kassir", "🏢 Ish joyi: “XON BOZOR”", "💰 Maosh: Suhbat asosida", "📍 Manzil: Urganch", "Mo‘ljal: bozor yonida", "Talablar:", "• 18 yosh", "• 18 yosh", "✅ halol", "Murojaat uchun: @xon_hr", "Tel: +998 97 666 44 22", "@xorazm_ish"])


def test_labelled_post_is_parsed(spark):
    r = parse_structured(raw(spark, POST)).first()
    assert (r.ok, r.reason, r.parsed_title, r.parsed_company, r.parsed_salary, r.parsed_location) == (True, None, "Kassir", "XON BOZOR", "Suhbat asosida", "Urganch (bozor yonida)")
    assert r.requirements == "18 yosh\nhalol" and r.contact_phone_numbers == ["+998976664422"] and r.contact_telegram_usernames == ["xon_hr"]
    assert r.found_links == ["https://forms.example/1"] and r.contact_text is None


INTRO = "Lider kompaniyasiga sotuvchi ishga taklif qilinadi\nМаош: 3 млн\nМанзил: Урганч\nИш вақти: 9-18\nТел: +998901112233"
REJECTED = [
    ("", "missing_structured_labels"), (None, "missing_structured_labels"), ("Kassir kerak\nMaosh: 5 mln", "missing_structured_labels"),
    (POST.replace("Kassir", "Kassir / Oshpaz"), "multiple_roles_detected"), (POST.replace("🏢 Ish joyi: “XON BOZOR”", "Grafik"), "missing_company"),
    (POST.replace("+998 97 666 44 22", "yozing"), "missing_phone"), (POST.replace("🔥 Ish!\n#vakansiya\nLavozim: Kassir\n", ""), "missing_title"),
    (POST.replace("Lavozim: Kassir", "Kassir\nOshpaz"), "multiple_roles_detected"),
]


def test_reject_codes_and_introductions(spark):
    """One call for all posts: a company from an introductory line with Cyrillic labels, and every code."""
    got = sorted(parse_structured(raw(spark, INTRO, *(post for post, _ in REJECTED))).collect(), key=lambda r: int(r.url.rpartition("/")[2]))
    first = got[0]
    assert (first.ok, first.parsed_company, first.parsed_title, first.parsed_salary) == (True, "Lider kompaniyasi", "sotuvchi", "3 млн")
    assert [(r.ok, r.reason, r.parsed_title) for r in got[1:]] == [(False, reason, None) for _, reason in REJECTED]


@pytest.fixture(scope="module")
def three(spark, tmp_path_factory):
    """The job rows of two different posts and of a copy of the first."""
    path = str(tmp_path_factory.mktemp("jobs") / "three")
    jobs.parsed_jobs(raw(spark, POST, POST.replace("Kassir", "oshpaz"), POST), F.lit(NOW)).write.parquet(path)
    return spark.read.parquet(path)


def one(three):
    return three.where("source_url like '%/1'")


def test_job_rows_hashes_and_append(spark, three):
    t = three
    assert [f.name for f in t.schema] == [x.split()[0] for x in JOBS.split(", ")]
    rows = {r.source_url[-1]: r for r in t.collect()}
    assert rows["2"].title == "Oshpaz" and rows["1"].dedup_hash == rows["3"].dedup_hash != rows["2"].dedup_hash
    assert len({r.source_post_hash for r in rows.values()}) == 3
    new = dedup.conflict_free_append(t, t.where("false"), ["id", "dedup_hash", "source_post_hash"], ["posted_at", "source_url"])
    assert sorted(r.source_url[-1] for r in new.collect()) == ["1", "2"]
    outcome = dedup.insert_outcomes(t, new, "source_url", "id").collect()
    assert sorted((r.source_url[-1], r.outcome) for r in outcome) == [("1", "Inserted"), ("2", "Inserted"), ("3", "Duplicate")]


def test_append_is_in_order_and_nulls_do_not_collide(spark):
    df = spark.createDataFrame([(1, "h1", "s1"), (2, "h1", "s2"), (3, "h3", "s2"), (4, None, None), (5, None, None), (6, "h9", "s9")], "n int, h string, s string")
    old = spark.createDataFrame([("h9", "x")], "h string, s string")
    assert sorted(r.n for r in dedup.conflict_free_append(df, old, ["h", "s"], ["n"]).collect()) == [1, 3, 4, 5]
    assert sorted(r.n for r in dedup.dedup_latest(df, ["h"], [F.desc("n")]).collect()) == [2, 3, 4, 5, 6]


@pytest.mark.parametrize(("name", "table", "row", "first", "second"), [
    ("on_conflict_insert", "orders", "o_orderkey", "o_custkey", "to_date(o_orderdate)"),
    ("on_conflict_insert_all", "events", "event_id", "concat_ws(':', user_id, event_type)", "concat_ws(':', floor(value * 10), event_type)"),
])
def test_insert_queries_equal_inserts_one_by_one(spark, name, table, row, first, second):
    from postmill.plans.queries import QUERIES

    firsts, seconds, want = set(), set(), []
    rows = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").selectExpr(f"{row} as id", f"{first} as a", f"{second} as b")
    for r in rows.orderBy("id").collect():
        if r.a not in firsts and r.b not in seconds:
            firsts.add(r.a)
            seconds.add(r.b)
            want.append((r.id, r.a, r.b))
    assert sorted(map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").collect())) == want


def test_chain_of_conflicts(spark):
    """Each row shares a key with the one before: every second one is inserted, one round for each."""
    df = spark.createDataFrame([(i, (i + 1) // 2 * 2, i // 2 * 2 + 1) for i in range(12)], "n int, h int, s int")
    assert sorted(r.n for r in dedup.conflict_free_append(df, df.where("false"), ["h", "s"], ["n"]).collect()) == list(range(0, 12, 2))


def test_publication(spark, three):
    j = three.where("source_url not like '%/3'")
    ids = {r.source_url[-1]: r.id for r in j.collect()}
    posts = spark.createDataFrame([("p1", ids["1"], "chat", 1, "c", None, NOW, NOW)], CHANNEL_POSTS)
    assert [r.id for r in publication.ready_for_publication(j, posts, "chat", 5).collect()] == [ids["2"]]
    assert publication.ready_for_publication(j, posts, "other", 1).count() == 1
    later = spark.createDataFrame([("p2", ids["2"], "chat", 2, "c", None, NOW, NOW), ("p3", ids["1"], "chat", 3, "c", None, NOW, NOW)], CHANNEL_POSTS)
    new_jobs, new_posts = publication.mark_published(j, posts, later)
    assert {r.id: r.telegram_published_at for r in new_jobs.collect()} == {ids["1"]: None, ids["2"]: NOW}
    assert sorted(r.id for r in new_posts.collect()) == ["p1", "p2"]
    assert publication.mark_published(new_jobs, new_posts, later)[1].count() == 2
    assert publication.find_by_id(j, ids["1"]).count() == 1


def test_caption(spark, three):
    t = one(three).withColumn("benefits", F.lit("Bepul ovqat\nrezyume yuboring")).withColumn("additional", F.lit("Maosh: 5\n3 mln som\nYotoqxona bor"))
    got = t.select(caption.render("chan").alias("c")).first().c
    assert got == "\n\n".join([
        "🔥 <b>Kassir</b>", "🏢 <b>Kompaniya:</b> XON BOZOR\n💸 <b>Maosh:</b> Suhbat asosida\n📍 <b>Manzil:</b> Urganch (bozor yonida)", "📋 <b>Talablar:</b>\n• 18 yosh\n• halol",
        "🎁 <b>Qulayliklar:</b>\n• Bepul ovqat", "✨ <b>Qo'shimcha:</b>\n• Yotoqxona bor", "💬 <b>Telegram:</b>\n• @xon_hr",
        '🔗 <b>Havolalar:</b>\n• <a href="https://forms.example/1">Murojaat 1</a>', "☎️ <b>Telefon:</b>\n• +998976664422", "@chan",
    ])


def test_caption_limit_skips_what_does_not_fit_and_goes_on(spark, three):
    t = one(three).withColumn("requirements", F.lit("\n".join(f"talab {i} " + "x" * 80 for i in range(20)))).withColumn("work_schedule", F.lit("y" * 2000))
    got = t.select(caption.render(None).alias("c"), F.lit(1)).first().c
    plain = got.replace("<b>", "").replace("</b>", "")
    assert "Ish vaqti" not in got and "talab 0" in got and "talab 19" not in got and len(plain.split('<a href')[0].encode("utf-16-le")) // 2 <= 1024


def test_schema_evolution_and_coverage(spark):
    old = spark.createDataFrame([("1", "t")], "id string, title string")
    new = jobs.add_missing_columns(old, JOBS).first()
    assert new.contact_links == [] and new.benefits is None
    empty = spark.createDataFrame([], "jobs array<struct<salary:string,location:string>>")
    assert jobs.coverage_report(empty).first().success_rate == 0.0


def test_registry(spark):
    r = jobs.Registry()
    r.register("b", "chan", "src_b")
    r.register("a", "chan", "src_a")
    r.register("c", "off", enabled=False)
    m = spark.createDataFrame([(1, NOW, " salom ", "u1", [" l ", "l", ""], 1, 1, "chan"), (2, NOW, " ", "u2", None, 1, 1, "chan"), (3, NOW, "x", "u3", None, 1, 1, "off")], MESSAGE)
    got = r.ingest(m).collect()
    assert [(x.title, x.description, x.source, x.contact_links) for x in got] == [("raw_post", "salom", "src_a", ["l"])]


def test_json_lines_and_topic(spark, tmp_path):
    m = spark.createDataFrame([(1, NOW, "a", "u", None, 1, 2, "c")], MESSAGE)
    write_messages(m, str(tmp_path / "m"))
    assert read_messages(spark, str(tmp_path / "m")).collect() == m.collect()
    events = encode_raw(raw(spark, "salom"))
    assert "company" not in json.loads(events.first().value)
    bad = spark.createDataFrame([("k", "{oops"), ("k", '{"title":"t"}')], "key string, value string")
    assert decoded(events.unionByName(bad)).count() == 1 and undecodable(events.unionByName(bad)).count() == 2
    assert kafka_options("h:1")["subscribe"] == "jobs.raw"


def test_streaming_ingest(spark, tmp_path):
    raw(spark, POST, POST).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(RAW_JOB).json(str(tmp_path / "in"))
    run_ingest_stream(stream, str(tmp_path / "jobs"), str(tmp_path / "cp")).awaitTermination()
    assert read_table(spark, str(tmp_path / "jobs"), JOBS).count() == 1


def test_rounds_of_publication(spark, three, tmp_path):
    def send(chosen, chat, now):
        return chosen.select(F.concat(F.lit("p"), "id").alias("id"), F.col("id").alias("job_id"), F.lit(chat).alias("channel_chat_id"), F.lit(1).cast("bigint").alias("telegram_message_id"), F.col("title").alias("caption"), F.lit(None).cast("string").alias("banner_image_path"), F.lit(now).alias("published_at"), F.lit(now).alias("created_at"))

    stored = three.where("source_url not like '%/3'")
    for _ in range(3):
        publish_round(spark, stored, str(tmp_path / "posts"), "chat", 1, send, NOW)
    assert read_table(spark, str(tmp_path / "posts"), CHANNEL_POSTS).count() == 2
