"""Signs of all kinds around the words of channel posts: joined emoji, marks and dashes that no list names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postmill.operators.listing_posts import CITIES, bare, heading_of, notices, title_of
from postmill.schemas import MESSAGE

NOW = dt.datetime(2026, 3, 1, 10)
JOINED = ["💁🏻‍♂", "💁🏻‍♂️", "👩‍👩‍👧", "👨🏻‍💻", "❤️‍🔥", "🏳️‍🌈", "✍🏽"]


def run(spark, city, *texts):
    rows = [(i, NOW, t, f"https://t.me/chan/{i}", ["https://t.me/+hm6Ihq9d7okxNTZi", "https://forms.example/a"], 1, 1, "chan") for i, t in enumerate(texts)]
    messages = spark.createDataFrame(rows, MESSAGE).withColumn("source", F.lit("chan"))
    return {int(r.url.split("/")[-1]): r for r in notices(messages, city).collect()}


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.x for r in df.select("i", make(F.col("c")).alias("x")).orderBy("i").collect()]


def test_words_behind_and_before_signs(spark):
    assert column(spark, [f"{x} Kassir" for x in [*JOINED, "–", "⚡", "_*", "🍔🍟", "·•"]], bare) == ["Kassir"] * (len(JOINED) + 5)
    assert column(spark, [f"Savdo bo'limi menedjeri {x}" for x in JOINED], title_of) == ["Savdo bo'limi menedjeri"] * len(JOINED)
    assert column(spark, [f"Ombor mudiri {x}" for x in JOINED], heading_of) == ["Ombor mudiri"] * len(JOINED)


@pytest.fixture(scope="module")
def listed(spark):
    """A list of roles below a heading with each joined emoji, each role with one behind it."""
    return run(spark, None, *(f"TEMIR PROFIL\nTEMIR oyna savdo offisiga ishga taklif qilamiz ✅\n\n{x} Bo'sh ish o'rinlari ⬇\n1. Sotuvchi menejer {x}\n2. Skladga ( Ombor mudiri ) {x}\n\n💰 Oylik kelishuv asosida:\n2 500 000 dan\n\n📍 Manzil: Urganch shahar\nMo'ljal: bozor" for x in JOINED))


def test_lists_with_joined_emoji(listed):
    assert {(r.title, r.company, r.location, r.salary) for r in listed.values()} == {("Sotuvchi menejer / Sklad ( Ombor mudiri )", "TEMIR oyna savdo offisi", "Urganch shahar (bozor)", "kelishuv asosida; 2 500 000 dan")}
    assert len(listed) == len(JOINED)


def test_city_channels_take_all_signs_from_the_front(spark):
    trade = "\n".join([
        "⚡️ NUR Trading kompaniyasiga call-markaz operatori kerak", "💵 Maosh: 8.000.000 - 20.000.000", "📍 Hudud: Toshkent", "📣 Ish haqida:", "– NUR Trading kompaniyasiga call-markaz operatori kerak", "⏰ Ish vaqti:", "– 09:00 dan 20:00 gacha",
        "📌 Manzil:", "– Toshkent shahar, Chilonzor tumani", "☎️ Bog‘lanish:", "– +998901234567", "👍 ASOSIY KANAL 1MLN 👈",
    ])
    got = run(spark, CITIES["ishchi_bor_kerak_toshkent"], trade)[0]
    assert (got.title, got.company, got.location, got.salary) == ("call-markaz operatori", "NUR Trading kompaniyasi", "Toshkent shahar, Chilonzor tumani", "8.000.000 - 20.000.000")
    assert got.contact_links == ["https://forms.example/a"]
    food = "\n".join(["🍔Tez.Eda kompaniyasi kuryerlarni ishga taklif qiladi!", "🚀 Erkin ish jadvali, yuqori daromad va kunlik to‘lov!", "📢 Bo‘sh ish o‘rni: Kuryer", "📊 Yosh: 18+", "💵 Daromad: 5 000 000 – 15 000 000 so‘mgacha", "✅ To‘lov: Kunlik!", "📍 Qulay hududni o‘zingiz belgilaysiz!"])
    free = "Ko'chada savdo qilish\nIsh vaqti 12 soat\nIsh haqqi haftalik yoki kunlik\nAdres chilonzor shuhrat\n+998932985566"
    got = run(spark, CITIES["ishbor_toshkent_kerak_ishchi_bor"], food, free)
    assert (got[0].title, got[0].company, got[0].salary, got[0].location) == ("Kuryer", "Tez.Eda kompaniyasi", "5 000 000 – 15 000 000 so'mgacha", "Qulay hududni o'zingiz belgilaysiz")
    assert (got[1].title, got[1].location) == ("Ko'chada savdo qilish", "chilonzor shuhrat")
