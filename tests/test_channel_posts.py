"""Messages of a channel to raw jobs."""

import datetime as dt

from pyspark.sql import functions as F

from postmill.functions.contacts import message_links
from postmill.operators.channel_posts import vacancies
from postmill.operators.jobs import Registry
from postmill.schemas import MESSAGE

NOW = dt.datetime(2026, 3, 1, 10)
ONE = "#ish\n«Bahor» kafesiga oshpaz ishga taklif qilinadi!\nTalablar:\n• Tajriba\nOylik: 5 mln.\nManzil: Urganch.\nMo'ljal: bozor\nTel: +998901112233"
LIST = "\n".join(["#ish", "Nur firmasiga quyidagi lavozimlarga ishga taklif qilinadi", "Sotuvchi", "Talablar:", "Faqat ayollar", "Oylik 3 mln", "Kassir", "Talablar:", "Halol", "Oylik 4 mln", "Manzil: Xiva", "Tel: +998901112233", "@xorazm_ish"])
RUN = "#ish\nVodiy filialiga xodimlar kerak\n• Haydovchi\n• Oshpaz\n• Farrosh\n• Qorovul\n• Bog'bon\nTel: +998901112233\nMaosh suhbat asosida"


def messages(spark, *texts):
    rows = [(i, NOW, t, f"https://t.me/xorazm_ish/{i}", ["https://forms.example/a.", "t.me/s/Xorazm_ish", f"https://t.me/xorazm_ish/{i}"], 1, 1, "@xorazm_ish") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, MESSAGE)


def test_messages_become_jobs(spark):
    texts = [ONE, LIST, RUN, None, "", "salom", "#reklama\n" + ONE, ONE + "\nishchi topganini ma'lum qildi", "Магазин приглашает на работу на должность\n• Продавец\nАдрес: Ургенч", "Mahoratli usta kerak\nOylik 5 mln", "Nur jamoasi kengayishi munosabati bilan oshpaz kerak\nMaosh 5", "Usta kerak"]
    r = Registry()
    r.register("xorazm", "@xorazm_ish", "xorazm_ish", vacancies)
    got = {x.url.split("/")[-1]: x for x in r.ingest(messages(spark, *texts)).collect()}
    assert set(got) == {"0", "1#role-1", "1#role-2", "2", "8", "9", "10"}
    one = got["0"]
    assert (one.title, one.company, one.location, one.salary) == ("oshpaz", "Bahor", "Urganch (bozor)", "5 mln")
    assert one.description == ONE and one.contact_links == ["https://forms.example/a"] and one.posted_at == NOW
    first, second = got["1#role-1"], got["1#role-2"]
    assert (first.title, second.title, first.company) == ("Sotuvchi", "Kassir", "Nur firmasi")
    assert (first.salary, second.salary, first.location) == ("3 mln", "4 mln", "Xiva")
    assert first.description.split("\n")[1:] == LIST.split("\n")[1:6] + LIST.split("\n")[10:12]
    assert second.description.split("\n") == LIST.split("\n")[:2] + LIST.split("\n")[6:]
    assert got["2"].title == "Haydovchi / Oshpaz / Farrosh / Qorovul +1" and got["2"].location == "Vodiy" and got["2"].salary == "suhbat asosida"
    assert (got["8"].company, got["8"].title, got["8"].location) == ("Магазин", "Продавец", "Ургенч")
    assert got["9"].title == "Mahoratli usta" and got["10"].title == "Nur jamoasi kengayishi munosabati bilan oshpaz kerak"


def test_a_list_of_roles_as_one_job(spark):
    signs = "\n".join(["#ish", "''Texno bozor'' jamoasiga quyidagi lavozimlarga ishga taklif qilinadi.", "", "▪️ Brend Face", "Talablar:", "• Faqat ayol-qizlar", "", "Ish vaqti va oylik suhbat asosida kelishiladi", "", "▪️Bosh buxgalter", "Talablar:", "• Tajribali bo'lish", "• 1C dasturlarida ishlay olish", "", "Oylik suhbat asosida kelishiladi", "", "Manzil: Urganch shahri", "Tel: +998905589009"])
    rows = messages(spark, signs, LIST, ONE, None).withColumn("source", F.lit("xorazm_ish"))
    got = {x.url.split("/")[-1]: x for x in vacancies(rows, split=False).collect()}
    assert set(got) == {"0", "1", "2"}
    assert (got["0"].title, got["0"].company, got["0"].location, got["0"].salary) == ("Brend Face / Bosh buxgalter", "Texno bozor", "Urganch shahri", "suhbat asosida kelishiladi")
    assert got["1"].title == "Sotuvchi / Kassir" and got["1"].description == LIST
    assert got["2"].title == "oshpaz"


def test_links_of_a_message(spark):
    df = spark.createDataFrame([(["(https://a.example/x)", "ftp://b", "https://t.me/Other/3", "https://telegram.me/s/chan?x"], "see https://a.example/x, t.me/chan/7 http://c.example!", "https://t.me/chan/9"), (None, None, None)], "l array<string>, t string, u string")
    got = df.select(message_links(F.col("l"), F.col("t"), F.array(F.lit("@Chan"), F.lit(None).cast("string")), F.col("u")).alias("x")).collect()
    assert [r.x for r in got] == [["https://a.example/x", "https://t.me/Other/3", "http://c.example"], []]


def test_reports_of_no_messages(spark):
    from postmill.operators import jobs

    none = spark.createDataFrame([], "id bigint, text string, jobs array<struct<title:string,salary:string,location:string>>")
    assert jobs.coverage_samples(none).collect() == [] and tuple(jobs.replay_report(none).first()) == (0, 0, 0)


def notice_rows(spark, *texts):
    from postmill.operators.listing_posts import notices

    r = Registry()
    r.register("notices", "@xorazm_ish", "notices", notices)
    return {int(x.url.split("/")[-1]): x for x in r.ingest(messages(spark, *texts)).collect()}


def test_notices_become_jobs(spark):
    labelled = "YANGI ISH\n💼 Ish lavozimi: Kassir\n🏢 Ish beruvchi: Anor savdo\n📍 Manzil: Urganch\n🎯 Mo'ljal: bozor yoni\n💰 Ish haqi: 3 mln so'm\n• bonus 10%\n☎ +998 90 111 22 33"
    listed = "ISH BOR\nBo'sh ish o'rinlari:\n• Ofitsiant\n• Oshpaz (ayol)\n• Kassir\nManzil:\nXonqa tumani\nIsh joyi: Bahor restorani\nMaosh:\nkelishilgan\nTel: +998901112233"
    invited = "Guliston kafesiga oshpaz ishga taklif qilinadi!\nHudud: Gurlan\nKunlik 150 ming"
    headed = "«Nur» do'koni\nIshga taklif qilinadi\nSotuvchi\nTalablar:\n• tajriba\nOylik kelishiladi"
    texts = [labelled, listed, invited, headed, None, "salom do'stlar", "#kurs\n" + labelled, "Onlayn dars " + labelled, "Manzil: X\nOylik: 1"]
    got = notice_rows(spark, *texts)
    assert set(got) == {0, 1, 2, 3}
    a, b, c, d = (got[i] for i in range(4))
    assert (a.title, a.company, a.location, a.salary) == ("Kassir", "Anor savdo", "Urganch (bozor yoni)", "3 mln so'm; • bonus 10%")
    assert (b.title, b.company, b.location, b.salary) == ("Ofitsiant / Oshpaz (ayol) / Kassir", "Bahor restorani", "Xonqa tumani", "kelishilgan")
    assert (c.title, c.company, c.location, c.salary) == ("Guliston kafesiga oshpaz ishga taklif qilinadi", "Guliston kafe", "Gurlan", "150 ming")
    assert (d.title, d.company, d.salary) == ("Sotuvchi", "Nur", "kelishiladi")
    assert d.contact_links == ["https://forms.example/a"] and d.description == headed


def test_notices_of_city_channels(spark):
    from postmill.operators.listing_posts import CITIES, notices

    one, two = CITIES["ishchi_bor_kerak_toshkent"], CITIES["ishbor_toshkent_kerak_ishchi_bor"]
    plain = "✅ Nur logistics kompaniyasiga haydovchi ishga taklif qilinadi\nManzil: Chilonzor\nmetro yonida\nMo`ljal: bozor\nOylik: 5 mln\nAsosiy kanal https://t.me/+abc\nTel: +998901112233"
    listed = "Bo‘sh ish o‘rinlari:\n🔹 Kassir 🔹 Oshpaz 🔹 Farrosh\nIsh beruvchi: Anor\nDaromad: 3 mln\nTel: +998901112233"
    free = "Kuryer kerak\nIsh hududni o'zingiz tanlaysiz!\nTel: 901112233"

    def run(city, *texts):
        rows = messages(spark, *texts).withColumn("source", F.lit("city"))
        return {int(r.url.split("/")[-1]): r for r in notices(rows, city).collect()}

    got = run(one, plain, "Android va iOS uchun o‘z dasturimizni chiqardik, operator kerak", None)
    assert set(got) == {0}
    r = got[0]
    assert (r.title, r.company, r.location, r.salary) == ("haydovchi", "Nur logistics kompaniyasi", "Chilonzor; metro yonida (bozor)", "5 mln")
    assert r.contact_links == ["https://forms.example/a"]
    got = run(two, listed, free)
    assert (got[0].title, got[0].company, got[0].salary) == ("Kassir / Oshpaz / Farrosh", "Anor", "3 mln")
    assert (got[1].title, got[1].location) == ("Kuryer", "Ish hududni o'zingiz tanlaysiz")
