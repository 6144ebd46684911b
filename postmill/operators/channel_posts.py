"""The ingestion rule of a channel of vacancies: messages to raw jobs, with a job for each role of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contacts import links_of
from ..functions.lines import nonempty, position, take_until
from ..functions.text import contains_any, filled, let
from .dedup import written
from .semi_structured import either

# What lines begin with and hold.
SECTIONS = [
    "talablar", "umumiy talablar", "vazifasi", "vazifalar", "asosiy vazifalar", "ish vaqti", "ish tartibi", "ish grafigi", "oylik", "kunlik", "maosh", "manzil", "mo'ljal", "murojaat", "tel", "telefon", "aloqa", "rezyume",
    "anketa", "biz taklif qilamiz", "qulayliklar", "yosh chegarasi", "qo'shimcha", "общие требования", "требования", "обязанности", "рабочее время", "график работы", "адрес", "ориентир", "заработная плата", "зарплата",
]
NOISE, NOISE_LINES = ["#ish", "@xorazm_ish", "xorazm ish", "kanalga obuna"], ["#ish", "ish", "vakansiya"]
OTHER_TAGS = ["#yangilik", "#fikr", "#mulohaza", "#foydali", "#tabrik", "#reklama", "#eslatma", "#malumot", "#ishchi_topildi", "#ish_kerak"]
OTHER_PHRASES = ["ushbu reklama egasi ishchi topganini ma'lum qildi", "o'zingizga zarur ishchini biz orqali toping", "ishchi topganini ma'lum qildi"]
CONTACTS = ["tel", "telefon", "aloqa", "murojaat", "rezyume", "тел", "контакт"]
TAIL = ["manzil", "mo'ljal", "tel", "telefon", "aloqa", "murojaat"]
LISTS = ["quyidagi lavozim", "lavozimlar", "должност", "на должность", "на следующие должности"]
ROLES = ["menejer", "sotuvchi", "administrator", "tikuvchi", "oshpaz", "operator", "kassir", "yuk", "agent", "marketolog", "barista", "ofitsiant", "qorovul", "воспитатель", "учитель", "продав", "оператор"]
MORE_ROLES = ["buxgalter", "xodim", "face", "бухгалтер"]
NO_HEADINGS = ["faqat ", "kamida ", "tajriba ", "mas'uliyat", "masuliyat", "ijtimoiy ", "tashqi ", "kreativ ", "barqaror ", "ahil ", "professional ", "qulay ", "shaxsiy ", "oylik ", "maosh ", "ish vaqti", "manzil", "mo'ljal", "telefon", "tel", "aloqa"]
AMOUNTS = ["kunlik", "so'm", "so‘m", "mln", "maosh", "oylik", "zarabot", "зарплат"]
BENEFIT_MARKS = ["✓", "✔", "✅"]
TITLE_PREFIXES = ["o‘quv markazining", "o'quv markazining", "xususiy maktabning", "nodavlat ta’lim muassasasiga", "nodavlat ta'lim muassasasiga", "mchj"]
BULLETS = "-•▪*●◦"
BULLET = r"^[\s\-•▪*●◦️]+"
PHONE = r"(?U)\+?\d(?:[\d\s()\-]{6,}\d)"
TAG = r"(?iu)#[\w\x{0400}-\x{04FF}\x{2019}\x{02BB}\x{02BC}]+"
INVITES = r"ishga\s+taklif\s+qilin(?:adi|adi!|adi\.|moqda|gan)"
SIGNALS = [r"ishga\s+taklif\s+qilin", r"\b(?:vakansiya|bo'sh\s+ish\s+o'rni|lavozim|xodim\s+kerak|ishchi\s+kerak)\b", r"\b(?:oylik|kunlik|maosh)\b", r"приглашает\s+на\s+работу", r"\b(?:должность|заработная\s+плата|зарплата|адрес)\b"]
ROLE_AT = rf"(?iuU)^(.+?)(?:ga|ka|qa)\s+(.+?)\s+{INVITES}"
ROLE_ALONE, ROLE_WANTED = rf"(?iuU)^(.+?)\s+{INVITES}", r"(?iuU)^(.+?)\s+(?:kerak|talab\s+etiladi)"
RUSSIAN = r"(?iuU)^(.+?)\s+приглашает\s+на\s+работу(?:.*?)(?:(?:на\s+должность|на\s+следующие\s+должности)\.?\s*)?$"
QUOTED = "[\"'“«]([^\"'”»]+)[\"'”»]"
FIELDS = {
    "company": r"(?iuU)^(?:kompaniya|ish\s+joyi|korxona)\s*[:\-]\s*(.+)$", "location": r"(?iuU)^(?:manzil|адрес)\s*[:\-]?\s*(.+)$",
    "landmark": r"(?iuU)^(?:mo'ljal|ориентир)\s*[:\-]?\s*(.+)$", "salary": r"(?iuU)^(?:maosh|oylik|kunlik|заработная\s+плата|зарплата)\s*[:\-]?\s*(.+)$",
}
BRANCH = r"(?iuU)([A-Za-zА-Яа-яЁёЎўҚқҒғҲҳʼʻ‘’\"'.,\-\s]+?)\s+filial(?:iga|lariga)\b"
CITY = r"(?iuU)(?:город|г\.)\s*([A-Za-zА-Яа-яЁёЎўҚқҒғҲҳʼʻ‘’\"'.,\-\s]+)"
PAY = r"(?iuU)\b(?:maosh|oylik|kunlik|fiksa|bonus|foiz|suhbat\s+asosida|kelishiladi|so'm|ming|mln|million|\$|зарплата|заработная\s+плата|собеседован)\b"
WHOLE_HEADING = r"(?iuU)\b(?:jamoa\w*|munosabati\s+(?:bilan|ila)|kengay\w*)\b"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \-:;,.]+|[ \-:;,.]+$", "")


def without(c: Column, *patterns: str) -> Column:
    for pattern in patterns:
        c = F.regexp_replace(c, "(?iuU)" + pattern, "")
    return c


def bare(c: Column) -> Column:
    return strip(F.regexp_replace(c, BULLET, ""))


def short(c: Column) -> Column:
    return F.regexp_replace(trimmed(bare(c)), r"\s{2,}", " ")


def title_of(c: Column) -> Column:
    out = without(short(c), r"^(?:va\s+)?(?:[\wʼʻ‘’\"'().,-]+\s+filiallariga\s+)+", r"^(?:quyidagi\s+lavozim(?:lar)?(?:ga|bo'yicha)?\s*)", r"\blavozimiga\b", *(rf"^\Q{p}\E\s+" for p in TITLE_PREFIXES))
    return trimmed(F.regexp_replace(out, r"\s{2,}", " "))


def company_of(c: Column) -> Column:
    out = strip(without(short(c), r"\b(?:ga|ka|qa)$"))
    out = without(out, r"\b(?:mchj|xususiy\s+maktab(?:ning)?|o['’‘`]?quv\s+markaz(?:i|ining))\b")
    return filled(trimmed(F.regexp_replace(out, r"\s{2,}", " ")))


def starts(c: Column, words: list[str]) -> Column:
    return c.rlike(rf"^(?:{either(words)})")


def read_line(line: Column) -> Column:
    """struct of a line: text, what is left without its bullet, and what both are, each computed once."""
    contact = lambda x: starts(F.lower(x), CONTACTS) | x.rlike(PHONE)

    def facts(plain: Column) -> Column:
        low = F.lower(plain)
        bullet = F.substring(line, 1, 1).isin([*BULLETS])
        noise = F.lower(line).isin(NOISE_LINES) | starts(F.lower(line), NOISE) | starts(F.regexp_replace(low, "^[👉☝👇 ]+", ""), NOISE)
        open_ = (plain != "") & ~starts(low, SECTIONS) & ~contact(plain)
        priced = F.contains(plain, F.lit(":")) & (contains_any(low, AMOUNTS) | plain.rlike(r"\p{Nd}"))
        heads = open_ & (F.length(plain) <= 60) & ~starts(low, NO_HEADINGS) & ~priced & (bullet | contains_any(low, ROLES + MORE_ROLES))
        section = starts(F.lower(line), SECTIONS)
        return F.struct(
            line.alias("text"), plain.alias("bare"), bullet.alias("bullet"), noise.alias("noise"), section.alias("section"), contact(line).alias("contact"),
            (open_ & (bullet | contains_any(low, ROLES))).alias("role"), heads.alias("heads"), (starts(F.lower(line), TAIL) | line.rlike(PHONE)).alias("tail"),
        )

    return let(bare(line), facts)


def field(lines: Column, name: str) -> Column:
    """The value behind the first label of a kind in an array of texts."""
    first = F.get(F.filter(lines, lambda x: x.rlike(FIELDS[name])), F.lit(0))
    return F.regexp_replace(strip(F.regexp_extract(first, FIELDS[name], 1)), r"\.+$", "")


def salary_of(lines: Column) -> Column:
    """The labelled value, else all lines about pay that are neither contacts nor benefits."""
    about = lambda x: (F.lower(x).rlike("^(?:oylik|kunlik|maosh)") | x.rlike(PAY)) & ~(starts(F.lower(x), CONTACTS) | x.rlike(PHONE)) & ~starts(x, BENEFIT_MARKS)
    clean = lambda x: trimmed(without(bare(x), r"^(?:ish\s+vaqti\s+va\s+oylik)\s+", r"^(?:oylik|maosh|kunlik)\s*[:\-]?\s*"))
    return F.coalesce(field(lines, "salary"), filled(F.array_join(F.array_distinct(F.transform(F.filter(lines, about), clean)), "; ")))


def heading_place(heading: Column, company: Column) -> Column:
    value = F.regexp_extract(heading, BRANCH, 1)
    value = F.when(company.isNotNull(), strip(F.replace(value, company, F.lit("")))).otherwise(value)
    value = F.regexp_replace(value, "^[\"'“«»” ]+|[\"'“«»” ]+$", "")
    branch = trimmed(F.regexp_replace(without(value, r"^(?:o['’‘`]?quv\s+markazining|xususiy\s+maktabning|mchj)\s+"), r"\s{2,}", " "))
    city = trimmed(F.regexp_replace(F.regexp_extract(heading, CITY, 1), r"\s{2,}", " "))
    return F.coalesce(filled(branch), filled(city))


def join_roles(roles: Column) -> Column:
    """Up to four roles by name, and the number of the others; null if there is none."""
    return let(F.array_distinct(nonempty(roles)), lambda r: F.when(F.size(r) > 4, F.concat(F.array_join(F.slice(r, 1, 4), " / "), F.lit(" +"), (F.size(r) - 4).cast("string"))).when(F.size(r) > 0, F.array_join(r, " / ")))


def role_lines() -> Column:
    """The roles below the heading: after a heading that announces them the first run of candidates and all later role
    headings, else the run of candidates that begins with a bullet."""
    below = F.slice("_lines", F.col("_at") + 2, F.greatest(F.size("_lines") - F.col("_at") - 1, F.lit(0)))
    first = take_until(below, lambda m: m.section)

    def run(lines: Column, begin: Column) -> Column:
        return F.transform(take_until(F.slice(lines, begin + 1, F.greatest(F.size(lines) - begin, F.lit(0))), lambda m: ~m.role), lambda m: m.bare)

    announced = let(first, lambda x: run(x, position(x, lambda m: m.role)))
    headed = F.transform(F.filter("_heads", lambda i: i > F.col("_at")), lambda i: F.get(F.col("_lines"), i).bare)
    bulleted = let(first, lambda x: let(position(x, lambda m: ~m.bullet | m.role), lambda p: F.when(F.coalesce(F.get(x, p).bullet, F.lit(False)), run(x, p)).otherwise(F.array().cast("array<string>"))))
    return F.when(F.col("_list"), F.array_distinct(nonempty(F.concat(announced, headed)))).otherwise(bulleted)


def role_headings() -> Column:
    """The places of lines that head a role of their own: what follows is a section or a contact, and no bullet stands before."""

    def heads(m: Column, i: Column) -> Column:
        before = F.filter(F.slice("_lines", F.lit(1), i), lambda x: ~x.noise)
        after = F.filter(F.slice("_lines", i + 2, F.greatest(F.size("_lines") - i - 1, F.lit(0))), lambda x: ~x.noise)
        free = ~F.coalesce(F.try_element_at(before, F.lit(-1)).bullet, F.lit(False))
        return F.when(m.heads & free & let(F.get(after, F.lit(0)), lambda x: F.coalesce(x.section | x.contact, F.lit(False))), i)

    return F.array_compact(F.transform("_lines", heads))


def vacancies(messages: DataFrame, split: bool = True) -> DataFrame:
    """Raw jobs of messages (text, url, date, contact_links, channel, source): a rule for ``Registry.register``.

    Messages without signs of a vacancy, with blocked phrases, or with another tag in their first three lines give none,
    nor do those without a title. A heading that announces several roles gives a job for each role heading below it (two at
    least), with the lines up to the next one and the contacts at the end; else a message is one job, as every message is
    where ``split`` is false: its title then names the roles. Staged in selects; no shuffle. The rows are written before those without a title go, so that no filter is pushed into the expressions."""
    text = strip(F.regexp_replace(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\u00a0\u200b", "  "), r"\r\n?", "\n"), r"\n{3,}", "\n\n"))
    s = messages.withColumn("_text", text).withColumn("_low", F.lower("_text"))
    wanted = F.lit(False)
    for pattern in SIGNALS:
        wanted = wanted | F.col("_low").rlike("(?U)" + pattern)
    lines = nonempty(F.transform(F.split("_text", "[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " "))))
    s = s.withColumn("_texts", lines)
    tags = F.flatten(F.transform(F.slice("_texts", 1, 3), lambda x: F.regexp_extract_all(F.lower(x), F.lit(TAG), F.lit(0))))
    s = s.withColumn("_fine", wanted & ~contains_any(F.col("_low"), OTHER_PHRASES) & ~F.arrays_overlap(tags, F.array(*map(F.lit, OTHER_TAGS))) & (F.size("_texts") > 0))
    s = s.withColumn("_lines", F.when(F.col("_fine"), F.transform("_texts", read_line)).otherwise(F.slice(F.transform("_texts", read_line), 1, 0)))
    at = let(position(F.col("_lines"), lambda m: ~m.noise), lambda i: F.when(i < F.size("_lines"), i).otherwise(0))
    s = s.withColumn("_at", at).withColumn("_heading", F.get(F.col("_lines"), F.col("_at")).text).withColumn("_heads", role_headings())
    s = s.withColumn("_list", contains_any(F.lower("_heading"), LISTS))
    s = s.withColumn("_below", F.filter("_heads", lambda i: i > F.col("_at")))
    quoted, at_role, russian = F.regexp_extract("_heading", QUOTED, 1), F.regexp_extract("_heading", ROLE_AT, 1), F.regexp_extract("_heading", RUSSIAN, 1)
    company = F.when(quoted != "", strip(quoted)).when(F.col("_heading").rlike(ROLE_AT), company_of(at_role)).when(F.col("_heading").rlike(RUSSIAN), company_of(russian))
    s = s.withColumns({"_company": F.coalesce(field(F.col("_texts"), "company"), company), "_roles": role_lines()})

    def whole_or(pattern: str) -> Column:
        return let(title_of(F.regexp_extract("_heading", pattern, 1)), lambda x: F.when(x.rlike(WHOLE_HEADING), title_of(F.col("_heading"))).otherwise(x))

    invited = strip(without(F.col("_heading"), INVITES + ".*", r"\b(?:kerak|talab\s+etiladi)\b.*", r"приглашает\s+на\s+работу.*"))
    heading = F.col("_heading")
    named = (
        F.when(F.size("_roles") > 0, join_roles(F.transform("_roles", short))).when(heading.rlike(ROLE_AT), title_of(F.regexp_extract(heading, ROLE_AT, 2))).when(heading.rlike(ROLE_ALONE), whole_or(ROLE_ALONE))
        .when(heading.rlike(ROLE_WANTED), whole_or(ROLE_WANTED)).when(F.get(F.col("_lines"), F.col("_at")).noise, F.lit(None)).otherwise(title_of(invited))
    )
    several = F.lit(split) & F.col("_list") & (F.size("_below") >= 2)
    s = s.withColumn("_title", named).select("*", F.posexplode_outer(F.when(several, F.col("_below")).otherwise(F.array(F.lit(None).cast("int")))).alias("_i", "_begin"))
    end = F.coalesce(F.get(F.col("_below"), F.col("_i") + 1), F.size("_texts"))
    last = F.slice("_lines", F.element_at("_below", -1) + 1, F.size("_lines"))
    tail = let(F.reverse(F.filter(last, lambda m: ~m.noise)), lambda x: F.reverse(F.transform(take_until(x, lambda m: ~m.tail), lambda m: m.text)))
    block = F.concat(F.slice("_texts", F.lit(1), F.col("_at") + 1), F.slice("_texts", F.col("_begin") + 1, end - F.col("_begin")), F.when(F.col("_i") < F.size("_below") - 1, tail).otherwise(F.array().cast("array<string>")))
    part = F.col("_begin").isNotNull()
    s = s.withColumn("_use", F.when(part, block).otherwise(F.col("_texts")))
    s = s.withColumns({
        "_name": strip(F.when(part, short(F.get(F.col("_texts"), F.col("_begin")))).otherwise(F.col("_title"))), "_told": F.when(part, F.array_join("_use", "\n")).otherwise(F.col("_text")),
        "_place": field(F.col("_use"), "location"), "_mark": field(F.col("_use"), "landmark"), "_pay": salary_of(F.col("_use")), "_url": F.when(part, F.concat("url", F.lit("#role-"), (F.col("_i") + 1).cast("string"))).otherwise(F.col("url")),
    })
    place = F.when(F.col("_place").isNotNull() & F.col("_mark").isNotNull(), F.concat("_place", F.lit(" ("), "_mark", F.lit(")"))).otherwise(F.coalesce("_place", "_mark", heading_place(heading, F.col("_company"))))
    given = lambda c: filled(strip(c))
    links = links_of(messages)
    out = s.select(
        F.col("_name").alias("title"), given(F.col("_company")).alias("company"), F.col("_told").alias("description"), given(F.col("_pay")).alias("salary"), given(place).alias("location"), "source",
        F.col("_url").alias("url"), F.coalesce("date", F.current_timestamp()).alias("posted_at"), links.alias("contact_links"), F.col("_fine"),
    )
    return written(out).where(F.col("_fine") & (F.coalesce("title", F.lit("")) != "") & (F.col("description") != "")).drop("_fine")
