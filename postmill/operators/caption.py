"""Captions of at most 1024 characters (UTF-16 units of the plain text), built from blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.contacts import phone_digits
from ..functions.text import contains_any, contains_cyrillic, escape_attribute, escape_html, let, mapped, one_blank, trim_control, utf16_length

LIMIT = 1024
# Labels, and what says nothing by itself in a contact or additional line.
LATIN = {"company": "Kompaniya", "salary": "Maosh", "location": "Manzil", "work_schedule": "Ish vaqti", "requirements": "Talablar", "responsibilities": "Vazifalar", "benefits": "Qulayliklar", "additional": "Qo'shimcha", "contact": "Murojaat", "telegram": "Telegram", "phone": "Telefon", "links": "Havolalar", "link": "Murojaat"}
CYRILLIC = {"company": "Компания", "salary": "Маош", "location": "Манзил", "work_schedule": "Иш вақти", "requirements": "Талаблар", "responsibilities": "Вазифалар", "benefits": "Қулайликлар", "additional": "Қўшимча", "contact": "Мурожаат", "telegram": "Telegram", "phone": "Телефон", "links": "Ҳаволалар", "link": "Мурожаат"}
DULL_CONTACT = ["murojaat", "murojaat uchun", "aloqa", "telefon", "tel", "telegram", "telegram orqali", "onlayn anketa", "anketa", "bot", "мурожаат", "мурожаат учун", "алоқа", "телефон", "тел", "телеграм", "телеграм орқали", "онлайн анкета", "анкета", "бот"]
DULL_LABELS = ["bog'lanish", "bog'lanish uchun", "boglanish", "murojaat", "murojaat uchun", "aloqa", "aloqa uchun", "telefon", "telefon raqam", "telefon raqami", "tel", "mo'ljal", "mo‘ljal", "manzil", "ish haqi", "maosh", "oylik", "боғланиш", "мурожаат", "мурожаат учун", "алоқа", "алоқа учун", "телефон", "телефон рақам", "телефон рақами", "тел", "мўлжал", "манзил", "иш ҳақи", "маош", "ойлик"]
CALLS = ["biz bilan bog'lan", "murojaat qiling", "биз билан боғлан", "мурожаат қилинг"]
MONEY = ["som", "so'm", "so‘m", "сўм", "сум", "mln", "million", "ming"]
RESUMES = ["telegram orqali", "rezyume", "rezume", "resume", "анкета", "резюме", "телеграм орқали"]
PREFIX = "^[\\s•\\-–—✓✔☑▪▫◆◇★☆▶►️﻿:;,.]+"

BLOCK = "struct<lines:array<string>,plain:array<string>,partial:boolean>"


def tidy(c: Column) -> Column:
    """Blanks collapsed and decoration in front removed."""
    plain = trim_control(one_blank(mapped(c, "\u00a0\u200b", "  ")))
    return trim_control(F.regexp_replace(plain, PREFIX, ""))


def meaningful(c: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), tidy)
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def plainest(line: Column) -> Column:
    return trim_control(one_blank(F.lower(line)))


def known(phone: Column, user: Column, link: Column):
    """A test whether a line is no more than a phone, name or link that has its own block."""
    digits = F.filter(F.transform(phone, phone_digits), lambda x: x != "")
    users, links = (F.transform(x, lambda y: F.lower(trim_control(y))) for x in (user, link))
    return lambda line, low: F.array_contains(digits, phone_digits(line)) | F.array_contains(links, low) | F.array_contains(F.transform(users, lambda u: F.regexp_replace(u, "^@", "")), F.regexp_replace(low, "^@", ""))


def contact_lines(c: Column, phone: Column, user: Column, link: Column) -> Column:
    is_known = known(phone, user, link)

    def dull(line: Column) -> Column:
        low = plainest(line)
        rest = F.aggregate(user, low, lambda t, u: F.replace(F.replace(t, F.concat(F.lit("@"), F.lower(u)), F.lit(" ")), F.lower(u), F.lit(" ")))
        rest = F.aggregate(link, rest, lambda t, x: F.replace(t, F.lower(x), F.lit(" ")))
        rest = F.aggregate(phone, rest, lambda t, x: F.replace(t, F.lower(x), F.lit(" ")))
        rest = plainest(F.regexp_replace(rest, r"[+]?[\d\s()\-]{7,}", " "))
        return is_known(line, low) | low.isin(*DULL_CONTACT) | (rest == "") | rest.isin(*DULL_CONTACT)

    return F.filter(meaningful(c), lambda x: ~dull(x))


def dull_label(low: Column) -> Column:
    bare = F.regexp_replace(low, ":$", "")
    starts = F.lit(False)
    for p in DULL_LABELS:
        starts = starts | low.startswith(f"{p}:")
    return bare.isin(*DULL_LABELS) | low.isin(*DULL_CONTACT) | bare.isin(*DULL_CONTACT) | starts


def additional_lines(c: Column, phone: Column, user: Column, link: Column) -> Column:
    is_known = known(phone, user, link)
    dull = lambda line, low: is_known(line, low) | contains_any(low, CALLS) | (low.rlike(r"\p{Nd}") & contains_any(low, MONEY)) | dull_label(low)
    return F.filter(meaningful(c), lambda x: ~let(plainest(x), lambda low: dull(x, low)))


def benefit_lines(c: Column, phone: Column, user: Column, link: Column) -> Column:
    is_known = known(phone, user, link)
    dull = lambda line, low: is_known(line, low) | contains_any(low, CALLS) | contains_any(low, RESUMES) | dull_label(low)
    return F.filter(meaningful(c), lambda x: ~let(plainest(x), lambda low: dull(x, low)))


def block(lines: Column, plain: Column, partial: bool) -> Column:
    return F.struct(lines.alias("lines"), plain.alias("plain"), F.lit(partial).alias("partial")).cast(BLOCK)


def bullets(icon: str, label: Column, values: Column) -> Column:
    """A header and its items; may be cut after any item but the header."""
    items = F.array_distinct(F.filter(F.transform(values, tidy), lambda x: x != ""))

    def made(x: Column) -> Column:
        lines = F.concat(F.array(F.concat(F.lit(f"{icon} <b>"), label, F.lit(":</b>"))), F.transform(x, lambda y: F.concat(F.lit("• "), escape_html(y))))
        plain = F.concat(F.array(F.concat(F.lit(f"{icon} "), label, F.lit(":"))), F.transform(x, lambda y: F.concat(F.lit("• "), y)))
        return F.when(F.size(x) > 0, block(lines, plain, True))

    return let(items, made)


def links(label: Column, item: Column, values: Column) -> Column:
    kept = F.array_distinct(F.filter(F.transform(values, tidy), lambda x: x != ""))

    def made(x: Column) -> Column:
        name = lambda i: F.concat(item, F.lit(" "), (i + 1).cast("string"))
        lines = F.concat(F.array(F.concat(F.lit("🔗 <b>"), label, F.lit(":</b>"))), F.transform(x, lambda y, i: F.concat(F.lit('• <a href="'), escape_attribute(y), F.lit('">'), name(i), F.lit("</a>"))))
        plain = F.concat(F.array(F.concat(F.lit("🔗 "), label, F.lit(":"))), F.transform(x, lambda y, i: F.concat(F.lit("• "), name(i))))
        return F.when(F.size(x) > 0, block(lines, plain, False))

    return let(kept, made)


def fields(icons_labels_values: list) -> Column:
    rows = []
    for icon, label, value in icons_labels_values:
        v = tidy(value)
        rows.append(F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.concat(F.lit(f"{icon} <b>"), label, F.lit(":</b> "), escape_html(v)).alias("l"), F.concat(F.lit(f"{icon} "), label, F.lit(": "), v).alias("p"))))
    kept = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return let(kept, lambda x: F.when(F.size(x) > 0, block(F.transform(x, lambda y: y.l), F.transform(x, lambda y: y.p), False)))


def fit(blocks: Column, limit: Column) -> Column:
    """Blocks in order while they fit; one that does not is cut if it may be, or left out, and later ones still get their chance."""
    size = lambda x: utf16_length(F.array_join(x, "\n"))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"))

    def longest(plain: Column, room: Column) -> Column:
        """How many lines fit into the room."""
        start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("used"), F.lit(False).alias("full"))

        def step(a: Column, line: Column) -> Column:
            used = a.used + 1 + utf16_length(line)
            ok = ~a.full & (used <= room)
            return F.struct((a.n + ok.cast("int")).alias("n"), F.when(ok, used).otherwise(a.used).alias("used"), (a.full | (used > room)).alias("full"))

        return F.aggregate(plain, start, step, lambda a: a.n)

    def pack(a: Column, b: Column) -> Column:
        gap = F.when(F.size(a.out) == 0, 0).otherwise(2)
        room = limit - a.used - gap
        n = F.when(size(b.plain) <= room, F.size(b.plain)).when(b.partial, longest(b.plain, room)).otherwise(0)
        takes = lambda k: (k == F.size(b.plain)) | (k > 1)
        return let(n, lambda k: F.struct(F.when(takes(k), F.concat(a.out, F.array(F.array_join(F.slice(b.lines, F.lit(1), k), "\n")))).otherwise(a.out).alias("out"), F.when(takes(k), a.used + gap + size(F.slice(b.plain, F.lit(1), k))).otherwise(a.used).alias("used")))

    return F.aggregate(blocks, zero, pack, lambda a: F.array_join(a.out, "\n\n"))


def render(footer: str | None = None) -> Column:
    """The caption of a job row, as a column over the columns of jobs."""
    c = F.col
    texts = ["title", "description", "company", "salary", "location", "requirements", "responsibilities", "benefits", "additional", "work_schedule", "contact_text"]
    cyrillic = contains_cyrillic(*map(c, texts))
    label = lambda k: F.when(cyrillic, CYRILLIC[k]).otherwise(LATIN[k])
    listed = lambda x: F.coalesce(c(x), F.array().cast("array<string>"))
    phone, user, link = listed("contact_phone_numbers"), listed("contact_telegram_usernames"), listed("contact_links")
    head = trim_control(one_blank(mapped(c("title"), "\u00a0\u200b", "  ")))
    blocks = F.array(
        F.when(head != "", block(F.array(F.concat(F.lit("🔥 <b>"), escape_html(head), F.lit("</b>"))), F.array(F.concat(F.lit("🔥 "), head)), False)),
        fields([("🏢", label("company"), c("company")), ("💸", label("salary"), c("salary")), ("📍", label("location"), c("location")), ("🕒", label("work_schedule"), c("work_schedule"))]),
        bullets("📋", label("requirements"), meaningful(c("requirements"))),
        bullets("🛠", label("responsibilities"), meaningful(c("responsibilities"))),
        bullets("🎁", label("benefits"), benefit_lines(c("benefits"), phone, user, link)),
        bullets("✨", label("additional"), additional_lines(c("additional"), phone, user, link)),
        bullets("📨", label("contact"), contact_lines(c("contact_text"), phone, user, link)),
        bullets("💬", label("telegram"), F.transform(user, lambda x: F.concat(F.lit("@"), x))),
        links(label("links"), label("link"), link),
        bullets("☎️", label("phone"), phone),
    )
    name = (footer or "").strip()
    name = name if not name or name.startswith("@") else f"@{name}"
    body = fit(F.filter(blocks, lambda x: x.isNotNull()), F.lit(LIMIT - (len(name.encode("utf-16-le")) // 2 + 2 if name else 0)))
    if not name:
        return body
    return let(body, lambda b: F.when(b != "", F.concat(b, F.lit("\n\n"), escape_html(F.lit(name)))).otherwise(escape_html(F.lit(name))))
