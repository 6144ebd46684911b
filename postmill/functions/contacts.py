"""Column functions that find phones, user names and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled, let, normalize_whitespace, trim_control

# Fixed values.
PHONE = r"(?iu)(?:\+?\d[\d \t()\-]{6,}\d)"
UZBEK_PHONE = r"\+?998(?:[\s\-()]?\d){9}"
USERNAME = r"(?<![\w@])@([A-Za-z0-9_]{4,})"
VISIBLE_URL = r"(?i)\b(?:https?://|t\.me/)[^\s<>()]+"
SOURCE_URL = r"https?://t\.me/([^/\s]+)/\d+"
MESSENGER_HOST = r"(?i)^https?://(?:www\.)?(?:t\.me|telegram\.me)(?:[/?#]|$)"
MESSENGER_NAME = r"(?i)^https?://[^/?#]+/+(?:s/+(?=[^/?#]))?([^/?#]+)"
OWN_LINK = r"(?iu)^https?://(?:www\.)?(?:t\.me|telegram\.me)/([^/\s?#]+)/?.*$"


def phone_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\P{Nd}", "")


def normalize_phone(c: Column) -> Column:
    """Digits, with + where there was one or where a full number with country code stands; null below 7 digits."""

    def canonical(plain: Column) -> Column:
        full = lambda d: plain.startswith("+") | (d.startswith("998") & (F.length(d) == 12))
        return let(phone_digits(plain), lambda d: F.when(F.length(d) < 7, F.lit(None)).when(full(d), F.concat(F.lit("+"), d)).otherwise(d))

    return let(normalize_whitespace(c), canonical)


def normalize_link(c: Column) -> Column:
    """A link without brackets and trailing marks, with a scheme; null unless it is http or https."""
    out = F.regexp_replace(trim_control(c), "^<", "")
    for end in (">$", r"\)$", r"\]$", r"[.,;:!?]+$"):
        out = F.regexp_replace(out, end, "")
    scheme = lambda x: F.when(F.lower(x).startswith("t.me/"), F.concat(F.lit("https://"), x)).when(x.startswith("http://") | x.startswith("https://"), x)
    return let(out, scheme)


def found(c: Column, pattern: str, group: int, each=lambda x: x) -> Column:
    """Distinct matches in order of their first place."""
    every = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group)), each)
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


def phones(c: Column) -> Column:
    return found(c, PHONE, 0, normalize_phone)


def uzbek_phones(c: Column) -> Column:
    """Full numbers with the country code alone."""

    def plain(x: Column) -> Column:
        digits = phone_digits(x)
        return F.when(x.startswith("+") | (F.length(digits) == 12), F.concat(F.lit("+"), digits)).otherwise(digits)

    return found(c, UZBEK_PHONE, 0, plain)


def source_handle(url: Column) -> Column:
    """The channel name of a message link, or null."""
    return filled(F.regexp_extract(url, SOURCE_URL, 1))


def own_names(source: Column, url: Column) -> Column:
    """The source's own names in lower case: its label and the channel of its link."""
    names = F.transform(F.array(source, source_handle(url)), lambda x: F.lower(F.regexp_replace(trim_control(x), "^@", "")))
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))


def usernames(c: Column, own: Column) -> Column:
    return F.filter(found(c, USERNAME, 1), lambda x: ~F.array_contains(own, F.lower(x)))


def is_own_link(link: Column, own: Column) -> Column:
    return F.array_contains(own, F.lower(F.regexp_extract(link, OWN_LINK, 1)))


def visible_links(c: Column, own: Column, message_url: Column) -> Column:
    here = F.coalesce(normalize_link(message_url), F.lit(""))
    return let(own, lambda names: F.filter(found(c, VISIBLE_URL, 0, normalize_link), lambda x: (x != here) & ~is_own_link(x, names)))


def clean_link(c: Column) -> Column:
    """A link without brackets around it and marks at its end, with a scheme; null unless it is http or https with a host."""
    out = F.regexp_replace(trim_control(c), r"^[<>\[\]{}()]+|[<>\[\]{}()]+$", "")
    out = F.regexp_replace(out, r"[.,;:!?)\]}>\"']+$", "")
    scheme = lambda x: F.when(F.lower(x).startswith("t.me/"), F.concat(F.lit("https://"), x)).otherwise(x)
    return let(let(out, scheme), lambda x: F.when(x.rlike(r"(?i)^https?://[^/?#]"), x))


def entity_links(text: Column, entities: Column) -> Column:
    """The links that entities of a message name: the hidden one of a "text_url", for a "url" the part of the text that it marks.

    Offsets and lengths count characters (code points, as Spark's substring does) of the text without white space at its
    ends; negative ones count as 0, and what lies beyond the end is empty. Null entities have no links."""
    kind = "array<struct<type:string,offset:int,length:int,url:string>>"
    positive = lambda x: F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))
    cut = lambda t, e: F.when(e["type"] == "text_url", e["url"]).when(e["type"] == "url", F.substring(t, positive(e["offset"]) + 1, positive(e["length"])))
    stripped = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    links = let(stripped, lambda t: F.transform(F.coalesce(entities, F.array().cast(kind)), lambda e: cut(t, e)))
    return F.filter(links, lambda x: F.coalesce(x, F.lit("")) != "")


def own_link_names(own: Column) -> Column:
    return F.transform(F.array_compact(own), lambda x: F.lower(F.regexp_replace(trim_control(x), "^@+", "")))


def message_links(links: Column, text: Column, own: Column, url: Column, entities: Column | None = None) -> Column:
    """The links of a message (exported ones, then those of its entities in their order, then those in its text), each
    once, but for the message's own and those to the channel (``own``: an array of its names)."""
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce(links, none), entity_links(text, entities) if entities is not None else none, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(VISIBLE_URL), F.lit(0)))
    foreign = lambda names: lambda x: (x != F.coalesce(clean_link(url), F.lit(""))) & ~(x.rlike(MESSENGER_HOST) & F.array_contains(names, F.lower(F.regexp_extract(x, MESSENGER_NAME, 1))))
    return let(own_link_names(own), lambda names: F.array_distinct(F.filter(F.array_compact(F.transform(every, clean_link)), foreign(names))))


def links_of(messages, names: tuple[str, ...] = ("channel", "source")) -> Column:
    """``message_links`` of a DataFrame of messages, with the entities, and the name of the chat, where it has these columns."""
    names = (*names, "chat_username") if "chat_username" in messages.columns else names
    return message_links(F.col("contact_links"), F.col("text"), F.array(*names), F.col("url"), F.col("entities") if "entities" in messages.columns else None)
