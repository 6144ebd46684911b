"""Column functions on single texts: trims, normalisers, cleaners, URL builders. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are stripped at either end of a line, and bullets.
DECORATION = r"[\s\p{So}•▪◦●✔✅❗👤👉➤▶✓🔥💼🏢📍💰📞📋⏰📨📌📱✨🧾]+"
BULLET = r"^\s*(?:[-–—•*▪◦●✔✅☑➤▶✓📌📍📞📋📨📱✨]+|\d+[.)]\s+)\s*"
QUOTES = "\"'“”«»„‟"
LOOKALIKE_LATIN, LOOKALIKE_CYRILLIC = "TCAEOBMPXHtcaeobmpxh", "ТСАЕОВМРХНтсаеовмрхн"
MONEY_STEP = 500
CONTROL = "".join(map(chr, range(0x21)))
LINE_END = r"|[\x85\u2028\u2029]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(c: Column) -> Column:
    """The text, or null where it is empty; computed once."""
    return let(c, lambda x: F.when(x != "", x))


def trim_control(c: Column) -> Column:
    """Strips all characters up to U+0020 at both ends, as a JVM trim does."""
    return F.btrim(c, F.lit(CONTROL))


def mapped(c: Column, old: str, new: str) -> Column:
    """``F.translate``, where a text can hold a character of ``old``: it takes long, and most texts are plain."""

    def changed(x: Column) -> Column:
        can = F.octet_length(x) != F.length(x)
        for char in filter(str.isascii, old):
            can = can | F.contains(x, F.lit(char))
        return F.when(can, F.translate(x, old, new)).otherwise(x)

    return let(c, changed)


def without_end(c: Column, chars: str) -> Column:
    """The text without what ``chars``, a class of characters that repeats, matches at its end (or before one last line end).

    The last character is looked at first, as the pattern is tried at every place of a text."""
    return let(c, lambda x: F.when(F.substring(x, -1, 1).rlike(chars + LINE_END), F.regexp_replace(x, chars + "$", "")).otherwise(x))


def one_blank(c: Column) -> Column:
    """Runs of white space as one blank; single blanks are not replaced by themselves."""
    return F.regexp_replace(c, r"[\t\n\x0B\f\r]\s*| \s+", " ")


def blank_to_null(c: Column) -> Column:
    """Null where nothing but white space is left."""
    return filled(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def normalize_key(c: Column) -> Column:
    """The form under which texts are hashed: plain blanks and apostrophes, one blank in a row, trimmed, lower case."""
    plain = mapped(c, " ​’ʻʼ", "  '''")
    return F.lower(trim_control(one_blank(plain)))


def normalize_apostrophes(c: Column) -> Column:
    return mapped(c, " ​’‘ʻʼ`‍️", "  '''''")


def normalize_whitespace(c: Column) -> Column:
    """Apostrophes unified, blanks and tabs (not line ends) collapsed, trimmed."""
    return trim_control(F.regexp_replace(normalize_apostrophes(c), r"[\t\r\f][ \t\r\f]*| [ \t\r\f]+", " "))


def strip_decorations(c: Column) -> Column:
    plain = F.regexp_replace(normalize_apostrophes(c), "^" + DECORATION, "")
    return trim_control(without_end(plain, DECORATION))


def clean_content_line(c: Column) -> Column:
    """Bullet and trailing decoration removed."""
    return normalize_whitespace(without_end(F.regexp_replace(c, BULLET, ""), DECORATION))


def clean_title(c: Column) -> Column:
    out = F.regexp_replace(strip_decorations(c), r"(?iu)^lavozim\s*[:\-–—]\s*", "")
    return trim_control(F.regexp_replace(out, r"(?iu)^ish\s+lavozimi\s*[:\-–—]\s*", ""))


def strip_wrapped_quotes(c: Column) -> Column:
    return trim_control(F.regexp_replace(trim_control(c), f"^[{QUOTES}]+|[{QUOTES}]+$", ""))


def sentence_case(c: Column) -> Column:
    """Trimmed, the first letter in upper case, all else as it was (acronyms stay)."""
    pattern = r"^([^\p{L}]*)(\p{L})?([\s\S]*)$"
    part = lambda i: F.regexp_extract(trim_control(c), pattern, i)
    return F.when(c.isNotNull(), F.concat(part(1), F.upper(part(2)), part(3)))


def repair_mixed_label(c: Column) -> Column:
    """Latin look-alikes in a mostly Cyrillic label (what stands before the first delimiter) become Cyrillic."""

    def repaired(x: Column) -> Column:
        label = F.regexp_extract(x, r"^([^:\-–—]*)", 1)
        return F.concat(F.translate(label, LOOKALIKE_LATIN, LOOKALIKE_CYRILLIC), F.substring(x, F.length(label) + 1, F.length(x)))

    def mixed(x: Column) -> Column:
        label = F.regexp_extract(x, r"^([^:\-–—]*)", 1)
        cyrillic, latin = F.length(F.regexp_replace(label, r"[^Ѐ-ӿ]", "")), F.length(F.regexp_replace(label, r"[^A-Za-z]", ""))
        return (latin > 0) & (cyrillic > latin)

    return let(c, lambda x: F.when(x.rlike(r"[Ѐ-ӿ]") & mixed(x), repaired(x)).otherwise(x))


def strip_html(c: Column) -> Column:
    """<a> and <b> tags removed and the four entities unescaped."""
    plain = F.regexp_replace(c, r"</?(?:a|b)(?:\s[^>]*)?>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def escape_attribute(c: Column) -> Column:
    return F.replace(escape_html(c), F.lit('"'), F.lit("&quot;"))


def parse_chat_id(c: Column) -> Column:
    """(name, id): a chat given as @name or as a number; a null id where it is neither."""
    return F.struct(F.when(c.startswith("@"), c).alias("name"), F.when(~c.startswith("@"), c.try_cast("bigint")).alias("id"))


def message_url(username: Column, chat_id: Column, message_id: Column) -> Column:
    """The public link of a message by name, else by the inner chat number, else by chat and message."""
    inner = F.regexp_extract(chat_id.cast("string"), r"^-100(\d+)$", 1)
    number = message_id.cast("string")
    return (
        F.when(F.coalesce(username, F.lit("")) != "", F.concat(F.lit("https://t.me/"), username, F.lit("/"), number))
        .when(inner != "", F.concat(F.lit("https://t.me/c/"), inner, F.lit("/"), number))
        .otherwise(F.concat(F.lit("https://t.me/c/"), F.abs(chat_id).cast("string"), F.lit("/"), number))
    )


def utf16_length(c: Column) -> Column:
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def round_money(c: Column) -> Column:
    """Up to the next 500."""
    return (F.ceil(c / MONEY_STEP) * MONEY_STEP).cast("decimal(18,2)")


def contains_cyrillic(*columns: Column) -> Column:
    return F.concat_ws(" ", *columns).rlike(r"[Ѐ-ӿ]")


def contains_any(c: Column, phrases) -> Column:
    """Whether any of the phrases occurs."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out
