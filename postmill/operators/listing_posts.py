"""The ingestion rule of channels of classified notices: messages to raw jobs, all roles of a notice in one title."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contacts import links_of
from ..functions.lines import nonempty, position, take_until
from ..functions.text import contains_any, filled, let
from .channel_posts import starts, strip
from .dedup import written

# What lines begin with and hold.
SECTIONS = [
    "talablar", "vazifalar", "vazifalari", "majburiyatlar", "mas'uliyatlar", "masuliyatlar", "sharoitlar", "qulayliklar", "qo'shimcha", "kompaniya tomonidan", "biz bilan bularga ega bo'lasiz", "biz taklif qilamiz",
    "bizdan taklif", "ish vaqti", "ish jadvali", "ish grafigi", "ish tartibi", "yashash", "bolalar", "telefon", "tel", "aloqa", "bog'lanish", "murojaat", "anketa", "rezyume", "eslatma", "malaka", "afzallik",
    "ish shartlari", "talab va takliflar bilan", "nimalar taklif qilinadi", "kimlar uchun", "вакансиялар", "требования", "обязанности", "условия", "зарплата", "адрес", "талаблар", "вазифалар", "мажбуриятлари",
    "иш шартлари", "иш вақти", "иш графиги", "ойлик", "маош", "манзил", "мулжал", "мурожаат учун", "богланиш учун", "боғланиш учун", "телефон", "тел",
]
FIELD_ONLY = ["hudud", "yoshi", "jinsi", "malumoti", "ma'lumoti", "oylik", "maosh", "ish haqi", "manzil", "mo'ljal", "murojaat uchun", "aloqa uchun", "худуд", "ёши", "жинси", "ойлик", "маош", "манзил", "мулжал", "мурожаат учун"]
NOISE, NOISE_LINES = ["#ish", "@xorazm_ish_bor_elonlar", "xorazm ish bor elonlar"], ["#ish", "ish", "vakansiya"]
OTHER_TAGS = ["#reklama", "#kurs", "#dars", "#telefon"]
OTHER_PHRASES = ["o'quv kursi", "o‘quv kursi", "telefon olmoqchimisiz", "telefon sotmoqchimisiz", "rus tili tez va oson", "ayollarimizga maxsus taklif", "onlayn dars", "savdo vakillari (agentlar) tayyorlash", "сотилади", "аксия", "0-0-8 aksiya", "grant", "vakansya kanal", "vakansiya kanal", "obuna bo'ling"]
CONTACTS = ["tel", "telefon", "aloqa", "bog'lanish", "murojaat", "anketa", "telegram", "qo'shimcha ma'lumot olish uchun", "тел", "телефон", "контакт", "мурожаат", "боғланиш учун", "богланиш учун"]
SIGNS = ["manzil", "hudud", "mo'ljal", "maosh", "oylik", "ish haqi", "telefon", "aloqa", "murojaat", "манзил", "маош", "ойлик", "тел", "мурожаат", "лавозим", "керак"]
COMPANIES = ["mchj", "kompaniya", "firmasi", "restoran", "kafe", "club", "klinika", "markaz", "do'kon", "bog'cha", "maktab", "offis", "ofis", "компания", "фирма", "кафе", "групп", "дилери", "корхона"]
PROMOTIONS = ["ish qidiryapsizmi", "sizni kutmoqda", "bo'sh ish o'rinlarini taklif etadi", "bo‘sh ish o‘rinlarini taklif etadi"]
PRAISE = ["ahil jamoa", "zo'r atmosfera", "o'sish imkoniyati", "ish formasi", "issiq ovqat", "mavsum vaqtida"]
NO_HEADINGS = ["faqat ", "kamida ", "tajriba ", "mas'uliyat", "masuliyat", "ijtimoiy ", "tashqi ", "kreativ ", "barqaror ", "ahil ", "professional ", "qulay ", "shaxsiy ", "oylik ", "maosh ", "ish vaqti", "manzil", "hudud", "telefon", "tel", "aloqa"]
AMOUNTS = ["kunlik", "so'm", "so‘m", "mln", "maosh", "oylik", "ish haqi"]
PAID = ["so'm", "so‘m", "mln", "million", "ming", "bonus", "fiksa", "foiz", "kpi", "suhbat", "kelish"]
CURRENCY = ["so'm", "so‘m", "som", "mln", "ming", "million"]
BARE_TITLES, GREETINGS = ["ish", "ishga", "taklif"], ["yangi ish", "ish bor"]
LIST_BULLETS = "-•▪▫*●◦▶🔸🔹📲📝🚚"
BULLET = r"^[\s\-•▪▫*●◦▶✓✔✅🔸🔹📲📝🚚📌\d().️]+"
SYMBOLS = r"^[\s📣🔉💥🔥✅❗❕❌➖➕👍👆👇☎📞📱🆔🗓💼🏢📍🎯⏰💰📝📋📌🚗🕰💎🕹📢🔹🔸🔴✨👥🙋🟢🔍💵⚠🏠✈👶🧾🖥🗺🚹🧩▫▪️]+"
DECORATION = r"^[^\p{L}\p{N}]+$"
TAG = r"(?iu)#[\w\x{0400}-\x{04FF}\x{2019}\x{02BB}\x{02BC}]+"
ANY = "(?iuU)"
QUOTED = "(?U)(?<![\\p{L}\\p{N}_])[\"'“«]([^\"'”»]+)[\"'”»](?![\\p{L}\\p{N}_])"
GENERIC_HEADINGS = [r"^(?:📢\s*)?(?:ishga|ишга)\s+taklif!?$", r"^(?:📢\s*)?(?:ishga|ишга)\s+taklif\s+qil(?:inadi|amiz|adi)?!?$", r"^(?:📢\s*)?вакансия!?$", r"^ish\s+qidiryapsizmi", r"^urganch\s+shaxrida$", r"^toshkentdan\s+gapiramiz$"]
SIGNALS = [
    r"\b(?:ish\s+lavozimi|ish\s+lavozimlari|vakansiya|вакансиялар)\b", r"(?:ishga|ишга)\s+(?:taklif|qabul)", r"ишга\s+(?:таклиф|қабул|килади|қилади)", r"приглашает\s+на\s+работу", r"we\s+are\s+hiring",
    r"\b(?:kerak|talab\s+etiladi|qidirmoqda|izlayapmiz)\b", r"qabul\s+qilmoqda", r"\b(?:керак|лавозим|маош|манзил|мурожаат|телефон|тел)\b", r"\b(?:талаблар|иш\s+тартиби|иш\s+ўринлари|иш\s+уринлари)\b",
    r"\b(?:требования|контакт|контакты|заработанная\s+плата|адрес)\b", r"\b(?:requirements|salary|contact|address)\b", r"\b(?:maosh|oylik|ish\s+haqi|kunlik)\b", r"\b(?:manzil|hudud|murojaat|telefon|tel|aloqa)\b",
]
# Letters and digits alone are words here; marks and joiners (as in joined emoji) are not.
LEAD = r"^(?:[^\p{L}\p{N}]+\s*)?"
TITLES = [LEAD + r"(?:ish\s+lavozimi|vakansiya|ish\s+o['’`]?rni|bo['’`]?sh\s+ish\s+o['’`]?rni)\s*[:\-]\s*(.*)$", LEAD + r"вакансиялар?\s*[:\-]\s*(.*)$", LEAD + r"(?:лавозим|должность)\s*[:\-]\s*(.*)$"]
LISTS = [LEAD + r"(?:ish\s+lavozimlari|bo['’`]?sh\s+ish\s+o['’`]?rinlari|vakansiyalar)\s*[:\-]?\s*(.*)$", LEAD + r"bo['’`]?sh\s+ish\s+o['’`]?rinlari", LEAD + r"вакансиялар", r"по\s+следующим\s+вакансиям"]
COMPANY_FIELDS = [LEAD + r"(?:ish\s+beruvchi|kompaniya|kompaniyamiz|korxona|brend)\s*[:\-]\s*(.+)$", LEAD + r"ish\s+joyi\s*[:\-]\s*(.+)$", LEAD + r"(?:компания|бренд)\s*[:\-]\s*(.+)$"]
ADDRESSES = [LEAD + r"(?:manzil|офис\s+манзили|адрес)\s*[:\-]?\s*(.*)$", LEAD + r"ish\s+joyi\s*[:\-]\s*(.*)$", LEAD + r"манзил\s*[:\-]?\s*(.*)$"]
REGIONS = [LEAD + r"hudud\s*[:\-]?\s*(.*)$", LEAD + r"худуд\s*[:\-]?\s*(.*)$"]
LANDMARKS = [LEAD + r"(?:mo['’‘`]?ljal|marshrut)\s*[:\-]?\s*(.*)$", LEAD + r"мулжал\s*[:\-]?\s*(.*)$"]
SALARIES = [LEAD + r"(?:maosh|oylik(?:\s+maosh(?:i)?)?|ish\s+haqi(?:\s+va\s+motivatsiya)?|ish\s+haqi|kunlik)\s*[:\-]?\s*(.*)$", LEAD + r"(?:маош|ойлик(?:\s+маош(?:и)?)?|иш\s+хаки|иш\s+ҳақи|заработанная\s+плата)\s*[:\-]?\s*(.*)$"]
BRANCH = r"^(.+?)\s+filialiga\s*:?\s*$"
TO = "ga|ka|qa|iga|lariga|siga|га|ка|қа|ига|ларга|сига"
INVITED_TO = rf"^(.+?(?:{TO}))\s+(?:ishga\s+|ишга\s+)?(?:taklif\s+et(?:adi|amiz)|taklif\s+qil(?:adi|amiz|inadi|moqda)|qabul\s+qil(?:adi|moqda|inadi)|qabul\s+qilin(?:adi|amiz|moqda))\b"
OFFERS = r"^(.+?)\s+(?:sizga\s+)?bo['’`]sh\s+ish\s+o['’`]rinlarini\s+taklif\s+etadi\b"
NAMED_PLACE = rf"^(?:yangi\s+)?(.+?\b(?:restoran|restorant|kafe|cafe|bar|resto\s*bar|club|pub|do['’`]?kon|market|gipermarket|klinika|markaz|bog['’`]cha|maktab|korxona))(?:{TO})?$"
INVITATION = r"^(?:📢\s*)?(?:(?:ishga|ишга)\s+taklif(?:\s+qilin(?:adi|amiz|moqda)|\s+qil(?:adi|amiz)|\s+etamiz)?|(?:ishga|ишга)\s+qabul\s+qilin(?:adi|amiz|moqda))[^\p{L}\p{N}_]*$"
CALLS = r"taklif\s+qilin(?:adi|amiz|moqda|gan)|taflik\s+qilin(?:adi|amiz|moqda|gan)|taklif\s+qil(?:adi|amiz)|taflik\s+qil(?:adi|amiz)|taklif\s+etamiz|qabul\s+qilin(?:adi|amiz|moqda)|qabul\s+qilmoqda|таклиф\s+қил(?:ади|амиз)|таклиф\s+кил(?:ади|амиз)|қабул\s+қилин(?:ади|амиз)|қабул\s+килин(?:ади|амиз)|kerak|керак|qidirmoqda|izlayapmiz"
ROLE_AT, ROLE_ALONE = rf"^(.+?)(?:{TO})\s+(.+?)\s+(?:ishga\s+|ишга\s+)?(?:{CALLS})", rf"^(.+?)\s+(?:ishga\s+|ишга\s+)?(?:{CALLS}|talab\s+etiladi)"
RUSSIAN = r"^(.+?)\s+(?:с[^\s]*\s+)?(?:радостью\s+сообщает\s+о\s+наборе|ищет|приглашает\s+на\s+работу|қидиряпди|қидирмокда)\s+(.+?)(?:[.!]|$)"
ENGLISH = r"^we\s+are\s+hiring(?:\s+full[- ]time)?\s+(.+?)(?:[.!]|$)"
PLACES = r"\b(?:shahar|shahri|tumani|viloyat|ko['’`]cha|ko['’`]chasi|yo['’`]li|yoni|ro['’`]parasi|market|baza|mahalla|blok|massiv|gaz|stadion|maktab|bog['’`]?cha|bog['’`]ot|urganch|xonqa|gurlan|hazorasp|shovot|to['’`]rtko['’`]l|beruniy|toshkent|шахар|туман|вилоят|кучаси|йони|ропараси|манзил|турткуль)\b"
ROLES = (
    r"\b(?:menejer|menedjer|operator|kassir|ofitsiant|oshpaz|barista|povar\w*|povr\w*|xodim|ishchi|ishchilar|agent|savdo|sotuvchi|supervayzer|buxgalter|dizayner|xostes|yordamchi|marketolog|marketing|tarbiyachi|o['’`]qituvchi|"
    r"psixolog|shartnoma|xo['’`]jalik|bo['’`]lim(?:i|iga)?|mijozlar\s+bilan\s+ishlash|omborchi|ombor\s+mudiri|sklad|moykachi|uborkachi|kliner|tozalovchi|xamirchi|haydovchi|dastavshik|dostavshik|tur\s+agent|kompyuterchi|mebelchi|"
    r"enaga|reklama\s+tarqatish\s+mutaxassisi|servis\s+menedjeri|call\s+sentra\s+operator|yuk\s+tashuvchi|support\s+teachers?|teacher|logist|dispatch|dispatcher|hr-?specialist|assistant|супервайзер|бухгалтер|хисобчи|ҳисобчи|"
    r"оператор|кассир|повар|бариста|официант|кондитер|мойщица|доставшик|логист|диспетчир|ассистент|hr-специалист|савдо\s+вакили|менежер|ходими|учител)\b"
)
SUMMARIES = r"\b(?:ish\s+bor|ishga\s+taklif|ishga\s+qabul|kerak|qidirmoqda|izlayapmiz|талаб\s+этилади|иш\s+бор)\b"
TARGETS = r"\b(?:yigit(?:lar|larni)?|qiz(?:lar|larni)?|ayol(?:lar|larni)?|erkak(?:lar|larni)?|talaba(?:lar|larni)?|xodim(?:lar|larni)?)\b"


@dataclass(frozen=True)
class City:
    """What the notices of a city's channel have of their own: phrases that are no vacancies, more labels, and links to leave out."""

    phrases: tuple[str, ...] = ()
    salaries: tuple[str, ...] = ()
    addresses: tuple[str, ...] = ()
    free_places: tuple[str, ...] = ()
    invitation_links: str | None = None


# Fixed values of two city channels, and of city channels in general.
CITIES = {
    "ishchi_bor_kerak_toshkent": City(
        ("android va ios uchun o'z dasturimizni chiqardik", "playmarket va appstore orqali yuklab oling", "ish beruvchimiz o'zlariga kereli bo'gan ishchilarni", "ish beruvchimiz o'zlariga kereli bo'lgan ishchilarni"),
        invitation_links="asosiy kanal",
    ),
    "ishbor_toshkent_kerak_ishchi_bor": City(
        ("uyda o'tirgan holda ishlashga taklif qilaman", "faberlic emas", "oriflame emas", "online daromad", "kapital depazit kiritmaysiz", "telegram orqali yuklarni bog'laysiz", "kursimga 70% chegirma"),
        (LEAD + r"(?:daromad|to['’`]?lov|tolov|ish\s+haqqi|ish\s+xaqqi)\s*[:\-]?\s*(.*)$",), (LEAD + r"(?:adres|address)\s*[:\-]?\s*(.*)$",), ("hududni o'zingiz belgilaysiz", "hududni o'zingiz tanlaysiz"),
    ),
}
CITY_COMPANIES = [*COMPANIES, "trading", "logistics", "logistic", "tsex", "sex", "sklad", "ombor", "zavod", "fabrika", "factory", "ishlab chiqarish", "savdo markazi", "savdo uyi", "distrib", "distribut", "taxi", "yandex", "clinic", "hotel"]
CITY_TITLES = [*TITLES, LEAD + r"(?:bo['’`]?sh\s+ish\s+o['’`]?rni|rol|position)\s*[:\-]?\s*(.*)$"]
DIRECT = r"^(.+?(?:kompaniyasi|kompaniya|firmasi|korxonasi|zavodi|markazi|tsexi|sexi|skladi|ombori|restorani|kafesi|kafe|hotel|trading|logistics|logistic|taxi|market|mchj))\s*(.+?)?\s*(?:ishga\s+|ишга\s+)?(?:taklif\s+qil(?:adi|amiz)|taklif\s+et(?:adi|amiz)|qabul\s+qil(?:adi|amiz|inadi)|qabul\s+qilin(?:adi|amiz))"
CASES = {
    "kompaniyasiga": "kompaniyasi", "kompaniyaga": "kompaniya", "firmasiga": "firmasi", "firmaga": "firma", "korxonasiga": "korxonasi", "korxonaga": "korxona", "markaziga": "markazi", "markazga": "markaz", "filialiga": "filiali",
    "filiallariga": "filiallari", "bo'limiga": "bo'limi", "tsexiga": "tsexi", "sexiga": "sexi", "zavodiga": "zavodi", "skladiga": "skladi", "ofisiga": "ofisi", "offisiga": "offisi", "restoraniga": "restorani", "kafega": "kafe", "og'chasiga": "bog'chasi",
}
#: Endings that a lazy pattern may have cut off: (the case in the line, the name's end, what is put back).
PUT_BACK = [("kompaniyasiga", "kompaniya", "si"), ("firmasiga", "firma", "si"), ("korxonasiga", "korxona", "si"), ("markaziga", "markaz", "i"), ("zavodiga", "zavod", "i"), ("tsexiga", "tsex", "i"), ("sexiga", "sex", "i"), ("skladiga", "sklad", "i"), ("ofisiga", "ofis", "i")]
COMPACT = r"\s*[📍🔹🔸▪▫•]+\s*"
LATER = ["tel", "telegram", "murojaat", "aloqa"]


def matches(c: Column, *patterns: str) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(ANY + p)
    return out


def part(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, ANY + pattern, group)


def bare(c: Column) -> Column:
    """Without anything but letters and digits at the front, as city channels take a line and what stands behind a label."""
    return F.regexp_replace(c, r"^[^\p{L}\p{N}]+", "")


def plain(c: Column) -> Column:
    """Without symbols at the front."""
    return strip(F.regexp_replace(c, SYMBOLS, ""))


def ends(c: Column, marks: str = " -:;,.!") -> Column:
    inside = "[" + marks.replace("-", r"\-") + "]+"
    return F.regexp_replace(F.regexp_replace(c, r"\s{2,}", " "), f"^{inside}|{inside}$", "")


def begun(c: Column) -> Column:
    return F.regexp_replace(strip(F.regexp_replace(plain(c), BULLET, "")), r"\*{2,}", " ")


def heading_of(c: Column) -> Column:
    return ends(F.regexp_replace(begun(c), r"(?U)\s*[^\p{L}\p{N}_\x{0400}-\x{04FF}()]+$", ""))


def title_of(c: Column) -> Column:
    out = begun(c)
    for p in (
        r"^(?:bo['’`]?sh\s+ish\s+o['’`]?rinlari\s*[⬇️:]*)", r"^(?:ish\s+lavozimlari?\s*[:\-]?)", r"^(?:vakansiya\s*[:\-]?)", r"^(?:бизнинг\s+жамоамизга\s+)", r"^(?:корхонамиз\s+кенгая[^\s]*\s+сабабли\s+)",
        r"^(?:we\s+are\s+hiring(?:\s+full[- ]time)?\s+)", r"^.+?\bбуйича\s+иш\s+тажрибасига\s+эга\s+",
        r"\s+(?:ishga\s+|ишга\s+)?(?:taklif\s+et(?:adi|amiz)|taklif\s+qil(?:adi|amiz|inadi|moqda)|qabul\s+qil(?:adi|moqda|inadi)|qabul\s+qilin(?:adi|amiz|moqda))\b.*$",
        r"(?:ga|ka|qa|га|ка|қа)(?=\s*\()", r"(?:ga|ka|qa|га|ка|қа)$", r"\s*[^\p{L}\p{N}_\x{0400}-\x{04FF}()]+$",
    ):
        out = F.regexp_replace(out, ANY + p, "")
    return ends(out)


def company_of(c: Column) -> Column:
    return filled(ends(strip(F.regexp_replace(heading_of(c), ANY + "(?:ga|ka|qa|га|ка|қа)$", "")), " -:;,."))


def value_of(c: Column) -> Column:
    return ends(F.regexp_replace(plain(c), r"\*{2,}", " "), " -:;,.")


def is_phone(c: Column) -> Column:
    digits = lambda x: F.length(F.regexp_replace(x, r"\P{Nd}", ""))
    return let(value_of(c), lambda x: (x != "") & ~x.rlike(r"[A-Za-z\x{0400}-\x{04FF}]") & (digits(x) >= F.when(x.startswith("+"), 7).otherwise(9)))


def is_contact(c: Column) -> Column:
    return let(F.lower(plain(c)), lambda x: starts(x, CONTACTS) | is_phone(x) | x.startswith("@") | F.contains(x, F.lit("t.me/")) | x.startswith("http"))


def is_section(c: Column) -> Column:
    return starts(F.lower(plain(c)), SECTIONS)


def is_field(c: Column) -> Column:
    return matches(c, *COMPANY_FIELDS, *ADDRESSES, *REGIONS, *LANDMARKS, *SALARIES, *TITLES, *LISTS)


def is_vague(c: Column) -> Column:
    return F.lower(c).isin(BARE_TITLES) | (~matches(c, ROLES) & matches(c, TARGETS))


def read_line(line: Column) -> Column:
    """struct of a line: its text, cleaned forms, and what it is, each computed once."""

    def facts(title: Column) -> Column:
        low = F.lower(title)
        bullet = F.substring(line, 1, 1).isin([*LIST_BULLETS]) | line.rlike(r"^\s*\d+[.)]")
        hint, open_ = matches(title, ROLES), (title != "") & ~is_section(title) & ~is_contact(title) & ~matches(title, PLACES)
        noise = line.startswith("👉 @") | F.lower(line).isin(NOISE_LINES) | line.rlike(DECORATION)
        fine = open_ & (F.length(title) <= 80) & ~contains_any(low, PRAISE)
        words = F.regexp_extract_all(title, F.lit(r"([A-Za-z\x{0400}-\x{04FF}ʻ’'`\-]+)"), F.lit(1))
        capitals = (F.size(words) > 0) & (F.size(words) <= 4) & F.forall(words, lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}") | (F.upper(w) == w) & w.rlike(r"\p{Lu}"))
        priced = F.contains(title, F.lit(":")) & (contains_any(low, AMOUNTS) | title.rlike(r"\p{Nd}"))
        heads = open_ & ~is_field(title) & (F.length(title) <= 60) & ~starts(low, NO_HEADINGS) & ~priced & (hint | bullet & capitals)
        said = let(plain(line), lambda x: starts(F.lower(x), NOISE + FIELD_ONLY) | matches(x, *GENERIC_HEADINGS))
        return F.struct(
            line.alias("text"), title.alias("title"), heading_of(line).alias("heading"), bullet.alias("bullet"), noise.alias("noise"), (noise | said).alias("no_heading"), is_section(line).alias("section"),
            is_field(line).alias("field"), is_contact(line).alias("contact"), (fine & (bullet | hint)).alias("named"), (fine & hint & (bullet | (F.size(F.split(title, r"\s+")) <= 6) | (F.upper(title) == title))).alias("hinted"),
            heads.alias("heads"), matches(line, INVITATION).alias("invites"), matches(line, *LISTS).alias("lists"), ((F.size(F.split(line, r"\s+")) <= 6) & ~matches(line, PLACES)).alias("short"),
        )

    return let(title_of(line), facts)


def lines_from(at: Column) -> Column:
    return F.slice("_lines", at + 1, F.greatest(F.size("_lines") - at, F.lit(0)))


def found_at(test) -> Column:
    """The place of the first of eight lines that passes, or null."""
    return let(position(F.slice("_lines", 1, 8), test), lambda i: F.when(i < F.least(F.size("_lines"), F.lit(8)), i))


def marker() -> Column:
    """struct<at, listed> of the first of eight lines that invites, and whether a list of roles is announced by it."""

    def code(m: Column, i: Column) -> Column:
        low, before, next_ = F.lower(m.text), F.get(F.col("_lines"), i - 1), F.get(F.col("_lines"), i + 1)
        invites = F.contains(low, F.lit("ishga taklif")) | F.contains(low, F.lit("ishga qabul"))
        owner = F.coalesce((i > 0) & ~before.no_heading & contains_any(F.lower(before.text), COMPANIES), F.lit(False))
        return (
            F.when(F.contains(low, F.lit("quyidagi")) & invites, True).when(contains_any(low, PROMOTIONS), True).when(m.invites, owner)
            .when(invites & F.coalesce(next_.hinted, F.lit(False)), True)
        )

    codes = F.transform(F.slice("_lines", 1, 8), lambda m, i: F.struct(i.alias("at"), code(m, i).alias("listed")))
    return F.get(F.filter(codes, lambda x: x.listed.isNotNull()), F.lit(0))


def run_of_roles(at: Column, listed: bool) -> Column:
    """The first run of roles from a place on; where no list is announced only short lines may stand before it."""
    is_role = (lambda m: m.named & ~m.section & ~m.field) if listed else (lambda m: m.hinted & ~m.section & ~m.field)
    rows = F.filter(lines_from(at), lambda m: m.section | m.field | ~(m.noise | m.invites))

    def run(x: Column) -> Column:
        begin = position(x, is_role)
        free = F.lit(True) if listed else ~F.exists(F.slice(x, F.lit(1), begin), lambda m: ~m.section & ~m.field & ~m.short)
        roles = F.transform(take_until(F.slice(x, begin + 1, F.greatest(F.size(x) - begin, F.lit(0))), lambda m: ~is_role(m)), lambda m: m.title)
        return F.when(free, roles).otherwise(F.array().cast("array<string>"))

    return let(rows, run)


def heads_after(at: Column) -> Column:
    """Titles of lines from a place on that head a role of their own: a section, a field or a contact follows."""

    def one(m: Column, i: Column) -> Column:
        after = F.get(F.filter(lines_from(i + 1), lambda x: ~x.noise), F.lit(0))
        return F.when((i >= at) & m.heads & F.coalesce(after.section | after.field | after.contact, F.lit(False)), m.title)

    return F.array_compact(F.transform("_lines", one))


def field(patterns: list[str], salary: bool = False, front=lambda c: c) -> Column:
    """The value of the first labelled line with one: behind the label or, if nothing stands there, the next line; of a salary also the
    lines with amounts below. ``front`` takes off what stands at the front of a value."""
    value = lambda c: value_of(front(c))
    goes_on = lambda m: let(value(m.text), lambda x: (x != "") & ~is_phone(x) & (contains_any(F.lower(x), PAID) | x.rlike(r"\p{Nd}")))
    stops = lambda m: m.field | (m.section | m.contact | ~goes_on(m) if salary else F.lit(False))

    def values(m: Column, i: Column, pattern: str) -> Column:
        first = value(part(m.text, pattern))
        below = F.filter(lines_from(i + 1), lambda x: ~x.noise & (value(x.text) != ""))

        def of(rows: Column) -> Column:
            head = F.get(rows, F.lit(0))
            barred = (head.field | head.contact) if salary else head.field
            alone = F.when(F.coalesce(~barred, F.lit(False)), F.array(value(head.text))).otherwise(F.array().cast("array<string>"))
            more = lambda x: F.transform(take_until(x, stops), lambda y: value(y.text)) if salary else F.array().cast("array<string>")
            rest = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
            return F.when(first != "", F.concat(F.array(first), more(rows))).when(F.size(alone) > 0, F.concat(alone, more(rest))).otherwise(alone)

        return F.when(m.text.rlike(ANY + pattern), let(below, of))

    every = F.flatten(F.transform("_lines", lambda m, i: F.array(*(values(m, i, p) for p in patterns))))
    joined = let(F.get(F.filter(every, lambda x: x.isNotNull() & (F.size(x) > 0)), F.lit(0)), lambda x: F.array_join(F.array_distinct(x), "; "))
    if salary:
        whole = ends(F.replace(joined, F.lit("*"), F.lit("")), " -:;,.")
        joined = let(whole, lambda x: F.when(contains_any(F.lower(x), CURRENCY), F.regexp_replace(x, ANY + r"^(?:povr|povar|oshpaz|barista)\s+", "")).otherwise(x))
    return filled(ends(joined, " -:;,."))


def place_name(c: Column) -> Column:
    """The company that a heading consists of."""
    return let(strip(F.regexp_replace(heading_of(c), r"(?iu)^yangi\s+", "")), lambda x: F.when(matches(x, NAMED_PLACE), company_of(part(x, NAMED_PLACE))))


def company_in(m: Column) -> Column:
    line = m.text
    at_role, invited = company_of(part(line, ROLE_AT)), company_of(part(line, INVITED_TO))
    unsure = lambda x: matches(x, TARGETS) | contains_any(F.lower(x), ["ishga", "taklif"])
    return F.coalesce(
        F.when(line.rlike(QUOTED), company_of(F.regexp_extract(line, QUOTED, 1))), F.when(matches(line, OFFERS), company_of(part(line, OFFERS))), F.when(matches(line, ROLE_AT) & ~is_vague(title_of(part(line, ROLE_AT, 2))), at_role),
        F.when(matches(line, INVITED_TO) & ~unsure(invited), invited), place_name(line),
    )


def title_in(m: Column) -> Column:
    line, quoted = m.text, F.regexp_extract(m.text, QUOTED, 1)
    return F.when(~m.section & ~m.field, F.when(matches(line, ROLE_AT) | matches(line, ROLE_ALONE), m.heading).when(line.rlike(QUOTED) & matches(quoted, ROLES), title_of(quoted)).when(matches(line, RUSSIAN) | matches(plain(line), ENGLISH), m.heading))


def labelled_title(patterns: list[str] = TITLES, front=lambda c: c) -> Column:
    def one(m: Column, i: Column) -> Column:
        next_ = F.get(F.col("_lines"), i + 1).title
        below = F.when(F.coalesce(next_ != "", F.lit(False)) & ~is_field(next_), next_)
        return F.coalesce(*(F.when(m.text.rlike(ANY + p), F.coalesce(filled(title_of(front(part(m.text, p)))), below)) for p in patterns))

    return F.get(F.array_compact(F.transform("_lines", one)), F.lit(0))


def summary_title() -> Column:
    """A closing line that says what is offered, below three bullets or more, behind the company that the heading names."""
    rows = take_until(lines_from(F.col("_at") + 1), lambda m: m.field | m.section | m.contact)

    def of(x: Column) -> Column:
        at = position(x, lambda m: (m.heading != "") & ~m.noise & matches(m.heading, SUMMARIES) & matches(m.heading, ROLES))
        bullets = F.size(F.filter(F.slice(x, F.lit(1), at), lambda m: m.bullet))
        above = F.concat(F.array(F.get(F.col("_lines"), F.col("_at"))), F.slice(x, F.lit(1), at))
        named = F.filter(above, lambda m: ~m.noise & ~m.field & ~m.section & (m.heading != "") & ~F.lower(m.heading).isin(GREETINGS) & place_name(m.heading).isNotNull())
        context = heading_of(F.regexp_replace(F.get(named, F.lit(0)).heading, r"(?iu)^yangi\s+", ""))
        text = F.get(x, at).heading
        return F.when((at < F.size(x)) & (bullets >= 3), F.coalesce(heading_of(F.concat(context, F.lit(" "), text)), text))

    return let(rows, of)


def join_roles(roles: Column) -> Column:
    return let(F.array_distinct(nonempty(roles)), lambda r: F.when(F.size(r) > 5, F.concat(F.array_join(F.slice(r, 1, 5), " / "), F.lit(" +"), (F.size(r) - 5).cast("string"))).when(F.size(r) > 0, F.array_join(r, " / ")))


def read_city_line(city: City):
    """``read_line`` for a city's channel: all signs at the front of a line go before it is looked at."""
    labels = lambda c: matches(c, *city.addresses, *city.salaries, *COMPANY_FIELDS, *ADDRESSES, *REGIONS, *LANDMARKS, *SALARIES, *TITLES)

    def read(line: Column) -> Column:
        whole = lambda c: line.startswith("👉 @") | F.lower(line).isin(NOISE_LINES) | line.rlike(DECORATION)
        bullet = F.substring(line, 1, 1).isin([*LIST_BULLETS]) | line.rlike(r"^\s*\d+[.)]")

        def facts(m: Column) -> Column:
            named = m.named | (bullet & (m.title != "") & ~m.section & ~m.contact & ~matches(m.title, PLACES) & (F.length(m.title) <= 80) & ~contains_any(F.lower(m.title), PRAISE))
            hinted = m.hinted | (named & matches(m.title, ROLES) & bullet)
            return F.struct(
                line.alias("text"), m.title, m.heading, bullet.alias("bullet"), whole(line).alias("noise"), (whole(line) | m.no_heading).alias("no_heading"), m.section, labels(line).alias("field"), m.contact,
                named.alias("named"), hinted.alias("hinted"), m.heads, matches(line, INVITATION).alias("invites"), matches(line, *LISTS).alias("lists"), m.short,
            )

        return let(read_line(bare(line)), facts)

    return read


def city_company(line: Column, fragment: Column) -> Column:
    """A company's name in its base form; what a case ending of the line shows is put back."""
    out = heading_of(bare(fragment))
    for case, base in CASES.items():
        out = F.regexp_replace(out, rf"(?iuU)\b{case}\b", base)

    def whole(x: Column) -> Column:
        put = x
        for case, end, back in reversed(PUT_BACK):
            put = F.when(F.contains(F.lower(fragment), F.lit(case)) & F.lower(x).endswith(end), F.concat(x, F.lit(back))).otherwise(put)
        return put

    base = filled(ends(F.regexp_replace(let(out, whole), rf"(?iuU)(?:{TO})$", ""), " -:;,."))

    def again(x: Column) -> Column:
        put = x
        for case, end, back in reversed(PUT_BACK[:6]):
            put = F.when(F.contains(F.lower(line), F.lit(case)) & F.lower(x).endswith(end), F.concat(x, F.lit(back))).otherwise(put)
        return put

    return let(base, again)


def city_company_in(m: Column) -> Column:
    line = m.text

    def sure(company: Column, title: Column) -> Column:
        """A name that is known for one, or of three words and more that differ from the title."""
        vague = matches(company, TARGETS) | contains_any(F.lower(company), ["ishga", "taklif"])
        long = (F.size(F.split(company, r"\s+")) >= 3) & (F.coalesce(title, F.lit("")) != "") & ~F.contains(company, F.lit(",")) & (F.length(company) <= 60) & ~F.lower(company).startswith(F.lower(F.coalesce(title, F.lit("?"))))
        return F.when(~vague & (contains_any(F.lower(company), CITY_COMPANIES) | long), company)

    none = F.lit(None).cast("string")
    pick = lambda pattern, title: F.when(matches(line, pattern), let(city_company(line, part(line, pattern)), lambda x: sure(x, title)))
    return F.coalesce(
        F.when(line.rlike(QUOTED), city_company(line, F.regexp_extract(line, QUOTED, 1))), F.when(matches(line, OFFERS), city_company(line, part(line, OFFERS))),
        pick(DIRECT, title_of(bare(part(line, DIRECT, 2)))), pick(ROLE_AT, title_of(bare(part(line, ROLE_AT, 2)))), pick(INVITED_TO, none), let(place_name(bare(line)), lambda x: sure(x, none)),
    )


def city_title_in(m: Column) -> Column:
    line = m.text
    said = lambda pattern, group: let(title_of(bare(part(line, pattern, group))), lambda x: F.when((x != "") & ~is_vague(x), x).otherwise(m.heading))
    return F.when(~m.section & ~m.field, F.when(matches(line, ROLE_AT), said(ROLE_AT, 2)).when(matches(line, ROLE_ALONE), said(ROLE_ALONE, 1)))


def compact_roles(text: Column) -> Column:
    """The roles of a line that lists them behind signs, else the line's own."""
    several = F.size(F.regexp_extract_all(text, F.lit(COMPACT), F.lit(0))) >= 2
    return nonempty(F.when(several, F.transform(F.split(text, COMPACT), lambda x: title_of(bare(x)))).otherwise(F.array(title_of(bare(text)))))


def city_place(patterns: list[str]) -> Column:
    """The value of the first such label with the lines below it, up to a field, a section or a contact."""

    def values(m: Column, i: Column, pattern: str) -> Column:
        first = value_of(bare(part(m.text, pattern)))
        below = F.filter(lines_from(i + 1), lambda x: ~x.noise & (value_of(bare(x.text)) != ""))
        stops = lambda x, n: x.field | x.section | x.contact | (n & contains_any(F.lower(value_of(bare(x.text))), LATER))
        more = F.transform(take_until(below, lambda x: stops(x, F.lit(True) if pattern is None else first != "")), lambda x: value_of(bare(x.text)))
        return F.when(m.text.rlike(ANY + pattern), nonempty(F.concat(F.array(first), more)))

    every = F.flatten(F.transform("_lines", lambda m, i: F.array(*(values(m, i, p) for p in patterns))))
    return filled(ends(F.array_join(F.array_distinct(F.get(F.filter(every, lambda x: x.isNotNull() & (F.size(x) > 0)), F.lit(0))), "; "), " -:;,."))


def notices(messages: DataFrame, city: City | None = None) -> DataFrame:
    """Raw jobs of messages (text, url, date, contact_links, channel, source): a rule for ``Registry.register``.

    Messages without signs of a vacancy, with blocked phrases or another tag in their first four lines give none, nor do those
    without a title; all others give one. ``city`` takes what a city's channel has of its own. Staged in selects, without a shuffle; the rows are written before those without
    a title go, so that no filter is pushed into the expressions."""
    text = strip(F.regexp_replace(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\u00a0\u200b\ufe0f", "  "), r"\r\n?", "\n"), r"\n{3,}", "\n\n"))
    text = F.translate(text, "‘’ʻʼ`", "'" * 5) if city else text
    s = messages.withColumn("_text", text).withColumn("_low", F.lower("_text"))
    signs = sum((F.contains("_low", F.lit(x)).cast("int") for x in SIGNS), F.lit(0))
    wanted = ~contains_any(F.col("_low"), [*OTHER_PHRASES, *(city.phrases if city else ())]) & (matches(F.col("_text"), *SIGNALS) | (signs >= 3))
    s = s.withColumn("_texts", nonempty(F.transform(F.split("_text", "[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " ")))))
    tags = F.flatten(F.transform(F.slice("_texts", 1, 4), lambda x: F.regexp_extract_all(F.lower(x), F.lit(TAG), F.lit(0))))
    s = s.withColumn("_fine", wanted & ~F.arrays_overlap(tags, F.array(*map(F.lit, OTHER_TAGS))) & (F.size("_texts") > 0))
    s = s.withColumn("_lines", F.transform(F.when(F.col("_fine"), F.col("_texts")).otherwise(F.array().cast("array<string>")), read_city_line(city) if city else read_line))
    at = let(position(F.col("_lines"), lambda m: ~m.no_heading), lambda i: F.when(i < F.size("_lines"), i).otherwise(0))
    s = s.withColumns({"_at": at, "_list": found_at(lambda m: m.lists), "_marker": marker()})
    s = s.withColumn("_head", F.get(F.col("_lines"), F.col("_at")))
    listed = F.coalesce("_list", F.when(F.col("_marker.listed"), F.col("_marker.at")))
    s = s.withColumn("_from", listed + 1)
    announced = F.concat(run_of_roles(F.col("_from"), True), heads_after(F.col("_from")))
    loose = run_of_roles(F.coalesce("_marker.at", "_at") + 1, False)
    # the heading, then the first six lines
    first = F.filter(F.slice("_lines", 1, 6), lambda m: ~m.noise & (m.text != F.col("_head.text")))
    s = s.withColumn("_roles", nonempty(F.array_distinct(F.when(F.col("_from").isNotNull(), announced).otherwise(loose)))).withColumn("_context", F.concat(F.array("_head"), first))
    if city:
        below = F.flatten(F.transform(F.slice("_lines", F.coalesce(F.col("_list"), F.lit(0)) + 2, F.lit(3)), lambda m: compact_roles(m.text)))
        spread = F.when(F.size("_roles") > 0, F.flatten(F.transform("_roles", compact_roles))).when(F.col("_list").isNotNull(), below).otherwise(F.col("_roles"))
        s = s.withColumn("_roles", F.array_distinct(spread))
        s = s.withColumn("_context", F.array_distinct(F.concat("_context", F.filter(F.slice("_lines", 1, 8), lambda m: ~m.noise))))
    front = bare if city else lambda c: c
    inline = F.flatten(F.transform("_lines", lambda m: F.array(*(F.when(m.text.rlike(ANY + p), filled(ends(heading_of(front(part(m.text, p))), " -:;,."))) for p in COMPANY_FIELDS))))
    inline = F.get(F.filter(inline, lambda x: x.isNotNull() & ~matches(x, PLACES)), F.lit(0))
    of_context = F.get(F.array_compact(F.transform(F.filter("_context", lambda m: ~m.field), city_company_in if city else company_in)), F.lit(0))
    branch = F.transform(F.slice("_lines", 1, 6), lambda m: let(plain(front(m.text)), lambda x: F.when(matches(x, BRANCH), filled(value_of(part(x, BRANCH))))))
    branch = F.get(F.filter(branch, lambda x: x.isNotNull() & ~contains_any(F.lower(x), COMPANIES)), F.lit(0))
    s = s.withColumns({
        "_company": F.coalesce(inline, of_context), "_label": labelled_title(CITY_TITLES, bare) if city else labelled_title(), "_summary": summary_title(),
        "_said": F.get(F.array_compact(F.transform("_context", city_title_in if city else title_in)), F.lit(0)),
        "_base": F.coalesce(city_place([*city.addresses, *ADDRESSES]), city_place(REGIONS), branch) if city else F.coalesce(field(ADDRESSES), field(REGIONS), branch),
        "_mark": city_place(LANDMARKS) if city else field(LANDMARKS), "_pay": field([*city.salaries, *SALARIES], True, bare) if city else field(SALARIES, True),
    })
    invited = F.coalesce(F.get(F.col("_lines"), F.col("_at") + 1).invites, F.lit(False))
    title = F.coalesce(
        "_label", F.when((F.size("_roles") != 1) & (F.size("_roles") > 0), join_roles(F.col("_roles"))), "_summary", join_roles(F.col("_roles")), F.when(invited, F.col("_head.title")), "_said",
        F.when(~F.col("_head.no_heading"), F.col("_head.title")),
    )
    base = F.when(~(contains_any(F.lower("_base"), CITY_COMPANIES if city else COMPANIES) & ~matches(F.col("_base"), PLACES)), F.col("_base"))
    s = s.withColumns({"_title": strip(title), "_place": base})
    place = F.when(F.col("_place").isNotNull() & F.col("_mark").isNotNull(), F.concat("_place", F.lit(" ("), "_mark", F.lit(")"))).otherwise(F.coalesce("_place", "_mark"))
    if city and city.free_places:
        free = F.get(F.filter(F.transform("_lines", lambda m: value_of(bare(m.text))), lambda x: contains_any(F.lower(x), city.free_places)), F.lit(0))
        place = F.coalesce(place, F.regexp_replace(free, r"[!.,]+$", ""))
    links = links_of(messages)
    if city and city.invitation_links:
        links = F.filter(links, lambda x: ~(x.startswith("https://t.me/+") & F.contains(F.lower("text"), F.lit(city.invitation_links))))
    out = s.select(
        F.col("_title").alias("title"), F.col("_company").alias("company"), F.col("_text").alias("description"), F.col("_pay").alias("salary"), place.alias("location"), "source", "url",
        F.coalesce("date", F.current_timestamp()).alias("posted_at"), links.alias("contact_links"), F.col("_fine"),
    )
    return written(out).where(F.col("_fine") & (F.coalesce("title", F.lit("")) != "")).drop("_fine")
