"""Operator 4: secrets in texts, told from copied examples by how many owners hold the same value.

DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: kind, pattern, group of the value, least characters of the value. Fixed values; the order is that of the kinds.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Further candidates, which count only if a single owner has them: long runs of mixed characters.
OWNED = ("owned", r"[A-Za-z0-9+_-]{20,}", 0, 20)
BLOCK = 256


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(lens: Column) -> Column:
    """The sum of the elements before each element; blocks keep the work in proportion to a long array's length."""
    add = lambda a, x: a + x
    total = lambda x: F.aggregate(x, F.lit(0), add)

    def place(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: total(F.slice(lens, b * BLOCK + 1, F.lit(BLOCK))))
        begins = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, x: F.struct((a.at + x).alias("at"), F.array_append(a["all"], a.at).alias("all"))).getField("all")
        one = lambda begin: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(begin, F.floor(i / BLOCK).cast("int")) + total(F.slice(lens, (F.floor(i / BLOCK) * BLOCK).cast("int") + 1, i % BLOCK)))
        return F.when(n > 0, let(begins, one)).otherwise(F.array().cast("array<int>"))

    return let(F.size(lens), place)


def matches(text: Column, no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, no, kind, end, value>> of the leftmost non-overlapping matches with a value of ``least`` characters.

    Positions come from the pieces between the matches: a match starts after all pieces and matches before it. Matches of
    one class of characters alone may ask for the least length at once, as shorter runs cannot hold a longer one."""
    if pattern.endswith("]+") and not group:
        pattern = f"{pattern[:-1]}{{{least - (4 if kind == 'access' else 0)},}}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(m: Column) -> Column:
        between = F.split(text, pattern, -1)
        lens = let(between, lambda g: F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0)))
        gaps = let(between, lambda g: F.transform(m, lambda x, i: F.length(F.get(g, i))))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
        both = F.arrays_zip(m.alias("m"), lens.alias("d"), gaps.alias("g"), values.alias("v"))
        placed = let(lens, lambda d: let(running(d), lambda r: let(both, lambda z: F.transform(z, lambda x, i: F.struct((F.get(r, i) + F.get(d, i)).alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), (F.get(r, i) + F.get(d, i) + F.length(x["m"])).alias("end"), x["v"].alias("value"))))))
        return F.filter(placed, lambda x: F.length(x.value) >= least)

    nothing = F.array().cast("array<struct<start:int,no:int,kind:string,end:int,value:string>>")
    return let(found, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(nothing))


def variety(value: Column) -> Column:
    """How many different characters a value has."""
    return F.size(F.array_distinct(F.split(value, "")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_cols: tuple[str, ...] = ("source",), repository_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = 3, example_repositories: int = 4) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples, most_owners, most_repositories) for every row of ``docs``.

    Base spans are found by pattern in every whole text. Values of all candidates are counted over the corpus by the
    distinct owners and repositories that hold them. A value of ``example_owners`` owners or ``example_repositories``
    repositories or more is a copied example, also if one owner holds them all; another of a single owner with a digit and 8 or
    more different characters looks live. Long runs of mixed letters and digits outside base spans are added as spans of
    kind "owned" if a single owner has them and they are no examples. The last columns are the greatest counts among the
    candidates of a text (0 without one).

    Null and empty texts have no spans. Null ids are keys like any other; rows that repeat an id and text get the same
    result each. Null owners count as one owner. Positions are code points, ends exclusive. Only the named columns are
    read. An empty table gives an empty result."""
    text = F.col("text_")
    base = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_"), F.to_json(F.array(*(F.col(c).cast("string") for c in owner_cols))).alias("owner"), F.to_json(F.array(*(F.col(c).cast("string") for c in repository_cols))).alias("repository"))
    mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]") & (variety(v) >= 12)
    found = F.concat(*(matches(text, i, *rule) for i, rule in enumerate(BASE)))
    more = lambda b: F.filter(matches(text, len(BASE), *OWNED), lambda x: mixed(x.value) & ~F.exists(b, lambda y: (x.start < y.end) & (y.start < x.end)))
    scanned = base.select("id_", F.xxhash64("text_").alias("th"), "owner", "repository", let(found, lambda b: F.struct(b.alias("base"), more(b).alias("more"))).alias("s"))
    scanned = written(scanned.select("id_", "th", "owner", "repository", "s.base", "s.more"), "candidates")
    every = scanned.select("id_", "th", "owner", "repository", F.explode(F.concat("base", "more")).alias("x")).select("*", F.sha2("x.value", 256).alias("h"))
    # repeated values shrink to one row for each holder in every task before anything is shuffled
    held = every.groupBy("h", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = held.groupBy("h", "owner").agg(F.count("*").alias("repositories")).groupBy("h").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    judged = every.select("id_", "th", "x", "h").join(owners, "h")
    example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    own = (F.col("owners") == 1) & ~example
    live = own & F.col("x.value").rlike("[0-9]") & (variety(F.col("x.value")) >= 8)
    by_text = judged.groupBy("id_", "th").agg(
        F.collect_set(F.when((F.col("x.no") == len(BASE)) & own, F.col("x"))).alias("added"),
        F.count_if(live).alias("live"), F.count_if(example).alias("examples"), F.count("*").alias("all"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"),
    )
    by_text = by_text.withColumnsRenamed({"id_": "id2", "th": "th2"})
    out = scanned.join(by_text, scanned["id_"].eqNullSafe(by_text["id2"]) & (scanned["th"] == by_text["th2"]), "left")
    each = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    times = F.greatest(F.col("all") / F.size(F.concat("base", "more")), F.lit(1))  # rows that repeat an id and text share their sums
    return out.select(F.col("id_").alias(id_col), *(each(rule[0]) for rule in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))).alias("spans"), F.coalesce((F.col("live") / times).cast("long"), F.lit(0).cast("long")).alias("n_live"), F.coalesce((F.col("examples") / times).cast("long"), F.lit(0).cast("long")).alias("n_examples"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("most_owners", "most_repositories")))
