"""Operator 2: documents that hold windows of benchmark items, by a prefix-filtered join with exact verification.

DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: ASCII letters and digits and all characters beyond ASCII make words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle, and the most rows of a side that is broadcast (below about 40 MB).
SHINGLE, BROADCAST_ROWS = 3, 200_000


def words_of(text):
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def shingle_hashes(words, size: int):
    """Hashes of the runs of ``size`` words, in order of position."""
    at = F.sequence(F.lit(0), F.size(words) - size)
    one = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size)))
    return F.when(F.size(words) >= size, F.transform(at, one)).otherwise(F.array().cast("array<bigint>"))


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(window, items): each distinct run of ``window`` words of an item (a shorter item is one run) and the items that hold it,
    but for those with a null id, which cannot be named."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    runs = F.when(F.size("w") >= window, F.transform(F.sequence(F.lit(1), F.size("w") - window + 1), lambda i: F.slice("w", i, window))).otherwise(F.array("w"))
    return items.select("item", F.explode(runs).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def prefixes(docs: DataFrame, text_col: str, windows: DataFrame) -> list[tuple[int, DataFrame, int]]:
    """For each shingle size that occurs (3; fewer for shorter windows): (size, (h, offset, window, items), rows).

    A window that occurs in a document has all its shingles there, so joining one of them is enough; the one that is
    rarest over all documents is taken, and windows with a shingle that no document has drop out."""
    out = []
    for (size,) in sorted(windows.select(F.least(F.size("window"), F.lit(SHINGLE))).distinct().collect()):
        own = windows.where(F.least(F.size("window"), F.lit(SHINGLE)) == size)
        placed = own.select("window", "items", F.posexplode(shingle_hashes(F.col("window"), size)).alias("offset", "h"))
        known = written(placed.select("h").distinct(), "shingles")
        every = docs.select(words_of(F.col(text_col)).alias("w")).select(F.explode(shingle_hashes(F.col("w"), size)).alias("h"))
        counted = every.join(sized(known, known.count()), "h").groupBy("h").agg(F.count("*").alias("n"))
        best = placed.join(counted, "h", "left").groupBy("window", "items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("best"))
        rare = written(best.where("best.n > 0").select("best.h", "best.offset", "window", "items"), "prefixes")
        out.append((size, rare, rare.count()))
    return out


def found_windows(docs: DataFrame, id_col: str, text_col: str, windows: DataFrame) -> DataFrame:
    """(id_, th, start, end, items): every place of a window in a document, in words, end exclusive."""
    at = F.col("pos") - F.col("offset")
    size = F.size("window")
    base = docs.select(F.col(id_col).alias("id_"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), words_of(F.col(text_col)).alias("w"))
    parts = []
    for k, rare, rows in prefixes(docs, text_col, windows):
        if rows <= BROADCAST_ROWS:  # verified in the same pass, before anything is copied
            near = base.select("id_", "th", "w", F.posexplode(shingle_hashes(F.col("w"), k)).alias("pos", "h")).join(F.broadcast(rare), "h")
        else:
            places = base.select("id_", "th", F.size("w").alias("n"), F.posexplode(shingle_hashes(F.col("w"), k)).alias("pos", "h"))
            near = places.join(rare, "h").where((at >= 0) & (at + size <= F.col("n"))).drop("n")
            near = near.join(base.dropDuplicates(["id_", "th"]).withColumnsRenamed({"id_": "id2", "th": "th2"}), F.col("id_").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")))
        fits = (at >= 0) & (at + size <= F.size("w"))
        exact = F.slice("w", F.greatest(at, F.lit(0)) + 1, size) == F.col("window")
        parts.append(near.where(fits & exact).select("id_", "th", at.alias("start"), (at + size).alias("end"), "items"))
    out = None
    for part in parts:
        out = part if out is None else out.union(part)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    Windows of ``window`` words of the items are found by their rarest shingle, bounded by position and length, and
    verified word by word; a word inside any found window is hit. Null and empty texts have no words; items without
    words have no windows; those with a null id hit like any other, but are not listed; a null document id is a key like any other; rows that repeat an id and text get the
    same result each, rows that share an id with other texts their own. Equal windows of several items count for each of
    them. Only the named columns are read. Empty tables give no rows, or no hits."""
    base = docs.select(F.col(id_col).alias(id_col), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    windows = written(windows_of(benchmark, item_col, item_text_col, window), "windows")
    found = found_windows(docs, id_col, text_col, windows)
    if found is None:
        none = F.lit(0).cast("long")
        return base.select(id_col, "n_words", none.alias("n_hit"), none.alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))
    cover = lambda a, s: F.struct((a.hit + F.greatest(F.lit(0), s.end - F.greatest(s.start, a.reach))).alias("hit"), F.greatest(a.reach, s.end).alias("reach"))
    hits = found.groupBy("id_", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.select("id_", F.col("th").alias("th_"), F.aggregate("spans", zero, cover).hit.cast("long").alias("hit"), "items")
    joined = base.join(hits, base[id_col].eqNullSafe(hits["id_"]) & (base["th"] == hits["th_"]), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(id_col, "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.coalesce(F.col("hit") > 0, F.lit(False)).alias("contaminated"))
