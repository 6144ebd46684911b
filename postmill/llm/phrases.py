"""Operator 11: collocations by multikey three-way quicksort of suffix pointers, routed by their leading words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import U64, Tables, Words, lower_ascii, mix, slices, small_batches, utf8

DEPTH = 4
#: Bits of the maps of frequent words and pairs that tasks hold (16 MB each, whatever the corpus).
MAP_BITS = 27
#: Suffixes that one sort takes; further groups of leading words go to the next.
CHUNK = 1 << 20
#: A leading pair with more than this part of all suffixes is split over several groups.
SHARE = 2000
UNKNOWN = "und"
# Marks that end a piece, and blanks between words.
MARKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
ENDS = np.isin(np.arange(256), np.frombuffer(MARKS, np.uint8))
WORD = ~ENDS & ~np.isin(np.arange(256), np.frombuffer(BLANKS, np.uint8))
STEP = U64(0x9E3779B97F4A7C15)
KEYS = ["a", "b", "c", "d"]


def positions(part: pa.RecordBatch, seed: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, ids, pieces) of a slice of texts: a word's id is a hash of it and of its language, never 0; words with the same
    number belong to the same piece of text."""
    data, at = utf8(part.column("text_"))
    words = Words(lower_ascii(data), at, WORD, seed)
    own = part.column("key_").to_numpy().view(U64)
    ids = np.maximum(mix(words.hash + mix(own)[words.row]), U64(1))
    return words, ids, np.cumsum(ENDS[words.part])[words.start] + words.row if len(ids) else np.zeros(0, np.int64)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * STEP + b)


class Bits:
    """A map of hashes: those that were put in are there, others hardly ever."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def at(self, h: np.ndarray) -> np.ndarray:
        bit = h >> U64(64 - MAP_BITS)
        return (self.words[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63)) & U64(1)).astype(bool)


def bits_of(spark, hashes: DataFrame):
    """The map of a column h, brought together as at most 2^(MAP_BITS - 6) numbers and sent to all executors."""
    one = hashes.select(F.shiftrightunsigned("h", 64 - MAP_BITS).alias("b")).selectExpr("shiftright(b, 6) AS at", "shiftleft(1L, cast(b & 63 AS int)) AS bit")
    found = one.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (MAP_BITS - 6), U64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(U64)
    return spark.sparkContext.broadcast(words)


def runs(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of the key columns, and how often each occurs."""
    if not len(keys[0]):
        return keys, np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    head = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
    at = np.flatnonzero(head)
    return [k[at] for k in keys], np.diff(np.append(at, len(head)))


def quicksort(suffixes: np.ndarray, weight: np.ndarray, least: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth from 1 to ``depth``, (pointers, weights): one suffix of every partition of suffixes that begin with
    the same words, and how much they weigh. Suffixes are rows of word ids, ended by 0.

    A partition is split by a pivot at its current word into less, equal and greater; the equal part is complete, so its
    weight is the phrase's count, and goes on at the next word. Parts that weigh less than ``least`` are abandoned, as
    nothing in them can weigh more. All partitions of one state are split together, in one pass over their pointers."""
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(depth)]
    order = np.arange(len(suffixes))
    start, level = np.zeros(1, np.int64) if len(order) else np.zeros(0, np.int64), np.zeros(1 if len(order) else 0, np.int64)
    turn = 0
    while len(start):
        turn += 1
        size = np.diff(np.append(start, len(order)))
        part = np.repeat(np.arange(len(start)), size)
        word = suffixes[order, level[part]]
        # the median of three places; they move on in every round
        three = np.stack([word[start + (size * k // 4 + turn * k) % size] for k in (1, 2, 3)])
        pivot = np.sort(three, axis=0)[1]
        side = np.where(word < pivot[part], 0, np.where(word == pivot[part], 1, 2))
        group = part * 3 + side
        moved = np.argsort(group, kind="stable")
        order, group = order[moved], group[moved]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        mass = np.add.reduceat(weight[order], head)
        size = np.diff(np.append(head, len(order)))
        equal, at = group[head] % 3 == 1, level[group[head] // 3]
        ended = equal & (suffixes[order[head], at] == 0)
        done = equal & (mass >= least) & ~ended
        for k in range(depth):
            here = done & (at == k)
            out[k].append((order[head[here]], mass[here]))
        at = at + equal
        keep = (mass >= least) & ~ended & (at < depth)
        order = order[np.repeat(keep, size)]
        size, level = size[keep], at[keep]
        start = np.cumsum(size) - size
    return [tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for found in out]


def batch_of(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)) for x in columns], names=names.split())


def count_words(rows: DataFrame, seed: int) -> DataFrame:
    """(key, id, word, n): how often each word occurs in each language."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_"):
                words, ids, _ = positions(part, seed)
                if not len(ids):
                    continue
                found, first, n = np.unique(ids, return_index=True, return_counts=True)
                cuts = [words.part[a : a + k].tobytes() for a, k in zip(words.start[first].tolist(), words.len[first].tolist(), strict=True)]
                key = part.column("key_").to_numpy()[words.row[first]]
                yield batch_of("key id word n", key, found, pa.array(cuts, pa.binary()), n)

    return rows.mapInArrow(run, "key long, id long, word binary, n long").groupBy("key", "id", "word").agg(F.sum("n").alias("n"))


def count_pairs(rows: DataFrame, seed: int, frequent) -> DataFrame:
    """(a, b, n): how often words that may be frequent follow each other within a piece."""

    def run(batches):
        words_map = Bits(frequent.value)
        for batch in batches:
            for part in slices(batch, "text_"):
                _, ids, piece = positions(part, seed)
                good = words_map.at(ids)
                at = np.flatnonzero(good[:-1] & good[1:] & (piece[1:] == piece[:-1])) if len(ids) else np.zeros(0, np.int64)
                (a, b), n = runs([ids[at], ids[at + 1]])
                yield batch_of("a b n", a, b, n)

    return rows.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def suffixes_of(rows: DataFrame, seed: int, pairs) -> DataFrame:
    """(a, b, c, d, n): suffixes of up to 4 words whose pairs may all be frequent (0 after the last such word), of 3 words at
    least; a task counts equal ones together."""

    def run(batches):
        pairs_map = Bits(pairs.value)
        for batch in batches:
            for part in slices(batch, "text_"):
                _, ids, piece = positions(part, seed)
                padded = np.append(ids, np.zeros(DEPTH, U64))
                good = np.zeros(len(ids) + DEPTH, bool)
                if len(ids) > 1:
                    good[: len(ids) - 1] = (piece[1:] == piece[:-1]) & pairs_map.at(pair_key(ids[:-1], ids[1:]))
                at = np.flatnonzero(good[: len(ids)] & good[1 : len(ids) + 1])
                fourth = np.where(good[at + 2], padded[at + 3], U64(0))
                found, n = runs([padded[at], padded[at + 1], padded[at + 2], fourth])
                yield batch_of("a b c d n", *found, n)

    return rows.mapInArrow(run, "a long, b long, c long, d long, n long")


def sorted_phrases(routed: DataFrame, least: int) -> DataFrame:
    """(a, b, c, d, n): counts of the phrases of 3 and 4 words of the suffixes (a, b, c, d, n, part, parts), which come by
    groups of leading words. A group that was split cannot abandon what is rare in one of its parts."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        size, broken = 0, None

        def work(columns: list[np.ndarray]):
            words, weight, split = np.stack(columns[:4], 1), columns[4], columns[5] > 1
            if broken is not None:
                split = split | np.logical_and.reduce([columns[i] == x for i, x in zip((0, 1, 6), broken, strict=True)])
            for rows, limit in ((split, 1), (~split, least)):
                if rows.any():
                    own = words[rows]
                    for k, (pointer, mass) in enumerate(quicksort(own, weight[rows], limit, DEPTH)):
                        if k >= 2 and len(pointer):
                            found = own[pointer].copy()
                            found[:, k + 1 :] = 0
                            yield batch_of("a b c d n", *found.T, mass)

        for batch in batches:
            columns = [batch.column(x).to_numpy() for x in (*KEYS, "n", "parts", "part")]
            held.append(columns)
            size += batch.num_rows
            if size >= CHUNK:  # cut where a group ends
                every = [np.concatenate(x) for x in zip(*held, strict=True)]
                same = (every[0] == every[0][-1]) & (every[1] == every[1][-1]) & (every[6] == every[6][-1])
                cut = size - int(same.sum())
                if not cut:  # a group too large for one sort is taken in parts
                    broken, cut = tuple(every[i][-1] for i in (0, 1, 6)), size
                yield from work([x[:cut] for x in every])
                held, size = [[x[cut:] for x in every]], size - cut
        if size:
            yield from work([np.concatenate(x) for x in zip(*held, strict=True)])

    ordered = routed.repartition("a", "b", "part").sortWithinPartitions("a", "b", "part")
    return ordered.mapInArrow(run, "a long, b long, c long, d long, n long")


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, top: int | None = 2000, inside: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the collocations of 2 to 4 words of each language (null: und), best first.

    1. Words are counted exactly, by language; a bounded map of the frequent ones (hashes, 16 MB) goes to all tasks, and so
       later does one of the frequent pairs: a phrase is frequent only if all its words and pairs are.
    2. Suffixes of up to 4 words are routed by their two leading words. A pair with over 1/SHARE of all suffixes is split
       by its further words. Each group is sorted by multikey three-way quicksort (``quicksort``), whose equal partitions
       give the counts; infrequent partitions are abandoned. Parts of split groups are added up afterwards.
    3. Each cut of a phrase in two looks up the counts of both parts; the lowest score counts, ties to the earliest cut.
       A phrase inside a longer one that has ``inside`` percent of its count is dropped. Only phrases that reach the
       score of rank ``top`` get their words, and ties among them are settled by these (``top`` None: all phrases).

    Word ids are 64-bit hashes; if two words of a language share one, the count starts over with other hashes. Null and
    empty texts have no words; very long ones are cut at words, not shortened. Repeated rows count each. Only the named columns are
    read. An empty table gives an empty result."""
    spark = docs.sparkSession
    tables = Tables(spark)
    small_batches(spark)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    rows = docs.select(F.xxhash64(lang).alias("key_"), F.col(text_col).cast("string").alias("text_")).where("text_ is not null")
    for seed in range(7, 7 + 100, 10):
        words = tables.write(count_words(rows, seed), "words")
        if not words.groupBy("key", "id").count().where("count > 1").limit(1).count():
            break
        tables.drop("words")
    totals = tables.write(words.groupBy("key").agg(F.sum("n").alias("n")), "totals")
    known = tables.write(words.where(F.col("n") >= least).select("key", "id", "word", "n"), "known")
    frequent = bits_of(spark, known.select(F.col("id").alias("h")))
    pairs = tables.write(count_pairs(rows, seed, frequent).where(F.col("n") >= least), "pairs")

    def hashed(batches):
        for batch in batches:
            yield batch_of("h", pair_key(batch.column("a").to_numpy().view(U64), batch.column("b").to_numpy().view(U64)))

    good = bits_of(spark, pairs.select("a", "b").mapInArrow(hashed, "h long"))
    every = pairs.agg(F.sum("n")).first()[0] or 0
    share = max(every // SHARE, 1)
    hot = pairs.where(F.col("n") > share).select("a", "b", F.ceil(F.col("n") / share).cast("long").alias("parts"))  # fewer than SHARE rows
    routed = suffixes_of(rows, seed, good).join(F.broadcast(hot), ["a", "b"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    routed = routed.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("c", "d"), "parts")).otherwise(0))
    longer = sorted_phrases(routed, least).groupBy(*KEYS).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    zero = F.lit(0).cast("long")
    phrases = tables.write(pairs.select("a", "b", zero.alias("c"), zero.alias("d"), "n").unionByName(longer), "phrases")

    # what each part of a cut counts
    size = F.when(F.col("c") == 0, 2).when(F.col("d") == 0, 3).otherwise(4)
    counts = phrases.where("d = 0").select(*(F.col(c).alias(f"{c}2") for c in KEYS), F.col("n").alias("m"))
    counts = counts.unionByName(known.select(F.col("id").alias("a2"), zero.alias("b2"), zero.alias("c2"), zero.alias("d2"), F.col("n").alias("m")))
    sized = phrases.withColumn("size", size)
    cuts = sized.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    listed = F.array(*KEYS)
    filled = lambda x: F.concat(x, F.array_repeat(zero, 4 - F.size(x)))
    both = F.array(filled(F.slice(listed, 1, F.col("cut"))), filled(F.slice(listed, F.col("cut") + 1, F.col("size") - F.col("cut"))))
    sides = cuts.select(*KEYS, "n", "size", "cut", F.posexplode(both).alias("side", "x"))
    sides = sides.select(*KEYS, "n", "size", "cut", "side", *(F.get("x", F.lit(i)).alias(f"{c}2") for i, c in enumerate(KEYS)))
    looked = sides.join(counts, [f"{c}2" for c in KEYS]).groupBy(*KEYS, "n", "size", "cut").agg(F.sum(F.when(F.col("side") == 0, F.col("m"))).alias("l"), F.sum(F.when(F.col("side") == 1, F.col("m"))).alias("r"))
    score = F.expr("(cast(n AS decimal(20, 0)) * 2000000BD) DIV cast(l + r AS decimal(20, 0))")
    scored = looked.withColumn("score", score).groupBy(*KEYS, "n", "size").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    # phrases of a longer one that has nearly their count
    parts = [(i, k) for k in (2, 3) for i in range(0, DEPTH - k + 1)]
    inner = F.filter(F.array(*(F.when(F.col("size") >= i + k + (i == 0), F.array(*(F.col(KEYS[i + j]) if j < k else zero for j in range(DEPTH)))) for i, k in parts)), lambda x: x.isNotNull())
    held = sized.where("size > 2").select("n", F.explode(inner).alias("x")).select(*(F.get("x", F.lit(i)).alias(c) for i, c in enumerate(KEYS)), "n")
    held = held.groupBy(*KEYS).agg(F.max("n").alias("most"))
    free = scored.join(held, KEYS, "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("n") * inside))
    owner = known.select(F.col("id").alias("a"), "key")
    free = free.join(owner, "a").select("key", *KEYS, F.col("n").alias("a_"), F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.col("x.score").alias("score"))
    free = tables.write(free, "free")
    tables.drop("words", "pairs", "phrases")
    best = free
    if top:
        turn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.desc("a_")))
        bar = free.select("key", "score", "a_").withColumn("turn", turn).where(F.col("turn") <= top).groupBy("key").agg(F.min(F.struct("score", "a_")).alias("bar"))
        best = free.join(F.broadcast(bar), "key").where(F.struct("score", "a_") >= F.col("bar")).drop("bar")
    name = best.select("key", *KEYS, F.posexplode(F.filter(listed, lambda x: x != 0)).alias("at", "id")).join(known.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x.word.cast("string")), " ")
    best = best.join(name.groupBy(*KEYS).agg(phrase.alias("phrase")), KEYS).join(F.broadcast(totals), "key")
    langs = docs.select(F.xxhash64(lang).alias("key"), lang.alias("lang")).groupBy("key").agg(F.first("lang").alias("lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a_"), "phrase"))
    ranked = best.join(F.broadcast(langs), "key").withColumn("rank", rank.cast("long"))
    ranked = ranked.where(F.col("rank") <= top) if top else ranked
    return ranked.select("lang", "rank", "phrase", F.col("a_").alias("a"), "l", "r", "n", "score")
