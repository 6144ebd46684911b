"""Operator 12: the language of texts by compression with a raw-content dictionary for each language."""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import held_out, scored
from .shared import slices, small_batches

LETTERS = regex.compile(r"\p{L}+")
UNKNOWN = "und"


def plain(text: str | None) -> bytes:
    """The words of letters in lower case with single blanks around them; nothing where there is no letter."""
    words = LETTERS.findall((text or "").lower())
    return f" {' '.join(words)} ".encode() if words else b""


def dictionaries(known: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int, size: int) -> dict[str, tuple[int, bytes]]:
    """For each language the number of its labelled rows and its dictionary: the ``size`` bytes of words that most texts hold
    among those with its ``rows`` smallest hashed ids, the commonest last (nearest to what is compressed)."""
    ids = known.select(F.col(lang_col).alias("lang_"), F.col(id_col).alias("id_")).where("lang_ is not null and id_ is not null")
    counts = {r.lang_: r.n for r in ids.groupBy("lang_").agg(F.count("*").alias("n")).collect()}
    # ids whose hash is small enough for twice as many rows, so that few meet to be ranked
    share = F.create_map(*(F.lit(y) for x, n in counts.items() for y in (x, min(1.0, 2 * rows / n)))) if counts else F.lit(None)
    ids = ids.withColumn("place", F.pmod(F.xxhash64("id_"), F.lit(1 << 30))).where(F.col("place") <= share[F.col("lang_")] * (1 << 30)) if counts else ids.withColumn("place", F.lit(0))
    turn = F.row_number().over(Window.partitionBy("lang_").orderBy("place", "id_"))
    chosen = ids.withColumn("turn", turn).where(F.col("turn") <= rows).select(F.col("lang_").alias("lang2"), F.col("id_").alias("id2")).distinct()
    texts = known.select(F.col(lang_col).alias("lang_"), F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    sample = texts.join(F.broadcast(chosen), (F.col("lang_") == F.col("lang2")) & (F.col("id_") == F.col("id2"))).select("lang_", "text_")

    def words(batches):
        for batch in batches:
            for part in slices(batch, "text_"):
                held = [(lang, w) for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for w in set(LETTERS.findall((text or "").lower()))]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], pa.string()) for i in (0, 1)], names=["lang", "word"])

    common = sample.mapInArrow(words, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n"))
    common = common.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("turn") <= size // 2)
    listed: dict[str, list[bytes]] = {}
    for r in common.orderBy("lang", "turn").collect():  # at most size / 2 words of each language
        listed.setdefault(r.lang, []).append(r.word.encode())
    out = {}
    for lang, n in sorted(counts.items()):
        kept, left = [], size - 1
        for word in listed.get(lang, []):
            if len(word) + 1 > left:
                break
            left -= len(word) + 1
            kept.append(word)
        if kept:
            out[lang] = n, b" " + b" ".join(reversed(kept)) + b" "
    return out


class Coder:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, held: dict[str, tuple[int, bytes]], level: int, piece: int):
        # of equal sizes the language with more labelled rows wins
        self.langs = sorted(held, key=lambda x: (-held[x][0], x))
        self.piece = piece
        self.coders = [self.coder(held[x][1], level) for x in self.langs]
        if len(self.coders) == 1:  # one language alone is held against no dictionary
            self.coders.append(zstd.ZstdCompressor(level=level, write_content_size=False))

    @staticmethod
    def coder(words: bytes, level: int) -> zstd.ZstdCompressor:
        words = zstd.ZstdCompressionDict(words, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        return zstd.ZstdCompressor(level=level, dict_data=words, write_content_size=False)

    def best(self, text: str | None) -> tuple[str, float]:
        """(language, margin): by how much of its size the second smallest is larger than the smallest."""
        raw = plain(text)
        if not raw or not self.langs:
            return UNKNOWN, 0.0
        cuts = [raw[i : i + self.piece] for i in range(0, len(raw), self.piece)]
        sizes = [sum(len(coder.compress(x)) for x in cuts) for coder in self.coders]
        first = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(x for i, x in enumerate(sizes) if i != first)
        return self.langs[min(first, len(self.langs) - 1)], max(0.0, (second - sizes[first]) / second)


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 2000, size: int = 32 << 10, level: int = 6, piece: int = 4096, margin: float = 0.02, folds: int = 5, fold: int = 0) -> DataFrame:
    """(id, held_out, lang_pred, score, accepted) for every row of ``docs``.

    Words (runs of letters, in lower case) of a whole text are compressed, in pieces of ``piece`` bytes, once with each
    language's zstandard dictionary; the smallest sum wins, of equal ones the language with more labelled rows. The
    score is the margin to the second, as a part of its size; ``accepted`` is false where it is under ``margin``.
    Dictionaries of ``size`` bytes are learnt from at most ``train_rows`` ids of each language outside the held-out
    fold; one row of work is a compression for each language.

    A null text and one without a letter get "und", score 0 and are not accepted; so does every text if no row is labelled.
    A null language teaches nothing; null ids are held out. Repeated rows are judged each; the language of a row is
    not looked at when it is judged. Only the named columns are read. An empty table gives an empty result."""
    small_batches(docs.sparkSession)
    known = docs.where(~held_out(id_col, folds, fold))
    words = docs.sparkSession.sparkContext.broadcast(dictionaries(known, id_col, text_col, lang_col, train_rows, size))
    coders: list[Coder] = []

    def judge(column):
        if not coders:
            coders.append(Coder(words.value, level, piece))
        found = [coders[0].best(text) for text in column.to_pylist()]
        return [x[0] for x in found], [x[1] for x in found], [x[1] >= margin for x in found]

    columns = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    out = scored(docs, id_col, text_col, columns, judge)
    return out.select(id_col, held_out(id_col, folds, fold).alias("held_out"), "lang_pred", "score", (F.col("accepted") & (F.col("lang_pred") != UNKNOWN)).alias("accepted"))
