"""Hashed word features of whole texts, as numpy arrays, for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import U64, Words, lower_ascii, mix, slices, small_batches, stream, utf8

_BYTES = np.arange(256)
#: Letters, digits and all bytes of characters beyond ASCII.
WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: All but ASCII white space.
VISIBLE = ~(((_BYTES >= 9) & (_BYTES <= 13)) | (_BYTES == 32))


def distinct(row: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of each pair that occurs, by row."""
    key, n = np.unique(row.astype(np.int64) << bits | bucket.astype(np.int64), return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), n


def prefixes(column: pa.Array, bits: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the lower-cased words and of their first 4, 5, 6 .. bytes (sizes), each once for a row."""
    data, at = utf8(column)
    words = Words(lower_ascii(data), at, WORD)
    rows, hashes = [words.row], [words.hash]
    for size in sizes:
        long = words.len > size
        start = words.start[long]
        if len(start):
            by = stream(17 + size, size) | U64(1)
            seen = np.zeros(len(start), U64)
            for i in range(size):
                seen += (words.part[start + i].astype(U64) + U64(1)) * by[i] * U64(0x9E3779B97F4A7C15)
                seen = mix(seen)
            rows.append(words.row[long])
            hashes.append(seen)
    row, bucket, _ = distinct(np.concatenate(rows), np.concatenate(hashes) >> U64(64 - bits), bits)
    return row, bucket


def ngrams(column: pa.Array, bits: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count, tokens of each row) of 1- to ``most``-grams of tokens, case kept.

    A token is a run of word bytes or a run of other visible bytes; one that repeats the token before it counts as "again"."""
    data, at = utf8(column)
    words, marks = Words(data, at, WORD), Words(data, at, VISIBLE & ~WORD, seed=9)
    order = np.argsort(np.concatenate((words.start, marks.start)), kind="stable")
    row, token = np.concatenate((words.row, marks.row))[order], np.concatenate((words.hash, marks.hash))[order]
    same = np.zeros(len(token), bool)
    same[1:] = (token[1:] == token[:-1]) & (row[1:] == row[:-1])
    shown = np.where(same, U64(0xA9A1), token)
    rows, hashes, gram = [row], [shown], shown
    for n in range(1, most):
        gram = mix(gram[:-1] * U64(0x9E3779B97F4A7C15) + shown[n:])
        inside = row[n:] == row[: len(row) - n] if len(row) > n else np.zeros(0, bool)
        rows.append(row[n:][inside])
        hashes.append(gram[inside])
    r, b, n = distinct(np.concatenate(rows), np.concatenate(hashes) >> U64(64 - bits), bits)
    return r, b, n, words.n + marks.n


def scored(docs: DataFrame, id_col: str, text_col: str, columns: list, score, keep: tuple[str, ...] = ()) -> DataFrame:
    """One pass over the texts: score(text array) gives the arrays of ``columns`` (StructFields) for a slice of rows; the
    columns of ``keep`` come along."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *columns, *(docs.schema[c] for c in keep)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_"):
                yield pa.RecordBatch.from_arrays([part.column("id_"), *map(pa.array, score(part.column("text_"))), *(part.column(2 + i) for i in range(len(keep)))], names=schema.names)

    return docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"), *keep).mapInArrow(run, schema)


def held_out(id_col: str, folds: int, fold: int):
    """Whether a row belongs to the part that labels are not learnt from; a null id does."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def bounded(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """The ``most`` rows with the smallest hashes of their columns ``by``."""
    return rows.orderBy(F.xxhash64(*by), *by).limit(most)


def training_rows(docs: DataFrame, labels: DataFrame, label, id_col: str, text_col: str, most: int) -> DataFrame:
    """(label_, text_) of the labelled rows with the ``most`` smallest hashed ids: a bounded sample, so it may be broadcast.

    Where ids repeat in ``docs`` there are more rows; what a task makes of them has to be bounded again."""
    chosen = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id_"), label.alias("label_")).where(F.col("label_").isNotNull())
    chosen = chosen.orderBy(F.xxhash64("id_"), "id_", "label_").limit(most)
    texts = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    return texts.join(F.broadcast(chosen), "id_").select("label_", "text_")
