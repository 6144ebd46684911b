"""Helpers that the training-data operators share: the shared scratch folder and numpy views of text columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master (as in tests)
    takes a new temporary folder, and a cluster is refused, as its executors would not see one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.postmill.scratch", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="postmill-")
        spark.conf.set("spark.postmill.scratch", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Written tables of one operator under names, so that those no longer needed can be deleted."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names; nothing may read them any more."""
        for path in [p for name in names for p in self.paths.pop(name, [])]:
            delete(self.spark, path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that go to Python, in rows and, where Spark knows the setting, in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without copying per row; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), at


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """Cut a batch into runs of rows with about ``most`` text bytes each (a longer text stands alone)."""
    _, at = utf8(batch.column(text))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = int(np.searchsorted(at, at[begin] + most, "right")) - 1
        end = min(max(end, begin + 1), n)
        yield batch.slice(begin, end - begin)
        begin = end


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit arrays."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int, first: int = 0) -> np.ndarray:
    """n pseudo-random unsigned 64-bit numbers, the same for a seed everywhere."""
    return mix((np.arange(first + 1, first + n + 1, dtype=U64)) * U64(0x9E3779B97F4A7C15) + U64(seed))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def spans_in(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i]+lens[i]-1, one after the other."""
    ends = np.cumsum(lens)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lens), lens)


class Words:
    """Words of a slice of texts as numpy arrays: hash, owning row, and byte range of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, is_word: np.ndarray, seed: int = 7):
        """is_word: 256 flags that say which bytes belong to words. data must be lower-cased if that matters."""
        lo, hi = int(at[0]), int(at[-1])
        part = data[lo:hi]
        at = at - lo
        inside = is_word[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        heads = at[:-1][at[:-1] < at[1:]]
        first[heads] = inside[heads]
        last[heads[1:] - 1] = inside[heads[1:] - 1]
        self.start = np.flatnonzero(first)
        self.len = np.flatnonzero(last) + 1 - self.start
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.n = np.bincount(self.row, minlength=len(at) - 1)
        self.part = part
        if len(self.start):
            keep = part[inside]  # the bytes of the words, one after the other
            begin = np.concatenate(([0], np.cumsum(self.len)[:-1]))
            pos = np.arange(len(keep)) - np.repeat(begin, self.len)
            a, r = stream(seed, int(self.len.max())) | U64(1), stream(seed + 1, 256)
            self.hash = mix(np.add.reduceat(r[keep] * a[pos], begin) + self.len.astype(U64))
        else:
            self.hash = np.zeros(0, U64)
