"""Operator 8: token ids as length-delimited binary records with a separate offset index."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import U64, scratch, slices, small_batches, spans_in
from .tokens import CACHE, Bpe, PreTokens, loaded, pieces

#: One line of an index file: the frame's place in the data file, its length, and its number of ids.
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u4")])
MASK = 0xA282EAD8
#: First byte of a payload: whether the id is not null, and whether the token ids take 2 bytes each instead of 4.
HAS_ID, NARROW = 1, 2
#: Pieces that the library encodes in one call, as it holds far more than ids for each.
AT_ONCE = 4096


def masked(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant, so that checksums of data that hold checksums stay useful."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """u64 length, u32 masked checksum of the length, payload, u32 masked checksum of the payload; all little-endian."""
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def frames(stream):
    """The payloads of a stream of frames; raises ValueError where a checksum or a length is wrong."""
    while head := stream.read(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("damaged record header")
        (n,) = struct.unpack("<Q", head[:8])
        body = stream.read(n + 4)
        if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
            raise ValueError("damaged record")
        yield body[:n]


def parsed(payload: bytes) -> tuple[int | None, bytes]:
    """(id, token ids as u32, little-endian) of a payload."""
    flags, key = struct.unpack("<Bq", payload[:9])
    ids = payload[9:]
    return key if flags & HAS_ID else None, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if flags & NARROW else ids


class Encoder:
    """Token ids by the tokenizers library; ids of pre-tokens seen before come from a bounded memory."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.bpe, self.pre, self.library = Bpe(data), PreTokens(), Tokenizer.from_buffer(data)
        self.library.encode_special_tokens = False
        self.largest = max(self.library.get_vocab().values())
        self.forget()

    def forget(self):
        self.keys, self.place = np.zeros(0, U64), np.zeros(0, np.int64)
        self.offsets, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other with ``end`` after each; their number per text)."""
        cp, heads, rows, specials = pieces(column, self.bpe)
        n = len(column)
        if len(cp):
            starts = self.pre.starts(cp, heads)
            hashes, lens = self.pre.hashes(cp, starts)
            uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            at = self.learn(uniq, cp, starts[first], lens[first])[inverse]
            segment = np.searchsorted(heads, starts, "right") - 1
            begin, size, owner = self.offsets[at], self.sizes[at], rows[segment]
        else:
            begin = size = owner = segment = np.zeros(0, np.int64)
        # special ids and ends of texts come as further pieces, sorted in by row and segment
        extra = np.array([x for _, _, x in specials] + [end] * n, np.uint32)
        flat = np.concatenate((self.flat, extra))
        row = np.concatenate((owner, np.array([r for r, _, _ in specials], np.int64), np.arange(n)))
        before = np.concatenate((segment * 2 + 1, np.array([2 * s for _, s, _ in specials], np.int64), np.full(n, np.iinfo(np.int64).max)))
        begin = np.concatenate((begin, len(self.flat) + np.arange(len(extra))))
        size = np.concatenate((size, np.ones(len(extra), np.int64)))
        if len(specials) or n:
            order = np.lexsort((before, row))  # stable, so tokens of a segment and specials in a row keep their order
            row, begin, size = row[order], begin[order], size[order]
        return flat[spans_in(begin, size)], np.bincount(row, size, minlength=n).astype(np.int64)

    def learn(self, uniq, cp, starts, lens) -> np.ndarray:
        def look():
            at = np.minimum(np.searchsorted(self.keys, uniq), max(len(self.keys) - 1, 0))
            return at, self.keys[at] == uniq if len(self.keys) else np.zeros(len(uniq), bool)

        at, hit = look()
        new = np.flatnonzero(~hit)
        if len(new):
            if len(self.keys) + len(new) > CACHE:
                self.forget()
                new = np.arange(len(uniq))
            text = cp[spans_in(starts[new], lens[new])].tobytes().decode("utf-32-le")
            ends = np.cumsum(lens[new]).tolist()
            cut = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            ids = [x.ids for k in range(0, len(cut), AT_ONCE) for x in self.library.encode_batch_fast(cut[k : k + AT_ONCE], add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            offsets = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate((self.flat, np.fromiter((y for x in ids for y in x), np.uint32, int(size.sum()))))
            self.offsets, self.sizes = np.concatenate((self.offsets, offsets)), np.concatenate((self.sizes, size))
            where = np.searchsorted(self.keys, uniq[new])
            self.place = np.insert(self.place, where, len(self.place) + np.arange(len(new)))
            self.keys = np.insert(self.keys, where, uniq[new])
            at, _ = look()
        return self.place[at]


def write_records(docs: DataFrame, tokenizer: str, base: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Encode every text, write the ids of all rows in ascending order of ``id_col`` as binary records under ``base``
    (default: a new folder of the shared one), and return the manifest, one row per data file in order:
    (file, part, n_docs, n_tokens, n_bytes, start), start being the number of ids in all files before it.

    Each task sorts one range of ids and writes one data file and one index file under names of its own attempt; only
    files that the manifest names count, so tasks that are lost and run again leave no wrong records. Null or empty texts
    are the end id alone; null ids come first; rows with equal ids are written each, ordered by text; an empty table gives
    an empty manifest; other columns are ignored. A record's payload is a byte of flags, the id as i64
    and the token ids, as u16 where the vocabulary has at most 65,536 ids and as u32 elsewhere, little-endian."""
    spark = docs.sparkSession
    small_batches(spark)
    base = base or scratch(spark, "records")
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    schema = "file string, part int, n_docs long, n_tokens long, n_bytes long"

    def run(batches):
        encoder = loaded("encode", vocabulary.value, lambda: Encoder(vocabulary.value))
        out, name, lines, n_docs, n_tokens, at = None, "", [], 0, 0, 0
        part = TaskContext.get().partitionId()
        try:
            for batch in batches:
                for piece in slices(batch, "text_", 1 << 20):
                    if out is None:
                        where, root = pafs.FileSystem.from_uri(base)
                        where.create_dir(root, recursive=True)
                        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
                        out = where.open_output_stream(f"{name}.rec")
                    ids, sizes = encoder.encode(piece.column("text_"), end_id)
                    narrow = encoder.largest < 1 << 16 and end_id < 1 << 16
                    width = 2 if narrow else 4
                    raw, ends = ids.astype(f"<u{width}").tobytes(), (np.cumsum(sizes) * width).tolist()
                    framed = []
                    for key, a, b in zip(piece.column("id_").to_pylist(), [0, *ends[:-1]], ends, strict=True):
                        framed.append(frame(struct.pack("<Bq", HAS_ID * (key is not None) + NARROW * narrow, key or 0) + raw[a:b]))
                        lines.append((at, len(framed[-1]), (b - a) // width))
                        at += len(framed[-1])
                    out.write(b"".join(framed))
                    n_docs, n_tokens = n_docs + len(sizes), n_tokens + len(ids)
        finally:
            if out is not None:
                out.close()
        if out is not None:
            with where.open_output_stream(f"{name}.idx") as index:
                index.write(np.array(lines, INDEX).tobytes())
            yield pa.RecordBatch.from_pydict({"file": [name.removeprefix(root + "/")], "part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [at]})

    rows = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).cast("string").alias("text_"))
    ordered = rows.repartitionByRange("id_", F.xxhash64("text_")).sortWithinPartitions("id_", "text_")
    done = ordered.mapInArrow(run, schema).collect()  # one row for each file
    start, listed = 0, []
    for x in sorted(done, key=lambda x: x.part):
        listed.append((f"{base}/{x.file}", x.part, x.n_docs, x.n_tokens, x.n_bytes, start))
        start += x.n_tokens
    return spark.createDataFrame(listed, schema + ", start long")


def read_records(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The records of a manifest's files, one row each: (id, start, n_tokens, ids_crc32, ids). Checks every checksum."""
    spark = manifest.sparkSession
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                where, path = pafs.FileSystem.from_uri(f"{file}.rec")
                with where.open_input_stream(path, buffer_size=1 << 20) as f:
                    rows, size = [], 0
                    for payload in frames(f):
                        key, ids = parsed(payload)
                        rows.append((key, start, len(ids) // 4, zlib.crc32(ids), ids))
                        start, size = start + len(ids) // 4, size + len(ids)
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=schema.names)

    n = manifest.count()
    files = manifest.select("file", "start").repartition(max(1, min(n, spark.sparkContext.defaultParallelism * 4)))
    return files.mapInArrow(run, schema)


def read_record(file: str, k: int) -> np.ndarray:
    """The token ids of record ``k`` of a data file (named without .rec), found by its index: a read in any order."""
    where, path = pafs.FileSystem.from_uri(file)
    with where.open_input_file(f"{path}.idx") as index:
        line = np.frombuffer(index.read_at(INDEX.itemsize, k * INDEX.itemsize), INDEX)[0]
    with where.open_input_file(f"{path}.rec") as f:
        f.seek(int(line["offset"]))
        payload = next(frames(f))
    return np.frombuffer(parsed(payload)[1], "<u4")


def token_records(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, base: str | None = None) -> DataFrame:
    """Write the records and read them back: (id, start, n_tokens, ids_crc32, ids)."""
    return read_records(write_records(docs, tokenizer, base, id_col, text_col, end_id), id_col)


__all__ = ["frame", "frames", "read_record", "read_records", "token_records", "write_records"]
