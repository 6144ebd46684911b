"""Operators 3 and 8's common part: byte-level BPE on ragged numpy arrays, and token counts."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import U64, mix, slices, small_batches, spans_in, stream, utf8

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
NONE = np.iinfo(np.int32).max
#: Distinct pre-tokens that a worker remembers before it starts afresh.
CACHE = 1 << 21


class PreTokens:
    """The byte-level pre-tokenizer (contractions, optional space + letters | digits | others, white space) by array operations."""

    def __init__(self):
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kind = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                # positions past the surrogates are shifted by their number
                self.kind[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        self.kind[0xD800:0xE000] = OTHER
        self.random = stream(11, 0x110000)

    def starts(self, cp: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where tokens start in the code points; heads: where (non-empty) texts start."""
        n, kind = len(cp), self.kind[cp]
        head = np.zeros(n, bool)
        head[heads] = True
        run = np.ones(n, bool)
        run[1:] = kind[1:] != kind[:-1]
        run |= head
        out = run.copy()
        after = np.flatnonzero(run[1:] & ~head[1:] & (kind[:-1] == SPACE)) + 1
        out[after - 1] = True
        out[after[cp[after - 1] == 0x20]] = False
        q = np.flatnonzero(cp[:-1] == 0x27) if n else np.zeros(0, int)
        q = q[out[q] & ~head[q + 1]]
        if len(q):
            one, two = cp[q + 1], np.where(q + 2 < n, cp[np.minimum(q + 2, n - 1)], 0)
            two = np.where((q + 2 < n) & head[np.minimum(q + 2, n - 1)], 0, two)
            size = np.isin(one, [ord(c) for c in "stmd"]) * 1
            size = np.where((np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))), 2, size)
            q, size = q[size > 0], size[size > 0]
            out[q + 1] = False
            end = q + 1 + size
            end = end[end < n]
            out[end[(kind[end] == LETTER) & ~run[end]]] = True
        return np.flatnonzero(out)

    def hashes(self, cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = np.diff(np.append(starts, len(cp)))
        pos = np.arange(len(cp)) - np.repeat(starts, lens)
        by = stream(13, int(lens.max())) | U64(1)
        return mix(np.add.reduceat(self.random[cp] * by[pos], starts) + lens.astype(U64)), lens


class Bpe:
    """A vocabulary as arrays, from a tokenizers JSON file of the byte-level BPE kind without normaliser."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without normaliser or prefix space is supported")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        vocab = model["vocab"]
        self.byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def merged(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence (ids: all sequences' bytes as symbols, one after the other; lens: none is 0).

        All sequences advance together: each round merges every occurrence of each sequence's lowest-ranked pair,
        from the left without overlap; sequences without a pair to merge leave with their count. Ranks are kept from round
        to round and looked up anew only beside merged pairs."""
        left, live = lens.copy(), np.arange(len(lens))
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        rank = np.full(len(ids), NONE, np.int32)
        rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[starts + lens - 1] = NONE
        while len(live):
            best = np.minimum.reduceat(rank, starts)
            take = rank == np.repeat(best, lens)
            take &= rank != NONE
            at = np.flatnonzero(take)
            fresh = np.ones(len(at), bool)
            fresh[1:] = at[1:] != at[:-1] + 1
            first = np.flatnonzero(fresh)
            offset = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            at = at[offset % 2 == 0]
            ids = ids.copy()
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            owner = np.searchsorted(starts, at, "right") - 1
            after = lens - np.bincount(owner, minlength=len(lens))
            left[live] = after
            going = (best != NONE) & (after > 1)
            keep &= np.repeat(going, lens)
            place = (np.cumsum(keep) - 1)[at[keep[at]]]
            ids, rank, lens, live = ids[keep], rank[keep], after[going], live[going]
            starts = np.concatenate(([0], np.cumsum(lens)[:-1])) if len(lens) else lens
            beside = np.unique(np.concatenate((place, place - 1)))
            beside = beside[(beside >= 0) & (beside + 1 < len(ids))]
            rank[beside] = self.ranks(ids[beside], ids[beside + 1])
            rank[starts + lens - 1] = NONE
        return left


_STATE: dict = {}


def loaded(kind: str, data: bytes, make):
    """One object of a kind per worker process and vocabulary."""
    key = (kind, hashlib.sha256(data).hexdigest())
    if key not in _STATE:
        _STATE[key] = make()
    return _STATE[key]


def pieces(column: pa.Array, bpe: Bpe) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(code points, starts of non-empty segments, their rows, [(row, number of segments before, special id)])."""
    texts = column.to_pylist()
    parts, rows, specials = [], [], []
    for row, text in enumerate(texts):
        if not text:
            continue
        if bpe.split is None or not any(s in text for s in bpe.special):
            parts.append(text)
            rows.append(row)
            continue
        at = 0
        for m in bpe.split.finditer(text):
            if m.start() > at:
                parts.append(text[at : m.start()])
                rows.append(row)
            specials.append((row, len(parts), bpe.special[m[0]]))
            at = m.end()
        if at < len(text):
            parts.append(text[at:])
            rows.append(row)
    cp = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    return cp, np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64) if len(lens) else np.zeros(0, np.int64), np.array(rows, np.int64), specials


class Counter:
    """Token counts of texts, with a bounded memory of the pre-tokens seen."""

    def __init__(self, data: bytes):
        self.bpe, self.pre = Bpe(data), PreTokens()
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)

    def count(self, column: pa.Array) -> np.ndarray:
        cp, heads, rows, specials = pieces(column, self.bpe)
        out = np.zeros(len(column), np.int64)
        for row, _, _ in specials:
            out[row] += 1
        if not len(cp):
            return out
        starts = self.pre.starts(cp, heads)
        hashes, lens = self.pre.hashes(cp, starts)
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        counts = self.known(uniq, cp, starts[first], lens[first])
        owner = rows[np.searchsorted(heads, starts, "right") - 1]
        return out + np.bincount(owner, counts[inverse], minlength=len(out)).astype(np.int64)

    def known(self, uniq, cp, starts, lens) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, uniq), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        out = np.zeros(len(uniq), np.int64)
        out[hit] = self.counts[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            cps = cp[spans_in(starts[new], lens[new])]
            data = np.frombuffer(cps.tobytes().decode("utf-32-le").encode(), np.uint8)
            width = 1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)
            size = np.add.reduceat(width, np.concatenate(([0], np.cumsum(lens[new])[:-1])))
            out[new] = self.bpe.merged(self.bpe.byte[data], size.astype(np.int64))
            if len(self.keys) + len(new) > CACHE:
                self.keys, self.counts = self.keys[:0], self.counts[:0]
                self.keys, self.counts = uniq[new], out[new]
            else:
                place = np.searchsorted(self.keys, uniq[new])
                self.keys, self.counts = np.insert(self.keys, place, uniq[new]), np.insert(self.counts, place, out[new])
        return out


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``; tokenizer: path of a byte-level BPE JSON file.

    Rank-synchronous array merging: pre-tokens of a slice of texts are ragged numpy arrays, and each round merges every
    sequence's lowest-ranked pair. Null and empty texts have 0 tokens; a null id stays null; repeated rows are counted
    each; other columns, whatever their names, are ignored; an empty table gives an empty result. No shuffle: one pass
    over the texts, in slices of about 2 MB (a longer text stands alone)."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        counter = loaded("count", vocabulary.value, lambda: Counter(vocabulary.value))
        for batch in batches:
            for part in slices(batch, "text_", 2 << 20):
                _, at = utf8(part.column("text_"))
                yield pa.RecordBatch.from_arrays([part.column("id_"), pa.array(np.diff(at)), pa.array(counter.count(part.column("text_")))], names=[id_col, "n_bytes", "n_tokens"])

    out = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_")).mapInArrow(run, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
