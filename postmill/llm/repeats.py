"""Operator 10: removal of long byte strings that occur elsewhere, by suffix arrays built in two stages."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, Tables, mix, slices, small_batches, stream, utf8

#: Bytes of the strings that anchors are chosen by.
GRAM = 32
#: One gram in so many, chosen by hash, is counted over the corpus wherever it occurs.
THIN = 32
#: Distinct texts around one anchor that go into one suffix array; larger groups are first parted by what their strings share.
GROUP = 1024
#: Parts of the range of offsets that such a group is parted into at a time.
PARTS = 8
#: Bytes that go into one suffix array, about.
BLOCK = 1 << 18


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each position that has as many."""
    h = stream(41, 256)[data]
    step = 1
    while step < GRAM:
        h = mix(h[:-step] * U64(0x9E3779B97F4A7C15) + h[step:]) if len(h) > step else h[:0]
        step *= 2
    return h


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of grams of a text such that every ``length`` bytes hold one of them, chosen by content alone:
    the least hash of each window. Windows with equal bytes hold equal anchors."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = gram_hashes(data)
    width = length - GRAM + 1
    value, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < width:  # the least of ``span`` places, the last one on ties; spans double up to the width
        shift = min(span, width - span)
        right = value[shift:] <= value[: len(value) - shift]
        at = np.where(right, at[shift:], at[: len(at) - shift])
        value = np.minimum(value[shift:], value[: len(value) - shift])
        span += shift
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    pos = np.unique(at[new]).astype(np.int64)
    same = np.zeros(len(pos), bool)
    same[1:] = h[pos[1:]] == h[pos[:-1]]
    if same.any():  # of a periodic stretch only as many as every window needs
        keep, last = np.ones(len(pos), bool), 0
        for i in np.flatnonzero(same).tolist():
            if not same[i - 1]:
                last = int(pos[i - 1])
            if i + 1 < len(pos) and same[i + 1] and pos[i + 1] - last <= width:
                keep[i] = False
            else:
                last = int(pos[i])
        pos = pos[keep]
    return pos, h[pos]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of t (bytes + 1, 0 between texts and at the end) in order of their first ``depth`` symbols at least.

    Two stages: suffixes smaller than their successors are sorted directly; a scan over the buckets of first symbols then
    puts each larger one in place, right after its successor has been met. A bucket is scanned in waves, as it can hold
    predecessors of its own."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    next_ = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    small = (np.append(t, 0)[next_ + 1] > t) & (next_ < n - 1)
    raw = t.astype(">u2").tobytes() if t.max(initial=0) > 255 else t.astype(np.uint8).tobytes()
    unit = len(raw) // max(n, 1)
    direct = np.flatnonzero(small)
    keys = [raw[i * unit : (i + depth) * unit] for i in direct.tolist()]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)] if len(keys) else direct
    symbols = np.unique(t)
    heads = t[direct]
    sorted_part = {c: direct[a:z] for c, a, z in zip(symbols.tolist(), np.searchsorted(heads, symbols), np.searchsorted(heads, symbols, "right"), strict=True)}
    waiting: dict[int, list] = {c: [] for c in symbols.tolist()}
    waiting[int(t[-1])].append(np.array([n - 1]))
    out = []

    def deal(found: np.ndarray, own: int) -> list:
        before = found[found > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return []
        by = t[before]
        order = np.argsort(by, kind="stable")
        by, before = by[order], before[order]
        cuts = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
        again = []
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=True):
            (again if by[a] == own else waiting[int(by[a])]).append(before[a:z])
        return again

    for c in symbols.tolist():
        wave = waiting[c]
        while wave:
            found = np.concatenate(wave)
            out.append(found)
            wave = deal(found, c)
        if len(sorted_part[c]):
            out.append(sorted_part[c])
            deal(sorted_part[c], c)
    return np.concatenate(out)


def repeated_starts(texts: list[bytes], places: np.ndarray, several: np.ndarray, groups: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, the positions whose ``length`` bytes start at another place too, among texts of the same group.

    places: where each text starts, as one number for all texts of the table; several: whether it has further places."""
    lens = np.array([len(x) for x in texts])
    data = np.frombuffer(b"".join(x + b"\0" for x in texts), np.uint8)
    begin = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    t = data.astype(np.int16) + 1
    t[begin + lens] = 0
    owner = np.repeat(np.arange(len(texts)), lens + 1)
    left = (begin + lens)[owner] - np.arange(len(t))
    sa = suffix_array(t, length)
    sa = sa[left[sa] >= length]
    if not len(sa):
        return [np.zeros(0, np.int64) for _ in texts]
    words = np.zeros(len(t) + length, np.uint64)
    padded = np.append(data, np.zeros(length + 8, np.uint8)).astype(U64)
    for i in range(8):
        words |= padded[i : i + len(words)] << U64(56 - 8 * i)
    # common prefixes of neighbours, up to ``length``: whole words first, the last word overlapping the one before
    equal = np.arange(1, len(sa))
    for off in [*range(0, length - 7, 8), length - 8]:
        equal = equal[words[sa[equal] + off] == words[sa[equal - 1] + off]]
    joined = np.zeros(len(sa), bool)
    joined[equal] = True
    run = np.cumsum(~joined) - 1
    heads = np.flatnonzero(~joined)
    key = places[owner[sa]].astype(np.int64) + (sa - begin[owner[sa]])
    # one run of equal strings may span groups; only places of the same group are held against each other
    if len(np.unique(groups)) > 1:
        order = np.lexsort((groups[owner[sa]], run))
        sa, run, key = sa[order], run[order], key[order]
        g = groups[owner[sa]]
        joined = np.append(False, (run[1:] == run[:-1]) & (g[1:] == g[:-1]))
        run = np.cumsum(~joined) - 1
        heads = np.flatnonzero(~joined)
    many = (np.minimum.reduceat(key, heads) != np.maximum.reduceat(key, heads)) | np.logical_or.reduceat(several[owner[sa]], heads)
    hit = sa[many[run]]
    hit.sort()
    cuts = np.searchsorted(hit, np.append(begin, len(t)))
    return [hit[a:z] - b for a, z, b in zip(cuts[:-1], cuts[1:], begin, strict=True)]


def ranges(starts: np.ndarray, length: int) -> np.ndarray:
    """(n, 2): merged [begin, end) covered by strings of ``length`` bytes from the sorted starts."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.append(True, np.diff(starts) > length))
    return np.stack((starts[cut], starts[np.append(cut[1:] - 1, len(starts) - 1)] + length), 1)


def merged(spans: np.ndarray) -> np.ndarray:
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    cut = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack((spans[cut, 0], reach[np.append(cut[1:] - 1, len(spans) - 1)]), 1)


def kinds_of(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    """A batch of these columns from a list of rows, which may be empty."""
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, names.values(), strict=True)], names=list(names))


def digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for part in parts:
        h.update(len(part).to_bytes(4, "little") + part)
    return h.digest()


def parted(g: bytes, piece: bytes, at: list[int], lo: int, hi: int, length: int):
    """The parts of a piece, cut by how far before the anchor (at) its strings begin: lo .. hi, in PARTS ranges.

    (group, content, range, place of the anchor, begin, size) of each range in which the piece has strings. The strings of
    a range have some bytes in common; these are its group, so equal strings of two pieces are of one group again."""
    bounds = np.linspace(lo, hi + 1, min(PARTS, hi - lo + 1) + 1).astype(int).tolist()
    for k in at:
        for low, high in zip(bounds[:-1], (x - 1 for x in bounds[1:]), strict=True):
            if max(low, k + length - len(piece)) > min(high, k):
                continue
            begin, end = max(k - high, 0), min(k + length - low, len(piece))
            group = digest(g, low.to_bytes(4, "little"), piece[k - low : k + length - high])
            yield group, digest(piece[begin:end], (k - begin).to_bytes(4, "little")), low, high, k - begin, begin, end - begin


def part_groups(hot: DataFrame, length: int, first: bool) -> DataFrame:
    """(g, s, child_g, child_s, lo, hi, at, begin, size, place, other): each content of a large group, parted."""
    names = {"g": pa.binary(), "s": pa.binary(), "child_g": pa.binary(), "child_s": pa.binary(), "lo": pa.int32(), "hi": pa.int32(), "at": pa.int32(), "begin": pa.int32(), "size": pa.int32(), "place": pa.int64(), "other": pa.int64()}

    def run(batches):
        for batch in batches:
            rows = []
            for g, s, piece, at, lo, hi, place, other in zip(*(batch.column(x).to_pylist() for x in ("g", "s", "piece", "at", "lo", "hi", "place", "other")), strict=True):
                spots = [at]
                if first:  # a periodic text holds its anchor several times; its strings are then aligned by each of them
                    spots, gram, k = [], piece[at : at + GRAM], -1
                    while (k := piece.find(gram, k + 1)) >= 0:
                        spots.append(k)
                rows += [(g, s, a, b, low, high, k, begin, size, place + begin, other + begin) for a, b, low, high, k, begin, size in parted(g, piece, spots, lo, hi, length)]
            yield kinds_of(names, rows)

    return hot.mapInArrow(run, "g binary, s binary, child_g binary, child_s binary, lo int, hi int, at int, begin int, size int, place long, other long")


def sort_groups(near: DataFrame, length: int) -> DataFrame:
    """(g, s, spans): what repeats in the pieces of each group, as begin and end in turn, by suffix arrays of whole groups."""
    names = {"g": pa.binary(), "s": pa.binary(), "spans": pa.list_(pa.int32())}

    def work(todo: list) -> pa.RecordBatch:
        g, s, place, other, piece = (list(x) for x in zip(*todo, strict=True))
        ids: dict[bytes, int] = {}
        group = np.array([ids.setdefault(x, len(ids)) for x in g])
        starts = repeated_starts(piece, np.array(place), np.array(place) != np.array(other), group, length)
        return kinds_of(names, [(a, b, ranges(hit, length).ravel().tolist()) for a, b, hit in zip(g, s, starts, strict=True) if len(hit)])

    def run(batches):
        todo, size = [], 0
        for batch in batches:
            for line in zip(*(batch.column(x).to_pylist() for x in ("g", "s", "place", "other", "piece")), strict=True):
                if size > BLOCK and line[0] != todo[-1][0]:
                    yield work(todo)
                    todo, size = [], 0
                todo.append(line)
                size += len(line[4])
        if todo:
            yield work(todo)

    return near.select("g", "s", "place", "other", "piece").repartition("g").sortWithinPartitions("g").mapInArrow(run, "g binary, s binary, spans array<int>")


def shifted(spans: DataFrame) -> DataFrame:
    """(g, s, spans) of the contents (g, s) from the spans of parts of them that begin at ``begin``, one list for each content."""
    moved = F.transform("spans", lambda x: x + F.col("begin"))
    return spans.groupBy("g", "s").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``; texts are bytes of UTF-8.

    1. Equal texts are one class; a class of several rows with ``length`` bytes or more is removed whole.
    2. Anchors, 32-byte strings chosen by content such that every ``length`` bytes hold one, are counted over the corpus.
       Two equal strings hold equal anchors, so only surroundings of anchors with two places or more can repeat.
    3. Its surroundings end at the next 32-byte string on either side that is known to occur once (one string in 32, by
       hash, is counted over the texts that are left); no repeated string can hold one. They are a group. Equal ones
       collapse to one with a mark that it has several places; a suffix array over the rest (sorted in two stages) and its
       common prefixes of neighbours give the repeats.
    4. Groups with over GROUP different surroundings (hot passages) are parted before: the strings that begin lo .. hi
       bytes before the anchor all hold the same bytes around it, so surroundings that differ there have none in common.
       Each part cuts its surroundings to what such strings can hold, equal ones collapse again, and parts that are still
       large are parted further, down to single strings. A surrounding has open parts only where the hot passage ends, so
       rows stay in proportion to the surroundings, and each suffix array takes at most GROUP of them.
    5. Covered bytes are merged for each class, and each row takes the result of its class.

    Null and empty texts have 0 bytes and the hash of nothing. Null ids are kept as they are; rows that repeat an id and
    text are places each, so they repeat each other. Ties cannot matter. Only the named columns are read. An empty table
    gives an empty result."""
    spark = docs.sparkSession
    tables = Tables(spark)
    small_batches(spark, 500)
    reach = length - GRAM
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id_"), text.alias("text_"))
    keyed = base.withColumn("c", F.unhex(F.md5(F.col("text_").cast("binary"))))
    rows = keyed.select("id_", "c", F.octet_length("text_").cast("long").alias("n_bytes"), F.sha2(F.col("text_").cast("binary"), 256).alias("full"))
    classes = rows.groupBy("c").agg(F.count("*").alias("copies"), F.min("id_").alias("rep"), F.first("n_bytes").alias("size"))

    def find(batches):
        for batch in batches:
            for part in slices(batch, "text_"):
                data, at = utf8(part.column("text_"))
                row, pos, h = [], [], []
                for i in range(part.num_rows):
                    p, x = anchors(data[at[i] : at[i + 1]], length)
                    row.append(np.full(len(p), i))
                    pos.append(p)
                    h.append(x)
                c = part.column("c").take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), c, pa.array(np.concatenate(pos).astype(np.int64))], names=["a", "c", "pos"])

    found = tables.write(keyed.where(F.octet_length("text_") >= length).select("text_", "c").mapInArrow(find, "a long, c binary, pos long").distinct(), "anchors")
    place = F.xxhash64("c", "pos")
    shared = found.groupBy("a").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low != high").select("a")
    spots = found.join(shared, "a").groupBy("c").agg(F.collect_list(F.struct("pos", "a")).alias("spots"))
    spots = spots.join(classes.select("c", "rep"), "c").withColumnsRenamed({"c": "c2"})
    texts = keyed.join(spots, (F.col("c") == F.col("c2")) & F.col("id_").eqNullSafe(F.col("rep"))).select("c", "text_", "spots")
    texts = tables.write(texts, "texts")
    tables.drop("anchors")

    # grams that occur once: no string that holds one can repeat, so surroundings end there
    def thin(batches):
        for batch in batches:
            for part in slices(batch, "text_"):
                data, at = utf8(part.column("text_"))
                pos, h = [], []
                for i in range(part.num_rows):
                    x = gram_hashes(data[at[i] : at[i + 1]])
                    pos.append(np.flatnonzero(x % U64(THIN) == 0))
                    h.append(x[pos[-1]])
                k = part.column("k").take(pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in pos])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), k, pa.array(np.concatenate(pos).astype(np.int64))], names=["g", "k", "pos"])

    grams = texts.select(F.xxhash64("c").alias("k"), "text_").mapInArrow(thin, "g long, k long, pos long")
    once = grams.groupBy("g").agg(F.min("k").alias("k"), F.max("k").alias("k_last"), F.min("pos").alias("pos"), F.max("pos").alias("pos_last")).where("k = k_last and pos = pos_last")
    marks = once.groupBy("k").agg(F.array_sort(F.collect_list("pos")).alias("marks"))
    marked = texts.join(marks, F.xxhash64("c") == F.col("k"), "left").select("c", "text_", "spots", F.coalesce("marks", F.array().cast("array<bigint>")).alias("marks"))

    # the surroundings of each spot, by a hash of their bytes and of where the anchor stands in them
    around = {"g": pa.binary(), "s": pa.binary(), "c": pa.binary(), "begin": pa.int32(), "size": pa.int32(), "at": pa.int32()}

    def surround(batches):
        for batch in batches:
            for part in slices(batch, "text_", 1 << 19):
                out: list = []
                for c, text, spots, marks in zip(*(part.column(x).to_pylist() for x in ("c", "text_", "spots", "marks")), strict=True):
                    raw, marks = text.encode(), np.array([-1, *marks, len(text) * 4 + length], np.int64)
                    places = np.array([x["pos"] for x in spots], np.int64)
                    after = np.searchsorted(marks, places)
                    begins = np.maximum(np.maximum(places - reach, 0), marks[after - 1] + 1).tolist()
                    ends = np.minimum(np.minimum(places + length, len(raw)), marks[after] + GRAM - 1).tolist()
                    for spot, begin, end in zip(spots, begins, ends, strict=True):
                        if end - begin >= length:
                            at = spot["pos"] - begin
                            out.append((spot["a"].to_bytes(8, "little", signed=True), digest(raw[begin:end], at.to_bytes(4, "little")), c, begin, end - begin, at))
                yield kinds_of(around, out)

    # a place is a number such that equal places are equal and neighbours differ by their distance
    pieces = marked.mapInArrow(surround, "g binary, s binary, c binary, begin int, size int, at int")
    pieces = tables.write(pieces, "pieces").withColumn("place", F.shiftrightunsigned(F.xxhash64("c"), 1) + F.col("begin"))
    held = pieces.groupBy("g", "s").agg(F.min("place").alias("place"), F.max("place").alias("other"), F.min(F.struct("c", "begin", "size", "at")).alias("from"))
    held = tables.write(held, "contents")

    # bytes travel once for each different surrounding that has others to be compared with
    def with_bytes(large: bool) -> DataFrame:
        sizes = held.groupBy("g").agg(F.count("*").alias("texts")).where(F.col("texts") > GROUP if large else (F.col("texts") > 1) & (F.col("texts") <= GROUP)).select("g")
        wanted = held.join(sizes, "g").groupBy(F.col("from.c").alias("c3")).agg(F.collect_list(F.struct("g", "s", "place", "other", F.col("from.begin").alias("begin"), F.col("from.size").alias("size"), F.col("from.at").alias("at"))).alias("wanted"))
        cut = {"g": pa.binary(), "s": pa.binary(), "place": pa.int64(), "other": pa.int64(), "at": pa.int32(), "piece": pa.binary()}

        def cut_out(batches):
            for batch in batches:
                for text, wanted in zip(batch.column("text_").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                    raw = text.encode()
                    for k in range(0, len(wanted), 2000):
                        yield kinds_of(cut, [(x["g"], x["s"], x["place"], x["other"], x["at"], raw[x["begin"] : x["begin"] + x["size"]]) for x in wanted[k : k + 2000]])

        near = texts.select("c", "text_").join(wanted, F.col("c") == F.col("c3")).select("text_", "wanted")
        return near.mapInArrow(cut_out, "g binary, s binary, place long, other long, at int, piece binary")

    # tables of a level go as soon as the next level, or the way back, has been written
    levels, results = [], [tables.write(sort_groups(with_bytes(False), length), "spans0")]
    hot = tables.write(with_bytes(True).withColumns({"lo": F.lit(0), "hi": F.lit(reach)}), "hot0")
    while hot.limit(1).count():
        level = len(levels)
        parts = tables.write(part_groups(hot, length, not levels), f"parts{level}")
        facts = parts.groupBy("child_g", "child_s").agg(F.min("place").alias("place"), F.max("other").alias("other"), F.min(F.struct("g", "s", "begin", "size", "at", "lo", "hi")).alias("from"))
        facts = tables.write(facts, "facts")
        sizes = facts.groupBy("child_g").agg(F.count("*").alias("texts")).where("texts > 1")
        source = hot.select(F.col("g").alias("g2"), F.col("s").alias("s2"), "piece")
        bytes_ = facts.join(sizes, "child_g").join(source, (F.col("from.g") == F.col("g2")) & (F.col("from.s") == F.col("s2")))
        piece = F.substring("piece", F.col("from.begin") + 1, F.col("from.size"))
        bytes_ = bytes_.select(F.col("child_g").alias("g"), F.col("child_s").alias("s"), "place", "other", F.col("from.at").alias("at"), F.col("from.lo").alias("lo"), F.col("from.hi").alias("hi"), piece.alias("piece"), "texts")
        whole = facts.where("place != other").select(F.col("child_g").alias("g"), F.col("child_s").alias("s"), F.array(F.lit(0), F.col("from.size")).alias("spans"))
        levels.append(parts.select("g", "s", "child_g", "child_s", "begin"))
        results.append(tables.write(sort_groups(bytes_.where(F.col("texts") <= GROUP), length).union(whole), f"spans{level + 1}"))
        hot = tables.write(bytes_.where(F.col("texts") > GROUP).drop("texts"), f"hot{level + 1}")
        tables.drop("facts", f"hot{level}")
    for level, parts in reversed(list(enumerate(levels))):  # from the parts back to the surroundings that they were cut from
        spans = results.pop()
        joined = parts.join(spans.withColumnsRenamed({"g": "child_g", "s": "child_s"}), ["child_g", "child_s"])
        results[-1] = tables.write(results[-1].union(shifted(joined)), f"merged{level}")
        tables.drop(f"parts{level}", f"spans{level}", f"spans{level + 1}", f"merged{level + 1}")

    whole = held.where("place != other").select("g", "s", F.array(F.lit(0), F.col("from.size")).alias("spans"))
    covered = pieces.select("g", "s", "c", "begin").join(whole.union(results[0]), ["g", "s"])
    covered = covered.groupBy("c").agg(F.collect_list(F.struct("begin", "spans")).alias("spans"))
    cuts = texts.join(covered, "c").select("c", "text_", "spans")

    def cut(batches):
        for batch in batches:
            out = []
            for c, text, spans in zip(batch.column("c").to_pylist(), batch.column("text_").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                gone = merged(np.concatenate([np.array(x["spans"], np.int64).reshape(-1, 2) + x["begin"] for x in spans]))
                bounds = [0, *gone.ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(bounds[::2], bounds[1::2], strict=True))
                out.append((c, len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            yield kinds_of({"c": pa.binary(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}, out)

    cuts = tables.write(cuts.mapInArrow(cut, "c binary, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["c"]), "cuts")
    tables.drop(*(tables.paths.keys() - {"cuts"}))
    zero = F.lit(0).cast("long")
    gone = (F.col("copies") > 1) & (F.col("size") >= length)
    result = classes.join(cuts, "c", "left").where(gone | F.col("n_removed").isNotNull()).select("c", F.when(gone, F.col("size")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(gone, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
    out = rows.join(result, "c", "left")
    return out.select(F.col("id_").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "full").alias("kept_sha256"))
