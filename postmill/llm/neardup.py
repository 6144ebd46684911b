"""Operator 6: near duplicates by SuperMinHash signatures, banding, exact verification and distributed union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import VISIBLE
from .shared import U64, Tables, Words, lower_ascii, mix, slices, small_batches, stream, utf8

#: 25 bands of 5: a pair at similarity 0.85 shares no band with a probability of 4e-7, one at 0.8 with 5e-5.
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
#: Shingles whose permutations are held at once.
CHUNK = 1 << 18
#: Shingles that so many documents hold at most bring these together one by one; the others count in a bound.
LIGHT = 4
#: Ids that are broadcast to choose texts by.
BROADCAST_IDS = 2_000_000


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word shingles of each text, by row; a text of fewer words is one shingle as a whole."""
    data, at = utf8(column)
    words = Words(lower_ascii(data), at, VISIBLE)
    n, h = words.n, words.hash
    ends = np.cumsum(n)
    gram, row = h.copy(), words.row
    for i in range(1, width):
        gram = mix(gram[: len(gram) - 1] * U64(0x9E3779B97F4A7C15) + h[i:]) if len(gram) else gram
    m = len(gram) if len(h) >= width else 0
    inside = row[width - 1 :][:m] == row[:m]
    rows, hashes = [row[:m][inside]], [gram[:m][inside]]
    for size in range(1, width):  # short texts: the chain over all their words, marked by their number
        short = np.flatnonzero(n == size)
        if len(short):
            first = ends[short] - size
            whole = h[first]
            for i in range(1, size):
                whole = mix(whole * U64(0x9E3779B97F4A7C15) + h[first + i])
            rows.append(short)
            hashes.append(mix(whole + U64(size)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def superminhash(row: np.ndarray, h: np.ndarray, rows: int, size: int = SIZE) -> np.ndarray:
    """(rows, size) signatures. Each element deals 0, 1, 2 .. (plus a random fraction) to the places in the order of its own
    permutation, built by one swap a round; each place keeps the least. A row stops once all its places hold less than
    the next round can give. A value is the round in the top byte and the fraction in the others."""
    out = np.full(rows * size, np.iinfo(np.uint64).max, U64)
    keys = stream(29, 2 * size)
    for begin in range(0, len(h), CHUNK):
        r, x = row[begin : begin + CHUNK], h[begin : begin + CHUNK]
        order = np.broadcast_to(np.arange(size, dtype=np.uint8), (len(x), size)).copy()
        for j in range(size):
            e = np.arange(len(x))
            fraction, pick = mix(x ^ keys[2 * j]), mix(x + keys[2 * j + 1])
            k = j + ((pick >> U64(32)) * U64(size - j) >> U64(32)).astype(np.int64)
            place = order[e, k]
            order[e, k] = order[:, j]
            np.minimum.at(out, r * size + place, U64(j) << U64(56) | fraction >> U64(8))
            lo, hi = int(r[0]), int(r[-1]) + 1
            open_ = (out[lo * size : hi * size].reshape(-1, size).max(1) >> U64(56)) > j
            live = open_[r - lo]
            if not live.any():
                break
            if not live.all():
                r, x, order = r[live], x[live], order[live]
    return out.reshape(rows, size)


def signature_rows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id_, n, s1, s2, bands): shingle count, a 128-bit sum that equal sets share, and the hashed bands (null if empty)."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("id_", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    seeds = stream(31, BANDS * ROWS)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_", 2 << 20):
                rows = part.num_rows
                row, h = shingles(part.column("text_"), width)
                n = np.bincount(row, minlength=rows)
                sums = []
                for odd in (U64(1), U64(0xD6E8FEB86659FD93)):
                    total = np.zeros(rows, U64)
                    np.add.at(total, row, mix(h * odd + odd))
                    sums.append(total.view(np.int64))
                sig = superminhash(row, h, rows)
                bands = mix((mix(sig ^ seeds) * (seeds | U64(1))).reshape(rows, BANDS, ROWS).sum(2) + np.arange(BANDS, dtype=U64))
                lists = [b if k else None for b, k in zip(bands.view(np.int64), n, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id_"), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.array(lists, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).cast("string").alias("text_")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id_, words): the sorted shingle hashes of the documents in ids (node, of one row each).

    Up to BROADCAST_IDS ids go to all executors (some 40 bytes each), so that texts stay where they are; beyond, ids and
    texts are joined by a shuffle."""
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    chosen = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).cast("string").alias("text_")).join(ids, F.col("id_") == F.col("node"), "left_semi")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_"):
                row, h = shingles(part.column("text_"), width)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id_"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(h.view(np.int64)))], names=["id_", "words"])

    return chosen.mapInArrow(run, "id_ long, words array<long>")


def flat(column: pa.Array) -> tuple[np.ndarray, list[int]]:
    """(values, offsets) of a list column of longs, read as unsigned."""
    return column.values.to_numpy(zero_copy_only=False).view(U64), column.offsets.to_pylist()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. Where many pairs share a document it
    should be b: the sets of a travel to those of b."""

    def run(batches):
        for batch in batches:
            (x, at), (y, bt) = flat(batch.column("x")), flat(batch.column("y"))
            keep = []
            for i in range(batch.num_rows):
                p, q = x[at[i] : at[i + 1]], y[bt[i] : bt[i + 1]]
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(q) else 0
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("id_").alias("a"), F.col("words").alias("x"))
    two = sets.select(F.col("id_").alias("b"), F.col("words").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, comp): the smallest node that each node of the edges (a, b) reaches.

    Union-find as joins: every node takes the least label among its own and its neighbours', then its label's label,
    until nothing changes; labels are written to the shared folder in each round."""
    both = tables.write(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = tables.write(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("comp").alias("near"))
        up = labels.select(F.col("node").alias("root"), F.col("comp").alias("upper"))
        moved = labels.join(near, F.col("node") == F.col("u")).join(up, F.col("comp") == F.col("root"), "left")
        moved = tables.write(moved.select("node", F.col("comp").alias("old"), F.least("comp", "near", "upper").alias("comp")), "labels")
        labels = moved.select("node", "comp")
        if not moved.where("comp < old").limit(1).count():
            return labels


def merged(comp: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """comp (node, comp) after the links (a, b) are added: only the components that they connect are worked on."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(comp.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp")), end, "left")
    ends = ends.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).where("a != b").distinct()
    roots = components(ends, tables)
    upper = roots.select(F.col("node").alias("under"), F.col("comp").alias("upper"))
    old = comp.join(upper, F.col("comp") == F.col("under"), "left").select("node", F.coalesce("upper", "comp").alias("comp"))
    return tables.write(old.union(roots.join(comp, "node", "left_anti").select("node", "comp")), "components")


def close(one: str, other: str, percent: int):
    """Sets of so many elements can have the similarity; columns hold the least (lo) and most (hi) of a document's texts."""
    return (100 * F.col(f"{one}hi") >= percent * F.col(f"{other}lo")) & (100 * F.col(f"{other}hi") >= percent * F.col(f"{one}lo"))


def left_over(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """The pairs (a, b) of documents in one bucket but in different components that may still be linked, by exact bounds.

    Let h be the number of a document's shingles that over LIGHT of the documents in such buckets hold. Two documents have
    an intersection of at most the smaller h plus the number of rarer shingles that both hold. Pairs with such shingles
    are found by a join on these (each brings at most LIGHT documents together) and counted. Pairs without one need an h
    that alone is enough, for both; so a copy with many changes of its own is never paired with the group around it."""
    placed = members.join(comp, "node", "left").select(*members.columns, F.coalesce("comp", "node").alias("comp"))
    several = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("lo").alias("least"), F.max_by("comp", F.struct("weight", -F.col("node"))).alias("main"))
    open_ = tables.write(placed.join(several.where("low < high").drop("low", "high"), "bucket"), "open")
    nodes = open_.groupBy("node").agg(F.min("comp").alias("comp"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set("bucket").alias("buckets"))
    held = tables.write(sets.join(nodes.select("node"), F.col("id_") == F.col("node"), "left_semi").select(F.col("id_").alias("node"), F.explode("words").alias("g")), "held")
    rare = held.groupBy("g").agg(F.count("*").alias("df")).where(F.col("df") <= LIGHT)
    light = tables.write(held.join(rare, "g"), "light")
    heavy = held.groupBy("node").agg(F.count("*").alias("all")).join(light.groupBy("node").agg(F.count("*").alias("few")), "node", "left")
    heavy = heavy.select("node", (F.col("all") - F.coalesce("few", F.lit(0))).alias("h"))
    nodes = tables.write(nodes.join(heavy, "node").withColumn("reach", (100 + percent) * F.col("h") - percent * F.col("lo")), "nodes")

    facts = light.where("df > 1").join(nodes.select("node", "comp", "lo", "hi", "h"), "node").drop("df")
    x, y = (facts.select("g", *(F.col(c).alias(k + c) for c in ("node", "comp", "lo", "hi", "h"))) for k in ("a", "b"))
    met = x.join(y, "g").where((F.col("anode") < F.col("bnode")) & (F.col("acomp") != F.col("bcomp")) & close("a", "b", percent))
    met = met.groupBy("anode", "bnode").agg(F.count("*").alias("k"), *(F.first(c).alias(c) for c in ("alo", "blo", "ah", "bh")))
    met = met.where((100 + percent) * (F.least("ah", "bh") + F.col("k")) >= percent * (F.col("alo") + F.col("blo")))

    full = open_.select("bucket", "node", "least", "main").join(nodes, "node").where(F.col("reach") >= percent * F.col("least"))
    x, y = (full.select("bucket", "main", *(F.col(c).alias(k + c) for c in ("node", "comp", "lo", "hi", "reach", "buckets"))) for k in ("a", "b"))
    enough = (F.col("areach") >= percent * F.col("blo")) & (F.col("breach") >= percent * F.col("alo")) & (F.col("acomp") != F.col("bcomp")) & close("a", "b", percent)
    first = F.array_min(F.array_intersect("abuckets", "bbuckets")) == F.col("bucket")
    alike = x.where("acomp != main").drop("main").join(y.drop("main"), "bucket").where(enough & first)
    pairs = met.select("anode", "bnode").union(alike.select(F.least("anode", "bnode"), F.greatest("anode", "bnode")))
    return pairs.select(F.col("anode").alias("a"), F.col("bnode").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``; similarity is that of the sets of word shingles.

    Rows with equal sets are one class, named by its smallest id; classes that share a band are candidates. Within a
    bucket of candidates no list of all pairs is made. First each bucket's members are compared with one of them, its hub
    (the one whose buckets hold the most members, so the text that the others are copies of), confirmed on the full sets
    and merged; buckets whose members are not all connected get another hub among those left, as long as hubs link one in
    20 of what they are compared with. What is then still in different components is compared only where exact bounds on
    the intersection cannot rule a link out (``left_over``). So each pair of candidates is confirmed, ruled out, or
    connected already.

    Null and empty texts, and texts without words, are linked with nothing. Rows with a null id are their own component
    (null, kept). Rows that share an id are one document, linked through any of their texts; each row is returned.
    Ties cannot matter, as components are sets. Only the named columns are read. An empty table gives an empty result."""
    tables = Tables(docs.sparkSession)
    rows = tables.write(signature_rows(docs, id_col, text_col, width), "signatures")
    found = rows.where("id_ is not null and n > 0")
    classes = tables.write(found.groupBy("n", "s1", "s2").agg(F.min("id_").alias("rep"), F.first("bands").alias("bands")), "classes")
    spread = classes.select(F.col("rep").alias("node"), "n", F.explode("bands").alias("bucket"))
    crowded = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = spread.join(crowded, "bucket").groupBy("bucket", "node").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("size").alias("size"))
    members = tables.write(members, "crowded")
    weights = tables.write(members.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    members = tables.write(members.join(weights, "node").drop("size"), "members")
    sets = tables.write(shingle_sets(docs, weights.select("node"), id_col, text_col, width), "sets")
    twice = found.join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).groupBy("id_").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    again = found.join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).join(twice, "id_").select("a", F.col("rep").alias("b")).where("a < b").distinct()
    comp = tables.write(components(tables.write(again, "links"), tables), "components")

    left = members
    while True:
        left = left.join(comp, "node", "left").select(*members.columns, F.coalesce("comp", "node").alias("comp"))
        hubs = left.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by(F.struct("node", "comp", "lo", "hi"), F.struct("weight", -F.col("node"))).alias("hub"))
        hubs = hubs.where("low < high").select("bucket", *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("node", "comp", "lo", "hi")))
        left = tables.write(left.join(hubs, "bucket").where("comp != hub_comp"), "left")
        near = left.where(close("", "hub_", percent)).select(F.col("node").alias("a"), F.col("hub_node").alias("b"))
        pairs = tables.write(near.distinct(), "pairs")
        links = tables.write(confirmed(pairs, sets, percent), "links")
        compared, linked = pairs.count(), links.count()
        comp = merged(comp, links, tables)
        reached = comp.select(F.col("node").alias("hub_node"), F.col("comp").alias("reached"))
        left = left.join(comp.withColumnRenamed("comp", "now"), "node", "left").join(reached, "hub_node", "left")
        left = left.where(F.coalesce("now", "node") != F.coalesce("reached", "hub_node")).select(*members.columns)
        if 20 * linked <= compared:
            break
    links = tables.write(confirmed(left_over(members, comp, sets, percent, tables), sets, percent), "links")
    comp = merged(comp, links, tables)
    named = classes.join(comp, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("comp", "rep").alias("component"))
    named = tables.write(named, "named")
    tables.drop(*(tables.paths.keys() - {"signatures", "named"}))
    out = rows.join(named, ["n", "s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id_"))
    return out.select(F.col("id_").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id_").isNotNull(), component).alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
