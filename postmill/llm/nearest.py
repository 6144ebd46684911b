"""Operator 5: nearest neighbours by NN-descent graphs, built with Spark joins, and greedy graph search."""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written

CANDIDATE = "id long, cand long, sim float"
#: Queries that are also answered by comparing them with every vector, to know the recall.
PROBES = 200
#: Random blocks grow up to so many times ``block``; beyond, queries are compared with the whole table, in blocks of so
#: many bytes of queries, with so many candidates more than are asked for (the order is made anew by exact sums).
LARGEST, BLOCK_BYTES, SLACK = 16, 32 << 20, 5


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows with an id and a vector of finite components that is not all zero."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).where(fine)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes: the length as a 32-bit float and the direction as 16-bit ones, so that none loses its size or precision to others."""
    norm = np.sqrt((x * x).sum(1))
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    return [a.tobytes() + b.tobytes() for a, b in zip(norm.astype("<f4"), unit.astype("<f2"), strict=True)]


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column of packed ones."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return raw[:, 4:].copy().view("<f2").astype(np.float32) * raw[:, :4].copy().view("<f4")


def best(ids: np.ndarray, cands: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best distinct candidates of each id."""
    order = np.lexsort((-sims, cands, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (cands[order][1:] != cands[order][:-1])
    order = order[new]
    order = order[np.lexsort((cands[order], -sims[order], ids[order]))]
    sorted_ids = ids[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), sorted_ids[1:] != sorted_ids[:-1])))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < most]


def batch_of(ids, cands, sims, most: int) -> pa.RecordBatch:
    ids, cands, sims = (np.concatenate([*x, np.zeros(0, t)]) for x, t in ((ids, np.int64), (cands, np.int64), (sims, np.float32)))
    at = best(ids, cands, sims, most)
    return pa.RecordBatch.from_arrays([pa.array(ids[at].astype(np.int64)), pa.array(cands[at].astype(np.int64)), pa.array(sims[at].astype(np.float32))], names=["id", "cand", "sim"])


def local_joins(groups: DataFrame, most: int, all_new: bool) -> DataFrame:
    """Candidates from groups of members (struct of id, vec, kth, new): pairs with a new member that beat a member's kth best.

    Members whose kth best is infinite are only compared with, and get no candidates."""

    def run(batches):
        for batch in batches:
            members = batch.column("members")
            flat, cuts = members.flatten(), np.concatenate(([0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            if not len(flat):
                continue
            x, name = matrix(flat.field("vec")), flat.field("id").to_numpy()
            kth, new = flat.field("kth").to_numpy(), flat.field("new").to_numpy(zero_copy_only=False)
            out: tuple[list, list, list] = ([], [], [])
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                own = a + np.flatnonzero(kth[a:z] < np.inf)
                s = x[own] @ x[a:z].T
                s[np.arange(len(own)), own - a] = -np.inf
                if not all_new:
                    s[~(new[own, None] | new[None, a:z])] = -np.inf
                if z - a > most:
                    floor = np.partition(s, -most, axis=1)[:, -most]
                    s[s < floor[:, None]] = -np.inf
                i, j = np.nonzero(s > kth[own, None])
                out[0].append(name[own][i])
                out[1].append(name[a:z][j])
                out[2].append(s[i, j])
            yield batch_of(*out, most)

    return groups.mapInArrow(run, CANDIDATE)


def top(candidates: DataFrame, graph: DataFrame | None, most: int) -> DataFrame:
    """(id, cands, sims, news, kth): the ``most`` best of old neighbours and candidates, those not there before being new."""
    rows = candidates.select("id", "cand", "sim", F.lit(True).alias("new"))
    if graph is not None:
        old = graph.select("id", F.explode(F.arrays_zip("cands", "sims")).alias("x")).select("id", F.col("x.cands").alias("cand"), F.col("x.sims").alias("sim"), F.lit(False).alias("new"))
        rows = rows.union(old)
    kept = rows.groupBy("id").agg(F.collect_list(F.struct("cand", "sim", "new")).alias("all"))

    def run(batches):
        for batch in batches:
            every = batch.column("all")
            lens = every.value_lengths().to_numpy(zero_copy_only=False)
            flat = every.flatten()
            cand, sim, new = flat.field("cand").to_numpy(), flat.field("sim").to_numpy(), flat.field("new").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lens)), lens)
            # an old neighbour keeps its old similarity, so that it is not taken for a new one
            order = np.lexsort((new, cand, row))
            head = np.ones(len(order), bool)
            head[1:] = (row[order][1:] != row[order][:-1]) | (cand[order][1:] != cand[order][:-1])
            order = order[head]
            at = order[best(row[order], cand[order], sim[order], most)]
            cuts = np.searchsorted(row[at], np.arange(len(lens) + 1)).astype(np.int32)
            listed = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[at])) for x in (cand, sim, new)]
            full = np.diff(cuts) >= most
            last = np.where(full, sim[at][np.maximum(cuts[1:] - 1, 0)] if len(at) else 0, -np.inf).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *listed, pa.array(last)], names=["id", "cands", "sims", "news", "kth"])

    return kept.mapInArrow(run, "id long, cands array<long>, sims array<float>, news array<boolean>, kth float")


def blocks(small: DataFrame, n: int, trees: int, size: int, width: int, seed: int = 3) -> DataFrame:
    """Groups of (id, vec, kth): for each of ``trees`` sets of random hyperplanes, the vectors on the same side of all of them.

    Sides that hold more than ``size`` vectors are split at random, so that no group grows with the table."""
    bits = max(0, math.ceil(math.log2(max(1, n / size))))
    trees = trees if bits else 1  # all vectors fit one group, which need not be made again
    planes = np.random.default_rng(seed).standard_normal((trees * bits, width)).astype(np.float32)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("vec"))
            side = (x @ planes.T > 0).reshape(len(x), trees, bits) if bits else np.zeros((len(x), trees, 0), bool)
            leaf = (side * (1 << np.arange(bits))).sum(2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), batch.column("kth"), pa.array(list(leaf), pa.list_(pa.int64()))], names=["id", "vec", "kth", "leaves"])

    placed = small.mapInArrow(run, "id long, vec binary, kth float, leaves array<long>").select("id", "vec", "kth", F.posexplode("leaves").alias("tree", "leaf"))
    counts = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    salted = placed.join(counts, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")))
    member = F.struct("id", "vec", "kth", F.lit(True).alias("new"))
    return salted.groupBy("tree", "leaf", "part").agg(F.collect_list(member).alias("members")).select("members")


def descend(graph: DataFrame, small: DataFrame, most: int, back: int) -> DataFrame:
    """Candidates of one iteration: members of a node's neighbourhood, forward and back, are joined with each other.

    Back neighbours are sampled: ``back`` a node, chosen by hash, new ones first."""
    edges = graph.select("id", F.explode(F.arrays_zip("cands", "news")).alias("x")).select("id", F.col("x.cands").alias("cand"), F.col("x.news").alias("new"))
    rank = Window.partitionBy("cand").orderBy(F.col("new").desc(), F.xxhash64("id", "cand"))
    reverse = edges.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= back).select(F.col("cand").alias("pivot"), F.col("id").alias("member"), "new")
    pairs = edges.select(F.col("id").alias("pivot"), F.col("cand").alias("member"), "new").union(reverse)
    pairs = pairs.groupBy("pivot", "member").agg(F.max("new").alias("new"))
    known = small.join(graph.select("id", "kth"), "id", "left").select(F.col("id").alias("member"), "vec", F.coalesce("kth", F.lit(float("-inf"))).cast("float").alias("kth"))
    member = F.struct(F.col("member").alias("id"), "vec", "kth", "new")
    groups = pairs.join(known, "member").groupBy("pivot").agg(F.collect_list(member).alias("members"), F.max("new").alias("some")).where("some").select("members")
    return local_joins(groups, most, False)


def true_floors(keyed: DataFrame, probes: dict[int, list[float]], most: int) -> dict[int, float]:
    """The score of the ``most``-th best node (the last one, if there are fewer) of each probe, from a comparison with all nodes."""
    names, vecs = np.array(list(probes), np.int64), np.array(list(probes.values()), np.float64)

    def run(batches):
        held = np.zeros((len(names), 0))
        for batch in batches:
            flat, _ = lists(batch.column("vec"))
            held = np.concatenate((held, vecs @ flat.reshape(batch.num_rows, -1).T), axis=1)
            held = -np.partition(-held, most - 1, axis=1)[:, :most] if held.shape[1] > most else held
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, held.shape[1])), pa.array(held.ravel())], names=["q", "score"])

    scores = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, most)
    kept = keyed.select("vec").mapInArrow(run, "q long, score double").groupBy("q").agg(scores.alias("best"))
    return {r.q: r.floor for r in kept.select("q", F.element_at("best", -1).alias("floor")).collect()}


def compared(asked: DataFrame, nodes: DataFrame, most: int, dim: int) -> DataFrame:
    """(q, cand): for each query (q, qvec) the ``most`` best of all nodes (cand, vec), ties to the smaller id.

    Queries are taken in blocks of bounded size, one broadcast each; every task compares the block with its part of the
    nodes and keeps ``most`` for each query, and these meet in a top-k by query. So no task holds more than one block,
    whatever the tables' sizes."""
    blocks_ = max(1, math.ceil(asked.count() * dim * 8 / BLOCK_BYTES))
    spark, out = asked.sparkSession, None
    for b in range(blocks_):
        held = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks_)) == b).collect()
        if not held:
            continue
        sent = spark.sparkContext.broadcast((np.array([r.q for r in held], np.int64), np.array([r.qvec for r in held], np.float64)))

        def run(batches, sent=sent):
            names, vecs = sent.value
            ids, scores = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
            for batch in batches:
                flat, _ = lists(batch.column("vec"))
                found = vecs @ flat.reshape(batch.num_rows, -1).T
                ids = np.concatenate((ids, np.broadcast_to(batch.column("cand").to_numpy(), found.shape)), axis=1)
                scores = np.concatenate((scores, found), axis=1)
                if scores.shape[1] > most:
                    order = np.lexsort((ids, -scores), axis=1)[:, :most]
                    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, ids.shape[1])), pa.array(ids.ravel()), pa.array(scores.ravel())], names=["q", "cand", "score"])

        best = written(nodes.select("cand", "vec").mapInArrow(run, "q long, cand long, score double"), "compared")
        out = best if out is None else out.union(best)
    if out is None:
        return asked.select("q", F.col("q").alias("cand")).where("false")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cand"))
    return out.withColumn("place", place).where(F.col("place") <= most).select("q", "cand")


def dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def nearest(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, width: int = 40, back: int = 20, trees: int = 12, block: int = 1000, expand: int = 12, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where ``queries`` (a condition on ``id``) holds, its k nearest other rows by inner product.

    A graph of ``width`` neighbours over the distinct vectors starts from blocks by random hyperplanes and is improved by
    NN-descent: each iteration joins neighbours of neighbours, until one changes less than 0.5% of the graph. A query starts
    at its own place in the graph and in each step expands its ``expand`` best unexpanded candidates, until none is left
    among its best 2k. A sample of the queries is compared with every vector; while less than ``recall`` of their
    neighbours are found, all queries are compared with the vectors of further random blocks, twice as large each time, and go
    on from there; if blocks of LARGEST times ``block`` vectors do not do, queries are compared with the whole table
    (``compared``: in blocks of queries, by all tasks). All comparisons of the result are exact, in double precision on the
    original vectors; ties go to the smaller id.

    Vectors that are null, empty, zero or with null or non-finite components take no part, nor do null ids. Vectors of
    another length than most are compared with all those of their own length. Equal vectors are one node of the graph; all their ids are candidates (the k + 1 smallest ones can be
    needed). Rows that repeat an id with other vectors are candidates each, ranked by their best score. Fewer than k
    others give fewer rows. Only the named columns are read. An empty table gives an empty result."""
    spark = df.sparkSession
    small_batches(spark, 200)
    every = vectors(df, id_col, vec_col)
    usual = every.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = usual.d if usual else 1
    rows = every.where(F.size("vec") == dim)
    # one node for equal vectors, named by the smallest id
    hashed = rows.select("id", "vec", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))
    keyed = written(hashed.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.first("vec").alias("vec"), F.count("*").alias("copies")), "nodes")
    copies = keyed.where("copies > 1").select("h1", "h2", "node")
    rank = Window.partitionBy("node").orderBy("id")
    more = written(hashed.join(copies, ["h1", "h2"]).select("node", "id").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k + 1).select("node", "id"), "copies")
    n = keyed.count()

    # one scale for all: the largest component becomes 1, which changes no order
    largest = keyed.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 1.0

    def shrink(batches):
        for batch in batches:
            flat, _ = lists(batch.column("vec"))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed(flat.reshape(batch.num_rows, dim) / largest), pa.binary())], names=["id", "vec"])

    small = written(keyed.select("node", "vec").mapInArrow(shrink, "id long, vec binary"), "small")
    graph = written(top(local_joins(blocks(small.withColumn("kth", F.lit(float("-inf")).cast("float")), n, trees, block, dim), width, True), None, width), "graph")
    while True:
        found = written(descend(graph, small, width, back), "candidates")
        graph = written(top(found, graph, width), "graph")
        changed = graph.agg(F.sum(F.size(F.filter("news", lambda x: x)))).first()[0] or 0
        if changed <= 0.005 * n * width:
            break
    # greedy search from each query's own node
    asked = hashed.where(queries).select(F.col("id").alias("q"), "h1", "h2", F.col("vec").alias("qvec"))
    asked = written(asked.join(keyed.select("h1", "h2", "node"), ["h1", "h2"]).select("q", "qvec", "node"), "queries")
    lists_of = graph.select(F.col("id").alias("node"), "cands")
    nodes = keyed.select(F.col("node").alias("cand"), "vec")
    pool = asked.select("q", "node", F.col("node").alias("cand")).join(lists_of, "node", "left").select("q", F.explode(F.array_union(F.array("cand"), F.coalesce("cands", F.array().cast("array<long>")))).alias("cand"))
    query_vectors = asked.select("q", "qvec").dropDuplicates(["q"])

    def scores(pairs: DataFrame) -> DataFrame:
        return pairs.join(nodes, "cand").join(query_vectors, "q").select("q", "cand", dot("qvec", "vec").alias("score"))

    def ranked(seen: DataFrame) -> DataFrame:
        return seen.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cand")))

    def expanded(seen: DataFrame) -> DataFrame:
        while True:
            front = ranked(seen).where(F.col("place") <= 2 * k).where("open").withColumn("turn", F.row_number().over(Window.partitionBy("q").orderBy("place"))).where(F.col("turn") <= expand)
            front = written(front.select("q", "cand"), "front")
            if not front.limit(1).count():
                return seen
            fresh = front.join(lists_of, front["cand"] == lists_of["node"]).select("q", F.explode("cands").alias("cand")).distinct().join(seen.select("q", "cand"), ["q", "cand"], "left_anti")
            done = seen.join(front.withColumn("now", F.lit(True)), ["q", "cand"], "left").select("q", "cand", "score", (F.col("open") & F.col("now").isNull()).alias("open"))
            both = done.union(scores(fresh).withColumn("open", F.lit(True)))
            seen = written(ranked(both).where(F.col("place") <= 4 * k).drop("place"), "seen")

    seen = expanded(written(scores(pool.distinct()).withColumn("open", F.lit(True)), "seen"))
    probes = {r.q: r.qvec for r in query_vectors.orderBy(F.xxhash64("q"), "q").limit(PROBES).collect()}
    # a query's own node is one of the k + 1
    floors = true_floors(keyed, probes, k + 1) if probes else {}
    size = block
    while probes:
        hits = sum(min(k + 1, sum(x >= floors[r.q] - 1e-9 * abs(floors[r.q]) for x in r.scores)) for r in seen.where(F.col("q").isin(list(probes))).groupBy("q").agg(F.collect_list("score").alias("scores")).collect())
        reached = hits / (len(probes) * min(k + 1, n))
        logging.getLogger(__name__).info("recall of %s probes: %s, blocks of %s", len(probes), reached, size)
        if reached >= recall or size >= n:
            break
        size *= 2
        if size > LARGEST * block:
            near = compared(query_vectors, nodes, k + 1 + SLACK, dim)
            fresh = near.join(seen.select("q", "cand"), ["q", "cand"], "left_anti")
            seen = written(ranked(seen.union(scores(fresh).withColumn("open", F.lit(False)))).where(F.col("place") <= 4 * k).drop("place"), "seen")
            break
        limits = asked.select(F.col("node").alias("id")).distinct().join(graph.select("id", "kth"), "id", "left").select("id", F.coalesce("kth", F.lit(float("-inf"))).cast("float").alias("kth"))
        marked = small.join(limits, "id", "left").select("id", "vec", F.coalesce("kth", F.lit(float("inf"))).cast("float").alias("kth"))
        near = written(local_joins(blocks(marked, n, trees, size, dim, size), width, True).select(F.col("id").alias("node"), "cand").distinct(), "near")
        fresh = asked.select("q", "node").join(near, "node").select("q", "cand").distinct().join(seen.select("q", "cand"), ["q", "cand"], "left_anti")
        seen = expanded(written(ranked(seen.union(scores(fresh).withColumn("open", F.lit(True)))).where(F.col("place") <= 4 * k).drop("place"), "seen"))
    found = seen.join(more, seen["cand"] == more["node"], "left").select("q", F.coalesce("id", "cand").alias("id"), "score").where("q != id")
    for r in every.where(F.size("vec") != dim).select(F.size("vec").alias("d")).distinct().collect():
        own = every.where(F.size("vec") == r.d)
        few = own.select(F.col("id").alias("cand"), "vec")
        own_queries = own.where(queries).select(F.col("id").alias("q"), F.col("vec").alias("qvec")).dropDuplicates(["q"])
        pairs = compared(own_queries, few, k + 1 + SLACK, r.d).distinct()
        found = found.union(pairs.join(few, "cand").join(own_queries, "q").where("q != cand").select("q", F.col("cand").alias("id"), dot("qvec", "vec").alias("score")))
    found = found.groupBy("q", "id").agg(F.max("score").alias("score"))
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return out.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
