"""De-duplication and inserts under unique keys."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row by ``order`` of each key, one key after the other; rows whose key is null all stay.

    One scan and one shuffle a key: rows with a null key get a number of their own to be dealt by. The window keeps one row
    a key in every task before the shuffle (Spark's group limit)."""
    for key in keys:
        alone = df.withColumn("_alone", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
        ranked = alone.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_alone").orderBy(*order)))
        df = ranked.where("_rank = 1").drop("_rank", "_alone")
    return df


def duplicates(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """(key, deleted): how many rows each step of ``dedup_latest`` removes, counted without sorting."""
    parts = None
    for key in keys:
        counted = df.where(F.col(key).isNotNull()).groupBy(key).agg((F.count("*") - 1).alias("extra"))
        one = counted.agg(F.coalesce(F.sum("extra"), F.lit(0)).cast("long").alias("deleted")).select(F.lit(key).alias("key"), "deleted")
        parts = one if parts is None else parts.unionByName(one)
        df = dedup_latest(df, [key], order)
    return parts


#: Rounds of ``conflict_free_append`` before what is left is taken by components, and the rows that one task resolves.
ROUNDS, TOGETHER = 3, 50_000


def conflict_free_append(batch: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``batch`` that inserts in ``order`` would add to ``existing`` if a row that repeats any unique key is left out.

    A row that is first in order under each of its keys is certain; rows that share a key with a certain row are not
    inserted; what is left is looked at again. Each round is two hash aggregates a key and semi joins, written to the
    shared folder so that the plan does not grow. Null keys never collide. Order columns must tell all rows apart.

    Most rows are settled in ROUNDS rounds. Where rows still wait for each other in a chain, what is left falls into
    components of rows that share keys, found in a number of rounds that grows with the logarithm of the longest chain; a
    component of up to TOGETHER rows is inserted row by row in one task, and only the rows of larger ones go on in rounds."""
    left = batch.withColumn("_ord", F.struct(*order))
    for key in keys:
        left = left.join(existing.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    left, accepted = written(left), None
    rounds = 0
    while left.limit(1).count():
        if rounds == ROUNDS:
            done, left = by_components(left, keys, TOGETHER)
            accepted = done if accepted is None else accepted.unionByName(done)
            rounds += 1
            continue
        rounds += 1
        firsts = left
        for key in keys:
            least = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("_ord").alias("_least"))
            firsts = firsts.join(least, F.col(key) == F.col("_key"), "left").where(F.col("_key").isNull() | (F.col("_ord") == F.col("_least"))).drop("_key", "_least")
        firsts = written(firsts)
        accepted = firsts if accepted is None else accepted.unionByName(firsts)
        rest = left
        for key in keys:
            rest = rest.join(firsts.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
        rest = rest.join(firsts.select("_ord").distinct(), "_ord", "left_anti").select(*left.columns)
        left = written(rest)
    out = accepted if accepted is not None else left
    return out.drop("_ord").select(*batch.columns)


def key_components(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(_row, _comp): the component of each row (numbered _row) among those that share a value of any key, named by the
    least number in it.

    Rows take the least label of their keys, labels then take their labels' labels, until nothing changes; so labels travel
    over twice as many rows in each round. Rounds are written, as joins and aggregates with one row a key."""
    ends = [rows.where(F.col(key).isNotNull()).select("_row", F.concat(F.lit(f"{i}:"), F.col(key).cast("string")).alias("_key")) for i, key in enumerate(keys)]
    links = ends[0]
    for more in ends[1:]:
        links = links.unionByName(more)
    links = written(links)
    labels = written(rows.select("_row", F.col("_row").alias("_comp")))
    while True:
        held = links.join(labels, "_row")
        low = held.groupBy("_key").agg(F.min("_comp").alias("_low"))
        near = held.select("_row", "_key").join(low, "_key").groupBy("_row").agg(F.min("_low").alias("_low"))
        # the label of a row, and so of all that carry it, takes the least label that any of them has met
        met = labels.join(near, "_row", "left").select("_row", "_comp", F.least("_comp", F.coalesce("_low", "_comp")).alias("_low"))
        met = written(met)
        hooked = met.groupBy("_comp").agg(F.min("_low").alias("_up"))
        up = met.join(hooked, "_comp").select("_row", "_comp", F.least("_low", "_up").alias("_new"))
        jump = written(up)
        over = jump.select(F.col("_row").alias("_at"), F.col("_new").alias("_over"))
        moved = written(jump.join(over, F.col("_new") == F.col("_at"), "left").select("_row", "_comp", F.least("_new", F.coalesce("_over", "_new")).alias("_new")))
        labels = moved.select("_row", F.col("_new").alias("_comp"))
        if not moved.where("_new < _comp").limit(1).count():
            return labels


def by_components(left: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(inserted rows, rows of larger components): each component of at most ``most`` rows is inserted in order by one task,
    which gets numbers of keys and no other column."""
    numbered = written(left.withColumn("_row", F.monotonically_increasing_id()))
    comps = key_components(numbered, keys)
    sizes = comps.groupBy("_comp").agg(F.count("*").alias("_size"))
    placed = written(comps.join(sizes, "_comp"))
    small = numbered.join(placed.where(F.col("_size") <= most), "_row")
    hashed = [F.when(F.col(key).isNotNull(), F.sha2(F.col(key).cast("string"), 256)).alias(f"_k{i}") for i, key in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]

    def insert(batches):
        comp, seen = None, [set() for _ in names]
        for batch in batches:
            taken = []
            for row, own, *values in zip(*(batch.column(x).to_pylist() for x in ("_row", "_comp", *names)), strict=True):
                if own != comp:
                    comp, seen = own, [set() for _ in names]
                if all(v is None or v not in s for v, s in zip(values, seen, strict=True)):
                    taken.append(row)
                    for v, s in zip(values, seen, strict=True):
                        s.add(v)
            yield pa.RecordBatch.from_arrays([pa.array(taken, pa.int64())], names=["_row"])

    ordered = small.select("_row", "_comp", "_ord", *hashed).repartition("_comp").sortWithinPartitions("_comp", "_ord").select("_row", "_comp", *names)
    inserted = written(ordered.mapInArrow(insert, "_row long"))
    large = placed.where(F.col("_size") > most).select("_row")
    columns = left.columns
    return written(numbered.join(inserted, "_row").select(*columns)), written(numbered.join(large, "_row").select(*columns))


def scratch_dir(spark) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Where none is set, a local master takes a new temporary
    folder; a cluster is refused, as its executors would not see one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.postmill.scratch", None)
    if not found:
        import tempfile

        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="postmill-")
        spark.conf.set("spark.postmill.scratch", found)
    return found.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """The rows of ``df`` dealt in turn over two tasks a core at least, for work that costs far more than a shuffle: a small
    file is read by one task, and all that follows would stay in it."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan starts anew and nothing is computed twice."""
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    for scope in _scopes.get():
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark):
    """Deletes at its end all tables that ``written`` wrote in it; nothing may read them any more by then."""
    scope: list[str] = []
    token = _scopes.set((*_scopes.get(), scope))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in scope:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def insert_outcomes(batch: DataFrame, inserted: DataFrame, message: str, row: str) -> DataFrame:
    """(message, outcome): Inserted if any row of a message was, else Duplicate."""
    flags = batch.select(message, row).join(inserted.select(row).distinct().withColumn("_in", F.lit(True)), row, "left")
    return flags.groupBy(message).agg(F.when(F.max(F.coalesce("_in", F.lit(False))), "Inserted").otherwise("Duplicate").alias("outcome"))
