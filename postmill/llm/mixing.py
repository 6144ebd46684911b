"""Operator 9: document rates that bring soft domain memberships to target token weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import bounded, ngrams, scored, training_rows
from .quality import values
from .shared import Tables, slices, small_batches

BITS = 17


def fit_softmax(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, rounds: int = 60, rate: float = 0.5, l2: float = 1e-5) -> np.ndarray:
    """Weights (buckets + 1, classes) of multinomial logistic regression by AdaGrad; the last row is the bias."""
    at = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used, col = np.unique(at, return_inverse=True)
    label = np.eye(classes)[[r[2] for r in rows]]
    w, b = np.zeros((len(used), classes)), np.log(label.mean(0) + 1e-6)
    square = np.full_like(w, 1e-8)
    for _ in range(rounds):
        z = np.stack([np.bincount(row, x * w[col, k], len(rows)) for k in range(classes)], 1) + b
        p = np.exp(z - z.max(1, keepdims=True))
        e = (p / p.sum(1, keepdims=True) - label) / len(rows)
        g = np.stack([np.bincount(col, x * e[row, k], len(used)) for k in range(classes)], 1) + l2 * w
        square += g * g
        w -= rate * g / np.sqrt(square)
    out = np.zeros(((1 << BITS) + 1, classes), np.float32)
    out[used], out[-1] = w, b
    return out


def posteriors(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, train_rows: int, wanted: list[str] | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """((id, n_tokens, p array) of every row, domains); labelled: (id, domain), a bounded sample of which trains."""
    spark = docs.sparkSession
    small_batches(spark)

    def features(batches):
        for batch in batches:
            for part in slices(batch, "text_"):
                row, bucket, count, _ = ngrams(part.column("text_"), BITS, 1)
                x, cuts = values(row, count, part.num_rows), np.searchsorted(row, np.arange(part.num_rows + 1))
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays([part.column("label_"), pa.array([bucket[a:z].astype("<u4").tobytes() for a, z in spans]), pa.array([x[a:z].astype("<f4").tobytes() for a, z in spans])], names=["label_", "at", "x"])

    table = training_rows(docs, labelled, F.col("domain"), id_col, text_col, train_rows).mapInArrow(features, "label_ string, at binary, x binary")
    table = bounded(table, train_rows, "at", "label_").toArrow()
    rows = sorted(zip(*(table.column(i).to_pylist() for i in (1, 2, 0)), strict=True))
    domains = sorted({*(r[2] for r in rows), *(wanted or [])}) or ["all"]
    place = {d: i for i, d in enumerate(domains)}
    w = fit_softmax([(np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(x, "<f4").astype(float), place[d]) for a, x, d in rows], len(domains)) if rows else np.zeros(((1 << BITS) + 1, len(domains)), np.float32)
    model = spark.sparkContext.broadcast(w)

    def score(column):
        w = model.value
        row, bucket, count, tokens = ngrams(column, BITS, 1)
        x = values(row, count, len(column))
        z = np.stack([np.bincount(row, x * w[bucket, k], len(column)) for k in range(w.shape[1])], 1) + w[-1]
        p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return [tokens.astype(np.int64), list(p / p.sum(1, keepdims=True))] if len(z) else [tokens.astype(np.int64), pa.array([], pa.list_(pa.float64()))]

    return scored(docs, id_col, text_col, [T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))], score, keep), domains


def moved(rate, step: np.ndarray, least: float):
    """The rate column after one projected step: rate - p . step, but no less than ``least``."""
    change = sum((F.get(F.col("p"), F.lit(i)) * F.lit(float(x)) for i, x in enumerate(step)), F.lit(0.0))
    return F.greatest(F.lit(least), rate - change)


def fit_rates(members: DataFrame, targets: np.ndarray, tables: Tables, most: int = 40, close: float = 1e-6, gain: float = 2e-3, least: float = 0.0) -> tuple[DataFrame, float]:
    """(``members`` with rate, the share of all tokens that is still off target) by projected-gradient least squares.

    Minimises the squared distance of the expected tokens of each domain (sum over rows of n_tokens * rate * p) from
    ``targets``, from rates of 1 (or ``least``). A step is rate = max(least, rate - p . step); the gradient of a row is scaled by
    1 / n_tokens and by the inverse of sum n_tokens p p' over the rows that may move (those above ``least``, and those that the
    gradient raises), which reaches the targets at once if the projection met no other row. Where such a step brings the domains no
    nearer, the plain gradient is taken, with the step that always does. Each pass is two aggregates over the compact table of
    memberships, of one number for each domain and pair of domains; rates are written every fourth step, so that no pass repeats
    more than four. It ends within ``close``, after ``most`` passes, or when a pass gains less than ``gain`` of the
    distance (targets out of reach, where the tests come to 0.3% of all tokens of the best); the second result says how far the rates are off."""
    k = len(targets)
    p = [F.get(F.col("p"), F.lit(i)) for i in range(k)]
    numbers = lambda table, sums: [x or 0.0 for x in table.agg(*(x.alias(f"c{i}") for i, x in enumerate(sums))).first()]
    off_of = lambda table: np.array(numbers(table, [F.sum(F.col("n_tokens") * F.col("rate") * x) for x in p])) - targets

    def gram(table: DataFrame, off: np.ndarray) -> np.ndarray:
        free = (F.col("rate") > least) | (sum((x * F.lit(float(d)) for x, d in zip(p, off, strict=True)), F.lit(0.0)) < 0)
        m = np.zeros((k, k))
        m[np.triu_indices(k)] = numbers(table.where(free), [F.sum(F.col("n_tokens") * p[i] * p[j]) for i in range(k) for j in range(i, k)])
        return m + np.triu(m, 1).T

    total = max(float(np.abs(targets).sum()), 1e-12)
    table = members.withColumn("rate", F.lit(max(1.0, least)))
    off, kept = off_of(table), 0
    for _ in range(most):
        far = np.linalg.norm(off)
        if far <= close * total:
            break
        m = gram(table, off)
        # the second bound holds for the rows that may move, as the others stay
        for step in (np.linalg.pinv(m, rcond=1e-9, hermitian=True) @ off, off / max(float(np.linalg.norm(m, 2)), 1e-12)):
            tried = table.withColumn("rate", moved(F.col("rate"), step, least))
            now = off_of(tried)
            if np.linalg.norm(now) < far * (1 - gain):
                break
        if np.linalg.norm(now) >= far * (1 - gain):
            break
        table, off, kept = tried, now, kept + 1
        if kept % 4 == 0:
            table = tables.write(table, "rates")
    return table, float(np.abs(off).sum()) / total


def mix_to_targets(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 4000, total: float | None = None, temper: float = 0.5, keep_all: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, domain, posterior, rate, copies, off_target, and the columns of ``keep``) for every row of ``docs``.

    labelled: (id, domain). A classifier learnt from at most ``train_rows`` of them (those with the smallest hashed ids)
    gives every document a posterior over the domains; nonnegative rates are fitted so that the expected tokens of each
    domain match ``weights`` (domain -> share; by default the present shares to the power ``temper``). total: tokens to
    reach (default: as many as there are). keep_all scales the total up until no domain has to shrink and keeps every
    rate at 1 or more, so that the targets are met by repeating documents. copies = the whole part of the rate, plus 1 where the
    hashed id falls below the rest. off_target, the same in all rows, is the share of all tokens by which the fitted rates miss the
    targets: about 0, unless targets are out of reach (a domain that hardly any text shows).

    Tokens are the classifier's own (runs of word or other visible characters). Texts that are null or empty have none
    and a rate by their prior; a null id is hashed as such; labelled rows with null id or domain do not train; without
    any, there is one domain and the rates are all the same. Repeated rows are rated each. Other columns are ignored. An
    empty table gives an empty result."""
    members, domains = posteriors(docs, labelled, id_col, text_col, train_rows, [*(weights or {})], keep)
    tables = Tables(docs.sparkSession)
    members = tables.write(members, "memberships")
    k = len(domains)
    got = members.agg(*(F.sum(F.col("n_tokens") * F.get(F.col("p"), F.lit(i))).alias(f"t{i}") for i in range(k))).first()
    have = np.array([x or 0.0 for x in got])
    want = np.array([weights.get(d, 0.0) for d in domains]) if weights else have**temper
    want = want / max(want.sum(), 1e-12)
    reach = total or have.sum()
    if keep_all:
        reach = max(reach, float(np.max(np.where(want > 0, have / np.maximum(want, 1e-12), 0), initial=0)))
    least = 1.0 if keep_all else 0.0
    fitted, off = fit_rates(members, want * reach, tables, least=least)
    rated = fitted.withColumn("rate", F.round("rate", 9))
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return rated.select(id_col, "n_tokens", F.get(F.array(*map(F.lit, domains)), best).alias("domain"), F.round(F.array_max("p"), 9).alias("posterior"), "rate", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("long").alias("copies"), F.lit(round(off, 9)).alias("off_target"), *keep)
