"""Operator 1: a toxicity classifier that is penalised where swapping identity terms changes its score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import bounded, held_out, prefixes, scored, training_rows
from .shared import slices, small_batches

#: Identity terms by language and kind: neutral names of groups; a term is swapped within its language. Fixed values.
IDENTITY = {
    "en gender": "women men woman man girls boys female male".split(),
    "en faith": "muslim muslims christian christians jewish jews jew hindu hindus buddhist buddhists atheist atheists".split(),
    "en origin": "black white asian asians african africans european europeans arab arabs latino latinos immigrant immigrants refugee refugees".split(),
    "en orientation": "gay lesbian straight bisexual heterosexual homosexual transgender trans queer".split(),
    "en ability": "disabled deaf blind autistic elderly young".split(),
    "fr gender": "femmes hommes femme homme".split(),
    "fr faith": "musulmans chrétiens juifs".split(),
    "fr origin": "immigrés réfugiés".split(),
    "de gender": "frauen männer frau mann".split(),
    "de faith": "muslime christen juden".split(),
    "de origin": "einwanderer flüchtlinge".split(),
    "es gender": "mujeres hombres mujer hombre".split(),
    "es faith": "musulmanes cristianos judíos".split(),
    "es origin": "inmigrantes refugiados".split(),
}
KIND = {term.casefold(): (kind, i) for kind, terms in IDENTITY.items() for i, term in enumerate(terms)}
FOUND = regex.compile(r"(?<![\p{L}\p{N}])(" + "|".join(sorted(KIND, key=len, reverse=True)) + r")(?![\p{L}\p{N}])", regex.I)
SENTENCE = regex.compile(r"[^.!?\n]+")
BITS, SIZES = 20, (4, 5, 6)


def swapped(sentence: str, by: int) -> str:
    """Each identity term replaced by the one that stands ``by`` places on in its kind (not by itself, where there is another)."""

    def other(m):
        kind, i = KIND[m[0].casefold()]
        n = len(IDENTITY[kind])
        return IDENTITY[kind][(i + 1 + by % (n - 1)) % n]

    return FOUND.sub(other, sentence)


def pairs(text: str, swaps: tuple[int, ...] = (0, 2, 6)) -> list[tuple[str, str]]:
    """(sentence, swapped sentence) for every sentence with an identity term."""
    if not FOUND.search(text):
        return []
    return [(s, swapped(s, k)) for s in SENTENCE.findall(text) if FOUND.search(s) for k in swaps]


def mentions() -> list[str]:
    """Each identity term by itself: what a neutral mention adds to any text."""
    return [term for terms in IDENTITY.values() for term in terms]


def csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(x) for x in rows])


def fit(examples: list[np.ndarray], labels: np.ndarray, differences: list[tuple[np.ndarray, np.ndarray]], penalty: float = 10.0, rounds: int = 60, rate: float = 0.3, l1: float = 1.5, least: int = 4):
    """(weights, bias) by AdaGrad on log loss + penalty * mean squared change of the logit over counterfactual pairs.

    differences: (buckets gained, buckets lost) of each pair. Features of fewer than ``least`` rows are left out, and l1
    (in rows: a feature whose rows' errors sum to less gets no weight) keeps those of chance ones at 0."""
    if not len(examples):
        return np.zeros(1 << BITS), 0.0
    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
    w, b = np.zeros(1 << BITS), float(np.log(share / (1 - share)))
    col, row = csr(examples)
    used, seen = np.unique(col, return_counts=True)
    used = used[seen >= least]
    if not len(used):
        return w, b
    at = np.minimum(np.searchsorted(used, col), len(used) - 1)
    col, row = at[used[at] == col], row[used[at] == col]
    gained, lost = csr([g for g, _ in differences]), csr([x for _, x in differences])
    dcol, drow = np.concatenate((gained[0], lost[0])), np.concatenate((gained[1], lost[1]))
    dval = np.concatenate((np.ones(len(gained[0])), -np.ones(len(lost[0]))))
    known = np.searchsorted(used, dcol)
    there = (known < len(used)) & (used[np.minimum(known, len(used) - 1)] == dcol)
    dcol, drow, dval = known[there], drow[there], dval[there]
    v, square, bsquare = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    n, pull = len(labels), penalty / max(len(differences), 1)
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, v[col], n), -30, 30)))
        e = weight * (p - labels) / n
        g = np.bincount(col, e[row], len(used))
        if len(differences):
            g += 2 * pull * np.bincount(dcol, dval * np.bincount(drow, dval * v[dcol], len(differences))[drow], len(used))
        square += g * g
        step = rate / np.sqrt(square)
        v -= step * g
        v = np.sign(v) * np.maximum(np.abs(v) - step * l1 / n, 0)
        bsquare += e.sum() ** 2
        b -= 0.1 * e.sum() / np.sqrt(bsquare)
    w[used] = v
    return w, b


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 6000, penalty: float = 10.0, folds: int = 5, fold: int = 0, pair_rows: int = 30000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, held_out, score, predicted, and the columns of ``keep``) for every row of ``docs``.

    The classifier is a logistic regression on the presence of hashed words and word beginnings, learnt from at most
    ``train_rows`` labelled rows (those with the smallest hashed ids) outside the held-out fold. Sentences of these rows
    that name a group are swapped to other groups of the same kind and language, and the fit is penalised by how far the
    swaps, and adding a term to a text, move its score, so a mention alone does not count as toxic. Of the swapped sentences
    ``pair_rows`` at most train (those with the smallest hashes). Every whole text is scored in one pass without a shuffle.

    Null and empty texts get the score of no features; null ids are held out; rows without or with a null label do not
    train; with no labelled rows at all every score is 0.5. Repeated rows are scored each. Only the named columns are
    read. An empty table gives an empty result."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(~held_out(id_col, folds, fold))

    def features(batches):
        for batch in batches:
            for part in slices(batch, "text_"):
                row, bucket = prefixes(part.column("text_"), BITS, SIZES)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                found = [p for text in part.column("text_").to_pylist() for p in (pairs(text) if text else [])]
                out = [(label, bucket[a:z].astype("<u4").tobytes(), b"") for label, a, z in zip(part.column("label_").to_pylist(), cuts[:-1], cuts[1:], strict=True)]
                if found:
                    sides = []
                    for side in zip(*found, strict=True):
                        r, x = prefixes(pa.array(side), BITS, SIZES)
                        at = np.searchsorted(r, np.arange(len(side) + 1))
                        sides.append([x[a:z] for a, z in zip(at[:-1], at[1:], strict=True)])
                    out += [(None, np.setdiff1d(y, x).astype("<u4").tobytes(), np.setdiff1d(x, y).astype("<u4").tobytes()) for x, y in zip(*sides, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["label_", "a", "b"])

    table = training_rows(docs, known, F.col(label_col).cast("int"), id_col, text_col, train_rows)
    table = table.mapInArrow(features, "label_ int, a binary, b binary")
    table = bounded(table.where("label_ is not null"), train_rows, "a", "label_").union(bounded(table.where("label_ is null"), pair_rows, "a", "b")).toArrow()
    label, a, b = (table.column(i).to_pylist() for i in range(3))
    ids = lambda raw: np.frombuffer(raw, "<u4").astype(np.int64)
    order = sorted((i for i, x in enumerate(label) if x is not None), key=lambda i: (a[i], label[i]))
    swaps = [(ids(x), ids(y)) for x, y in sorted((a[i], b[i]) for i, x in enumerate(label) if x is None)]
    term, bucket = prefixes(pa.array(mentions()), BITS, SIZES)
    swaps += [(bucket[term == i].astype(np.int64), np.zeros(0, np.int64)) for i in range(len(mentions()))]
    w, bias = fit([ids(a[i]) for i in order], np.array([label[i] for i in order], float), swaps, penalty)
    model = spark.sparkContext.broadcast((w.astype(np.float32), bias))

    def score(column):
        w, bias = model.value
        row, bucket = prefixes(column, BITS, SIZES)
        z = bias + np.bincount(row, w[bucket], len(column))
        return [1 / (1 + np.exp(-np.clip(z, -30, 30)))]

    out = scored(docs, id_col, text_col, [T.StructField("score", T.DoubleType())], score, keep)
    return out.select(id_col, held_out(id_col, folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *keep)
