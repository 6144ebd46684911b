"""Collocations against plain counting, and the quicksort against a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from postmill.llm import phrases
from postmill.llm.phrases import mine_phrases, quicksort

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top, inside=80):
    f, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {x: n for x, n in f.items() if len(x[1]) > 1 and n >= least}
    most = Counter()
    for (lang, w), n in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                most[lang, w[i : i + k]] = max(most[lang, w[i : i + k]], n)
    out = {}
    for (lang, w), n in found.items():
        cuts = [(2000000 * n // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if 100 * most[lang, w] < inside * n:
            out.setdefault(lang, []).append((-score, -n, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, phrase.decode(), -n, left, right, total[lang], -score) for lang, every in out.items() for i, (score, n, phrase, left, right) in enumerate(sorted(every)[:top]))


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_quicksort_counts_what_is_frequent(depth):
    rng = np.random.default_rng(depth)
    suffixes = rng.integers(1, 6, (3000, 4)).astype(np.int64) * np.cumprod(rng.random((3000, 4)) > 0.15, axis=1)
    weight = rng.integers(1, 4, 3000)
    want = [Counter() for _ in range(depth)]
    for row, n in zip(suffixes.tolist(), weight.tolist(), strict=True):
        for k in range(depth):
            if row[k]:
                want[k][tuple(row[: k + 1])] += n
    for least in (1, 40):
        got = quicksort(suffixes, weight, least, depth)
        for k, (pointer, mass) in enumerate(got):
            assert {tuple(suffixes[p, : k + 1].tolist()): m for p, m in zip(pointer, mass.tolist(), strict=True)} == {x: n for x, n in want[k].items() if n >= least}
    assert [len(x[0]) for x in quicksort(suffixes[:0], weight[:0], 1, 2)] == [0, 0]


def corpus(n=400):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéfgÀ漢") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", ";", "\x0b", "\r\n", " - ", "\x00 "]
    rows = [(None, None), ("en", ""), ("en", " .;\n"), (None, "One Two three. One TWO three"), ("und", "one two three " * 20)]
    for i in range(n):
        text = "".join((rng.choice(["new york city hall", "in other words", "In Other"]) if rng.random() < 0.1 else rng.choice(words[: rng.choice([5, 60])])) + rng.choice(ends) for _ in range(rng.randint(1, 60)))
        rows.append((rng.choice(["en", "de", None]), text))
    return [*rows, *rows[:40], ("de", "the the " * 30_000), ("fr", "x " * 100)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, 3, "k") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, a int, n int, id int, key string").repartition(5)


@pytest.mark.parametrize("chunk, share", [(1 << 20, 2000), (50, 3), (1, 1)])
def test_phrases_equal_plain_counts(spark, monkeypatch, chunk, share):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "SHARE", share)
    rows = corpus()
    for least, top in ((30, 2000), (5, 25)):
        assert sorted(tuple(r) for r in mine_phrases(frame(spark, rows), least=least, top=top).collect()) == plain(rows, least, top)


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With hashes of 4 bits for the first seed, the count starts over."""
    rows = corpus(60)
    real = phrases.positions

    def coarse(part, seed):
        words, ids, piece = real(part, seed)
        return words, (ids & np.uint64(15)) + np.uint64(1) if seed == 7 else ids, piece

    monkeypatch.setattr(phrases, "positions", coarse)
    assert sorted(tuple(r) for r in mine_phrases(frame(spark, rows), least=5).collect()) == plain(rows, 5, 2000)


def test_no_phrases(spark, empty):
    assert mine_phrases(empty).collect() == []
    assert mine_phrases(frame(spark, [("en", "a b"), (None, None)])).collect() == []
