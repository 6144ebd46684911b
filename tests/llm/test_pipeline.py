import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from postmill.llm.mixing import mix_to_targets
from postmill.llm.queries import TOKENIZER, domains_of
from postmill.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.001"
CLASHING = ["n", "copies", "copy", "row_", "gone_", "gone_id", "rated_id", "rate", "component_id", "row_number_", "th", "id_", "text_"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents of the smallest tables and hand-made ones: null ids and texts, repeated rows, one id with two texts, near
    copies, passages of the benchmark, and columns named like those that stages use inside; written, as stages get them."""
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    base, other = text(120), text(90)
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) > 12)
    changed = base.split()
    changed[50] = "zzzzz"
    rows = [(None, base), (None, None), (9001, None), (9002, ""), (9003, " \n"), (9004, other), (9004, other), (9004, text(40)), (9005, base), (9006, " ".join(changed)), (9007, base + " end"), (None, other), (9008, text(9000)), (9009, text(30) + " " + item + " " + text(30)), (None, item)]
    known = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], known.schema)
    path = str(tmp_path_factory.mktemp("odd") / "documents")
    both = known.union(extra).withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    both.write.parquet(path)
    return spark.read.parquet(path)


def key(rows):
    return Counter(tuple(r) for r in rows)


def test_toxicity_drops_exactly_the_rows_it_predicts(spark, odd):
    got = corpus_pipeline.toxicity(spark, odd, SF)
    assert got.columns == odd.columns
    toxic = {r.text for r in score_toxicity(odd.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"), keep=("text",)).where("predicted = 1").collect()}
    assert key(got.collect()) == key(r for r in odd.collect() if r.text not in toxic) and 0 < len(toxic) < odd.count() / 2


def test_near_duplicates_equal_brute_force(spark, odd):
    got = corpus_pipeline.near_duplicate(spark, odd, SF)
    assert got.columns == odd.columns
    rows = odd.collect()
    sets = []
    for r in rows:
        w = re.split(r"[\x20\x09-\x0D]+", (r.text or "").translate({i: i + 32 for i in range(65, 91)}).strip(" \t\n\r\x0b\x0c"))
        w = [x for x in w if x]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(i)] = root(j)
    groups: dict = {}
    for i in range(len(rows)):
        groups.setdefault(root(i) if sets[i] else ("alone", i), []).append(i)
    want = [rows[min(g, key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0))] for g in groups.values()]
    assert key(got.select("doc_id", "text").collect()) == key((r.doc_id, r.text) for r in want) and len(want) < len(rows)


def test_decontamination_equals_brute_force(spark, odd):
    got = corpus_pipeline.decontamination(spark, odd, SF)
    assert got.columns == odd.columns
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = cut(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} if w else set()
    sizes = {len(x) for x in windows}

    def hit(t):
        w = cut(t)
        return any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))

    want = [r for r in odd.collect() if not hit(r.text)]
    assert key(got.collect()) == key(want) and len(want) < odd.count()


def test_mixing_repeats_rows_as_their_rates_say(spark, odd):
    got = corpus_pipeline.mixing(spark, odd, SF)
    assert got.columns == odd.columns
    every, out = key(odd.collect()), key(got.collect())
    assert set(out) == set(every) and all(out[r] >= n for r, n in every.items())
    labels = domains_of(odd.select("doc_id", "lang"), spark.read.parquet(f"{SF}/labels.parquet"))
    rated = mix_to_targets(odd.select("doc_id", "text"), labels, temper=0.9, keep_all=True, keep=("text",)).collect()
    want = Counter()
    for r in rated:
        assert r.rate >= 1 and int(r.rate) <= r.copies <= int(r.rate) + 1
        want[r.doc_id, r.text] += r.copies
    assert Counter((r[odd.columns.index("doc_id")], r[odd.columns.index("text")]) for r in got.collect()) == want
    assert rated[0].off_target < 0.02


def test_records_hold_what_the_tokenizer_gives(spark, odd):
    library = Tokenizer.from_file(TOKENIZER)
    got = sorted(tuple(r)[:4] for r in corpus_pipeline.token_output(spark, odd, SF).select("start", "n_tokens", "ids_crc32", F.coalesce("doc_id", F.lit(-1))).collect())
    start, want = 0, []
    for doc_id, text in sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), -1 if doc_id is None else doc_id))
        start += len(ids)
    assert got == want


@pytest.mark.parametrize("stage, operator", [("toxicity", "score_toxicity"), ("near_duplicate", "near_duplicates"), ("decontamination", "contamination"), ("mixing", "mix_to_targets")])
def test_verdicts_stay_on_their_rows_when_splits_change_between_jobs(spark, odd, monkeypatch, stage, operator):
    """The size of splits, and with it the number of tasks, changes before and after the operator's jobs."""
    want = key(getattr(corpus_pipeline, stage)(spark, odd, SF).collect())
    real, name = getattr(corpus_pipeline, operator), "spark.sql.files.maxPartitionBytes"

    def between(*args, **kwargs):
        spark.conf.set(name, "1k")
        out = real(*args, **kwargs)
        spark.conf.set(name, "64m")
        return out

    monkeypatch.setattr(corpus_pipeline, operator, between)
    spark.conf.set(name, "3k")
    try:
        got = getattr(corpus_pipeline, stage)(spark, odd, SF)
        spark.conf.set(name, "2k")
        assert key(got.collect()) == want
    finally:
        spark.conf.unset(name)


def test_run_applies_the_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "mixing", "token records"]
    last = corpus_pipeline.run(spark, SF).collect()
    known = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert 0 < len({r.doc_id for r in last}) < len(known) and {r.doc_id for r in last} <= known
    assert sorted(r.start for r in last)[0] == 0
    # what a stage reads and writes goes when the next table stands; the last stage reads one
    assert len(corpus_pipeline.Scratch.paths) == 1


def test_stages_handle_an_empty_table(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd.where("false"), SF)
        assert out.count() == 0 and (name == "token records" or out.columns == odd.columns)
