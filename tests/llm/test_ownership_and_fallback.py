"""Owners and repositories of secrets against plain counting; nearest neighbours without help of the graph, and of several lengths."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import nearest as near
from postmill.llm.nearest import nearest
from postmill.llm.secret_scan import find_secrets

RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24), ("owned", r"[A-Za-z0-9+_-]{20,}", 0, 20),
]


def verdicts(rows):
    """(id, n_assign, n_access, n_hex, spans, n_live, n_examples, most_owners, most_repositories) by plain counting."""
    found, owners, repositories = [], defaultdict(set), defaultdict(set)
    for _, text, source, lang in rows:
        spans = []
        for no, (kind, pattern, group, least) in enumerate(RULES):
            for m in re.finditer(pattern, text or ""):
                v = m.group(group)
                mixed = all(re.search(x, v) for x in ("[a-z]", "[A-Z]", "[0-9]")) and len(set(v)) >= 12
                inside = any(m.start() < e and s < m.end() for s, n, _, e, _ in spans if n < 3)
                if len(v) >= least and (no < 3 or mixed and not inside):
                    spans.append((m.start(), no, kind, m.end(), v))
        found.append(spans)
        for x in spans:
            owners[x[4]].add(source)
            repositories[x[4]].add((source, lang))
    out = []
    for (i, *_), spans in zip(rows, found, strict=True):
        example = [len(owners[x[4]]) >= 3 or len(repositories[x[4]]) >= 4 for x in spans]
        own = [len(owners[x[4]]) == 1 and not e for x, e in zip(spans, example, strict=True)]
        live = sum(o and bool(re.search("[0-9]", x[4])) and len(set(x[4])) >= 8 for x, o in zip(spans, own, strict=True))
        kept = sorted(x for x, o in zip(spans, own, strict=True) if x[1] < 3 or o)
        counts = [sum(x[2] == k for x in spans) for k in ("assign", "access", "hex")]
        most = [max((len(y[x[4]]) for x in spans), default=0) for y in (owners, repositories)]
        out.append((i, *counts, ",".join(f"{k}:{s}:{e}" for s, _, k, e, _ in kept), live, sum(example), *most))
    return sorted(out, key=repr)


def test_owners_and_repositories_decide(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcDEF0123456789ghiJKL") for _ in range(n))
    values = [make(rng.choice([8, 24, 30])) for _ in range(12)] + ["AKIA" + "QWERTY0123456789", "0123456789abcdef01234567"]
    shapes = ["token={}", "x {} y", "password: '{}'", "api_key={} and {}", "{}"]
    rows = []
    for i in range(150):
        shape = rng.choice(shapes)
        text = shape.format(*(rng.choice(values[: rng.choice([3, 14])]) for _ in range(shape.count("{}"))))
        rows.append((i, text if rng.random() > 0.05 else None, rng.choice(["s0", "s0", "s1", "s2", None]), rng.choice(["en", "de", "fr", "es", None])))
    spread = make(24)
    rows += [(500 + i, f"secret={spread}", "alone", lang) for i, lang in enumerate(["en", "de", "fr", "es"])]
    single = make(26)
    rows += [(600 + i, f"key {single} end", "one", lang) for i, lang in enumerate(["en", "de", "fr"])]
    rows += [(700, "word " * 40_000 + f"token={make(20)}", "s9", "en"), (701, "", "s9", "en")]
    names = ["doc_id", "n_assign", "n_access", "n_hex", "spans", "n_live", "n_examples", "most_owners", "most_repositories"]
    df = spark.createDataFrame([(*r, 1, "a", "b", 2, "c", 3) for r in rows], "doc_id long, text string, source string, lang string, id_ int, text_ string, owner string, h int, x string, owners int")
    got = sorted((tuple(r[c] for c in names) for r in find_secrets(df).collect()), key=repr)
    assert got == verdicts(rows)
    by = {r[0]: r for r in got}
    assert by[500][5:] == (0, 1, 1, 4)  # one owner, four repositories: a copied example
    assert by[600][4] == "owned:4:30" and by[600][5:] == (1, 0, 1, 3)


def brute(rows, k, each):
    out = set()
    for q, x in rows:
        if q % each:
            continue
        best = sorted(((-float(np.dot(x, y)), i) for i, y in rows if i != q and len(y) == len(x)))[:k]
        out |= {(q, i + 1, c) for i, (_, c) in enumerate(best)}
    return out


@pytest.mark.parametrize("bytes_", [32 << 20, 1000])
def test_the_whole_table_is_compared_where_blocks_do_not_do(spark, monkeypatch, bytes_):
    """With a recall that is never reached; the graph and blocks find too little, as each has one neighbour or two."""
    monkeypatch.setattr(near, "LARGEST", 1)
    monkeypatch.setattr(near, "BLOCK_BYTES", bytes_)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8)) for i in range(400)] + [(i, rng.standard_normal(5)) for i in range(1000, 1030)] + [(2000, rng.standard_normal(3)), (2020, rng.standard_normal(3)), (2040, rng.standard_normal(2))]
    rows += [(401, rows[0][1]), (402, rows[0][1])]
    df = spark.createDataFrame([(i, v.tolist(), 1, 2, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, id int, q int, cand string, place int")
    sizes = []
    real = near.compared
    monkeypatch.setattr(near, "compared", lambda *a: sizes.append(a[3]) or real(*a))
    got = nearest(df, F.col("id") % 20 == 0, k=7, width=2, back=1, trees=1, block=20, expand=1, recall=1.01)
    assert {(r.query_id, r.rank, r.vec_id) for r in got.collect()} == brute(rows, 7, 20)
    assert sorted(sizes) == [2, 3, 5, 8]
