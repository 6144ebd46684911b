import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id_ long, text_ string, c string, start int, n int"


def row(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, len(text or ""), 1, "x", "y", 2, 3)


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, copies and columns with the names that operators use inside."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(80) for _ in range(6)]
    texts = [None, "", " \n\t", "one", "one two", "a" * 5000, "12 34", base[0], base[0], base[0] + " end", "Start " + base[0], base[1].upper(), base[1], text(20000)]
    texts += [text(30) + ". " + rng.choice(base) + " " + text(rng.randint(0, 40)) for _ in range(25)] + [text(60) for _ in range(20)]
    rows = [row(i, t) for i, t in enumerate(texts)]
    rows += [rows[7], rows[2], row(None, base[2]), row(None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
