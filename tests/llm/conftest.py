import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, token string, component string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with columns whose names clash with those that operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), f"k{i}", "x", "y") for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """Words of invented prose."""

    def make(n, seed=0, stem=""):
        r = random.Random(seed)
        syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of"]
        return " ".join(stem + "".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Rows of the kinds that every operator has to bear."""
    long = prose(60_000, 1)
    return [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "A b\nc  d\n\ne"), (6, long), (7, "ä ö ñ é 日本語 🙂 x"), (8, "same text"), (8, "same text"), (None, "no id here"), (9, "x" * 200_000), (10, "\x00\x01 ctrl")]
