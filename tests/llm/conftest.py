import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, extra=""):
        rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing column names."""
    long = " ".join(f"word{k % 977}" for k in range(30_000)) + "."
    rows = [
        (1, None, None, None, None, "x", 1),
        (2, "", "en", "a", 0, None, 2),
        (3, "  \n\t ", "en", "a", 5, "y", 3),
        (4, long, "en", "b", len(long), "z", 4),
        (4, long, "en", "b", len(long), "z", 4),
        (None, "no id here.", "en", "b", 11, "z", 4),
        (7, "Ünïcödé 😀 text. With two sentences!", "de", "c", 1, "w", None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, grp int")


@pytest.fixture()
def rng():
    return random.Random(11)
