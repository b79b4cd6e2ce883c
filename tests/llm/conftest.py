"""Small documents with what can go wrong in them."""

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h long, shard int, `join` string"


def prose(seed: int, n: int, letters: str = "aeinorst") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows_of(texts, source="s"):
    return [(i, t, None, source, None, 1, 2, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, exact copies, repeated rows, a null id, and extra columns."""
    base = prose(1, 200)
    texts = [base, base, base + " tail", None, "", " \n\t", "one", "one two three", "ONE TWO THREE", prose(2, 400_000), prose(3, 50), prose(3, 50), "ÄÖ 123 é"]
    rows = rows_of(texts)
    rows += [rows[0], rows[3], (None, base, "en", None, None, 0, 0, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
