import random

import pytest

random.seed(3)
_words = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(2, 7))) for _ in range(300)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_words) for _ in range(n))


SCHEMA = "doc_id long, text string, source string, size long, `row` string, copies int, bucket int, term string, n long"


@pytest.fixture(scope="session")
def rows():
    """Nulls in each column, empty and very long texts, ties, repeated rows, columns with the operators' own names."""
    base = prose(60, 1)
    texts = [(1, base), (2, base), (3, base + " more"), (4, None), (5, ""), (None, prose(30, 2)), (6, "a  b\n c\t"), (7, prose(4000, 3)), (8, "é" * 300), (8, "é" * 300), (9, prose(50, 4) + " " + prose(20, 9)), (10, "x" * 5000), (11, prose(25, 5)), (12, prose(60, 6)), (13, "word"), (14, prose(40, 9))]
    return [(i, t, None if k % 5 == 0 else f"s{k % 3}", k, "r", None, k, "t", k) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
