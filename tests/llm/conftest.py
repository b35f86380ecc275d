import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, rank long"


@pytest.fixture
def make_docs(spark):
    """Documents with extra columns whose names clash with those the operators use."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), -1, False, 7) for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(3)
    return ["".join(rng.choices("abcdefghinorst", k=rng.randint(2, 7))) for _ in range(900)]


@pytest.fixture
def odd_rows(vocabulary):
    """Null, empty, blank, very long, repeated and non-ASCII texts; a null source and id."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    long = text(9000)
    return [
        (0, None, "a"), (1, "", "a"), (2, " \n\t ", None), (3, long, "b"), (4, long, "b"),
        (5, "one", "c"), (6, "é😀 two\nthree", "c"), (6, "é😀 two\nthree", "c"), (7, text(80), None),
        (8, text(120) + "\n" + "same line here\n" * 5, "é"), (9, "a b c " * 60, "z"), (None, text(70), "b"),
        (10, "x" * 50_000, "b"), (11, "1 2 " * 5000, "b"), (-5, text(60), "a"),
    ]
