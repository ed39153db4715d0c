"""Small tables with the cases every operator must take."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, id int, size int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(1, 9))) for _ in range(n))


def rows():
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (60, 80, 200, 3, 1, 2)]
    words = base[2].split()
    words[50] = "changed"
    texts = [None, "", " \n\t ", *base, base[0], base[0], " ".join(words), "Ab <|endoftext|> don't 12!! ÉÀ ß\n\nß x", "x" * 5000, ("line one two three\n" * 40), sentence(rng, 3000), "a\r\x0bb\x1cc"]
    made = [(i, t, "en", "s", len(t or ""), 1, "k", 2, 3) for i, t in enumerate(texts)]
    return made + [made[4], made[4]]  # repeated rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in rows()]
