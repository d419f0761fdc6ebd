from __future__ import annotations

import random

import pytest

from tests.conftest import make_session

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "kept boolean, h string, doc string, key int, n_removed string"
)


@pytest.fixture(scope="session")
def spark():
    return make_session()


def passage(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


WORDS = [a + b for a in "ba de fi go hu ka le mi no pu ra se".split() for b in "na ter lom vik sant rel dup ñe über".split()]


def rows() -> list[tuple]:
    """Small corpus: copies, near copies, shared passages and lines, nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    shared, line = passage(rng, 60), "Common line at the foot of every page."
    texts: list[str | None] = [None, "", " ", "one", "a b c d", "\n\n", "x" * 5000, passage(rng, 9000)]
    base = passage(rng, 120)
    for k in range(10):
        words = base.split(" ")
        for _ in range(k):
            words[rng.randrange(len(words))] = "edit" + str(rng.randrange(99))
        texts.append(" ".join(words))
    texts += [base] * 5
    texts += [passage(rng, 40) + "\n" + line + "\n" + passage(rng, 30) for _ in range(14)]
    texts += [passage(rng, 50) + " " + shared + " " + passage(rng, 50) for _ in range(4)]
    texts += [passage(rng, rng.randrange(1, 90)) for _ in range(15)]
    out = [(i * 3, t, "en", f"site{i % 12}", len(t or ""), None, "x", "y", 1, "z") for i, t in enumerate(texts)]
    again = out[-1]
    return [*out, again, again, (None, passage(rng, 20), None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def corpus():
    return rows()


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
