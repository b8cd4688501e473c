import random

import pytest


@pytest.fixture(scope="session")
def words():
    """Seeded sentences over a small invented vocabulary."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice(["ka", "lo", "mi", "ten", "ra", "su", "vel"]) for _ in range(rnd.randrange(1, 4))) for _ in range(400)]

    def make(n: int, seed: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """A table with the columns of documents, extra ones with clashing names, from (id, text) pairs."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), "x", 1, 2) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, blob string, component_id int, id int")

    return make
