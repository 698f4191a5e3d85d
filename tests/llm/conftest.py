import random

import pytest


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) rows, with columns whose names clash with results and internals."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1, True, 2, None) for i, t in rows], "doc_id long, text string, shard string, n long, kept boolean, id int, `odd name` struct<`a.b`:int>")

    return make


@pytest.fixture
def words():
    """Random texts over a small vocabulary."""

    def make(seed, n, vocabulary=400):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return make
