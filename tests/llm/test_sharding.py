import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagframe.llm.sharding import _hypergeometric, communication_matrix, shuffle_to_shards


def test_matrix_margins_and_law():
    a = communication_matrix([5, 0, 7], [4, 4, 4], 3)
    assert a.sum(axis=1).tolist() == [5, 0, 7] and a.sum(axis=0).tolist() == [4, 4, 4]
    first = np.array([communication_matrix([6, 4], [5, 5], s)[0, 0] for s in range(4000)])
    assert abs(first.mean() - 3) < 0.05 and abs(first.var() - 6 * 0.25 * 4 / 9) < 0.05
    with pytest.raises(ValueError):
        communication_matrix([1], [2], 0)


def test_sampler_beyond_numpys_bound():
    rng = np.random.default_rng(0)
    good, bad, n = 2 * 10**9, 10**9, 1000
    x = np.array([_hypergeometric(rng, good, bad, n) for _ in range(3000)])
    assert abs(x.mean() - n * 2 / 3) < 1.5 and abs(x.std() - (n * 2 / 9) ** 0.5) < 0.6


def test_exact_sizes_and_slots(docs):
    rows = [(k, f"t{k}") for k in range(1001)] + [(None, "n")] * 3 + [(5, "t5")] * 2
    got = shuffle_to_shards(docs(rows), 7, block_rows=50).collect()
    assert Counter(r["text"] for r in got) == Counter(t for _, t in rows)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_seeds_and_repeats(docs):
    d = docs([(k, "") for k in range(300)])
    place = lambda seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in shuffle_to_shards(d, 4, seed=seed, block_rows=40).collect()}
    assert place(1) == place(1) != place(2)


def test_shards_are_uniform(docs):
    got = shuffle_to_shards(docs([(k, "") for k in range(4000)]), 4, block_rows=100).collect()
    half = Counter(r["shard"] for r in got if r["doc_id"] < 2000)
    assert all(420 < half[s] < 580 for s in range(4))
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["slot"]) if r["shard"] == 0]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.12


def test_fewer_rows_than_shards_and_none(docs):
    assert len(shuffle_to_shards(docs([(1, "a"), (2, "b")]), 5).collect()) == 2
    assert shuffle_to_shards(docs([]), 5).collect() == []


@pytest.mark.parametrize("alike", [10_000, 50])
def test_repeated_and_null_ids_part_like_any_rows(docs, alike):
    rows = [(k, f"t{k}") for k in range(4000)] + [(k, f"t{k}") for k in range(400)] + [(None, "n")] * 400 + [(None, f"u{k}") for k in range(400)]
    got = shuffle_to_shards(docs(rows), 8, block_rows=200, alike=alike).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    at = {}
    for r in got:
        at.setdefault((r["doc_id"], r["text"]), []).append((r["shard"], r["slot"]))
    pairs = [v for k, v in at.items() if len(v) == 2]
    assert len(pairs) == 400 and 25 < sum(a[0] == b[0] for a, b in pairs) < 80
    assert sum(a[0] == b[0] and abs(a[1] - b[1]) == 1 for a, b in pairs) < 5
    for same in (at[None, "n"], [v[0] for (i, t), v in at.items() if i is None and t != "n"]):
        per = Counter(s for s, _ in same)
        assert all(25 < per[s] < 80 for s in range(8))
        near = sum((s, k + 1) in set(same) for s, k in same)
        assert near < 0.2 * len(same)


def test_rows_that_differ_in_the_place_of_a_null_only(spark):
    kind = "doc_id long, a string, b string, c array<int>, d map<string,int>"
    rows = [(1, None, "x", None, None), (1, "x", None, None, None), (1, None, None, [None, 1], None), (1, None, None, [1, None], None), (1, None, None, None, {"k": None}), (1, None, None, None, {})]
    got = shuffle_to_shards(spark.createDataFrame(rows * 2, kind), 3).collect()
    assert Counter(repr(tuple(r)[:5]) for r in got) == Counter(map(repr, rows * 2)) and len({(r["shard"], r["slot"]) for r in got}) == 12


def test_query(spark):
    import zlib

    from dagframe.llm.sharding import op4_sharding

    folder = "/root/testdata/sf0.001"
    got = op4_sharding(spark, folder)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = got.collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {i: (len(t) + 1, zlib.crc32(t), "rows", None) for i, t in text.items()}
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in got}) == len(text) and all(r["slot"] < sizes[r["shard"]] for r in got)


def test_query_shuffles_whole_documents(spark, monkeypatch):
    """The operator gets all columns, texts too, and the digests are of the texts that it puts out."""
    from dagframe.llm import sharding

    folder, given = "/root/testdata/sf0.001", []

    def shuffled(df, *args):
        given.append(df)
        return shuffle_to_shards(df, *args).withColumn("text", F.concat("text", F.lit("!")))

    monkeypatch.setattr(sharding, "shuffle_to_shards", shuffled)
    got = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.op4_sharding(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert given[0].schema == docs.schema
    text = {r["doc_id"]: (r["text"] + "!").encode() for r in docs.where("text is not null").collect()}
    assert {i: got[i] for i in text} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in text.items()}
