import random

import numpy as np
import pyarrow as pa

from dagframe.llm._shared import Membership, Scratch, components, extended, runs, scratch_dir
from dagframe.llm._words import ALNUM, SPACED, chunks, hashes, spans


def test_components_against_union_find(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7), (None, 3), (4, None)]
    up = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for x in linked}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []


def test_membership_never_misses(spark):
    keys = [random.Random(1).getrandbits(63) - 2**62 for _ in range(2000)]
    m = Membership(spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long"))
    assert m.maybe(np.array(keys)).all()
    assert m.maybe(np.arange(10**6, 10**6 + 5000)).mean() < 0.1
    assert not Membership(spark.createDataFrame([], "k long")).maybe(np.arange(10)).any()


def test_runs_cross_batches():
    make = lambda ks: pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(range(len(ks)))], ["k", "v"])
    got = [r.column(0).to_pylist() for r in runs([make([1, 1]), make([]), make([1, 2]), make([2, 2]), make([3])], ["k"])]
    assert got == [[1, 1, 1], [2, 2, 2], [3]] and list(runs([], ["k"])) == []


def test_scratch_tables(spark):
    s = Scratch(spark, "test")
    t = s.keep(spark.range(5))
    assert t.count() == 5 and s.root.startswith(scratch_dir(spark))
    s.drop(t)
    s.keep(spark.range(2))
    s.close()
    path = spark._jvm.org.apache.hadoop.fs.Path(s.root)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert extended(spark.range(1).schema, "x array<int>").names == ["id", "x"]


def test_spans_and_hashes():
    texts = pa.array(["ab  Cd", None, "", "é x\ty", "ab", "b"]).slice(0)
    words = []
    for lo, hi, buf, off in chunks(texts, 4):
        starts, ends, bounds = spans(buf, off, SPACED)
        h = hashes(buf, starts, ends)
        for k in range(hi - lo):
            words.append([(bytes(buf[starts[j] : ends[j]]).decode(), int(h[j])) for j in range(bounds[k], bounds[k + 1])])
    assert [[w for w, _ in d] for d in words] == [["ab", "Cd"], [], [], ["é x", "y"], ["ab"], ["b"]]
    assert words[0][0] == words[4][0] and len({h for d in words for _, h in d}) == 5
    assert ALNUM.sum() == 10 + 26 + 128
