import random
import re
from collections import defaultdict

import numpy as np
import pytest

from dagframe.llm import near_dedup as N
from dagframe.llm.near_dedup import n_trees, near_duplicates, shingle_set, signature

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_FOLD))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k=5):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (id, _) in enumerate(rows):
        groups[find(i)].append(id)
    low = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((id, len(sets[i]), low[find(i)], id == low[find(i)]) for i, (id, _) in enumerate(rows)), key=repr)


def near(text, seed, changes):
    r, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
    return " ".join(w)


def check(docs, rows, **options):
    got = near_duplicates(docs(rows), **options).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, options.get("shingle", 5))


def test_edge_rows(docs):
    check(docs, [(5, "One two"), (4, "one  TWO"), (3, None), (2, ""), (1, " \t"), (9, "one two three"), (7, "one two"), (7, "one two"), (None, "one two"), (None, "alone"), (8, "x" * 200_000), (6, "X" * 200_000)])


def test_groups_at_the_threshold(docs, words):
    rows = []
    for g in range(12):
        base = words(g, 80, 5000)
        rows += [(100 * g + k, near(base, 100 * g + k, k % 4)) for k in range(12)]
    random.Random(0).shuffle(rows)
    check(docs, rows)


@pytest.mark.parametrize("leaf,block", [(4, 8), (4, 30)])
def test_large_groups_are_split_without_loss(docs, words, leaf, block):
    """A base text and copies that are linked through it, or through one another, in nodes and blocks far smaller."""
    base, other = words(1, 150, 5000), words(2, 150, 5000)
    rows = [(k, near(base, k, 4)) for k in range(90)] + [(500, base)] + [(600 + k, near(other, k, 1)) for k in range(40)]
    check(docs, rows, leaf=leaf, block=block)


def test_empty(docs):
    assert near_duplicates(docs([])).collect() == []
    check(docs, [(1, "a b c d e f"), (2, "g h i j k l")])


def test_pieces():
    assert n_trees(0.8, 0.999) >= 8 and n_trees(0.9, 0.99) < n_trees(0.8, 0.999)
    w = np.arange(1, 3001, dtype=np.uint64)
    s, t = shingle_set(w, 5), shingle_set(w[:2400], 5)
    assert len(s) == 2996 and abs(np.mean(signature(s) == signature(t)) - 0.8) < 0.2
    assert len(shingle_set(w[:3], 5)) == 1 and len(shingle_set(w[:0], 5)) == 0
    assert N._similar(np.zeros((3, 64), np.uint8), 0.5)[0].tolist() == [0, 0, 1]


def test_trees_reach_the_recall():
    """Pairs at the threshold that have to survive all levels, through the trees as they are."""
    r, n, trees = np.random.default_rng(5), 30_000, n_trees(0.8, 0.999)
    a = r.integers(0, 1 << 32, (n, N.COORDS), dtype=np.uint32)
    b = np.where(r.random(a.shape) < 0.8, a, a ^ np.uint32(1))
    found = np.zeros(n, bool)
    for t in range(trees):
        pair, node = np.arange(n), np.full(n, t, np.uint64)
        for _ in range(N.DEPTH):
            rows, x = N._children(node, a[pair])
            y = N._children(node, b[pair])[1]
            pair, node = pair[rows][x == y], x[x == y]
        found[pair] = True
    assert (~found).mean() < 0.0016


def test_members_that_share_much_and_link_nothing(docs, words):
    """Pairs at a similarity of some 0.6 are candidates everywhere; no component of candidates is formed from them."""
    base = words(77, 150, 10**6)
    rows = [(k, base + " " + words(1000 + k, 40, 10**6)) for k in range(300)] + [(900, base + " " + words(1000, 40, 10**6) + " z")]
    check(docs, rows, leaf=32, block=64)


def test_recall_at_the_threshold(docs, words):
    """Measured: pairs of similarity 0.80 to 0.82, each a component of its own, with the operator's own leaf."""
    rows = []
    for k in range(400):
        w = words(k, 104, 10**6).split()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:-11] + [f"z{k}x{j}" for j in range(10 + k % 2)]))]
    got = {r["id"]: r["component_id"] for r in near_duplicates(docs(rows)).collect()}
    want = {i: c for i, _, c, _ in brute(rows)}
    linked = [i for i in want if i % 2 and want[i] != i]
    assert len(linked) > 150 and sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i] == want[i] for i in want if want[i] == i)


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = N.op2_near_dedup(spark, folder)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 4)


def test_rows_of_large_nodes_meet_their_nodes_once(docs, words, monkeypatch):
    """Inner joins by the key of a tree node make as many rows as the large nodes have, in the later trees too."""
    base = words(3, 150, 5000)
    rows = [(k, near(base, k, 4)) for k in range(40)] + [(100, base + " " + words(4, 30, 5000))]
    made, kept, kind = [], [], type(docs([]))
    join, keep = kind.join, N.Scratch.keep

    def joined(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "key" and how is None:
            made.append(out.count())
        return out

    def counted(self, df):
        out = keep(self, df)
        if {"key", "node", "dense"} <= set(df.columns):
            kept.append(out.count())
        return out

    monkeypatch.setattr(kind, "join", joined)
    monkeypatch.setattr(N.Scratch, "keep", counted)
    check(docs, rows, leaf=8, block=16)
    assert len(kept) > 2 and sum(made) == sum(kept)
