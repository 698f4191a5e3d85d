import random
from collections import defaultdict

import pytest

from dagframe.llm.exact_dedup import MergeIndex, exact_duplicates, normalise


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_merge_index(keep):
    r, index, want = random.Random(1), MergeIndex(keep, memtable=7, fan_in=2), defaultdict(list)
    for id in range(300):
        d = bytes([r.randrange(90)])
        index.add(d, id)
        want[d].append(id)
    pick = min if keep == "smallest" else max
    assert {h[0]: h[1:] for h in index.hits()} == {d: (pick(v), len(v)) for d, v in want.items() if len(v) > 1}
    assert sum(map(len, index.tiers)) < 12


def test_runs_on_disk(tmp_path):
    """Long runs lie in files; memory holds short ones, and files go when they are merged."""
    r, index, want = random.Random(2), MergeIndex("smallest", memtable=20, fan_in=3, folder=f"file://{tmp_path}/runs"), defaultdict(list)
    for id in range(5000):
        d = r.randrange(3000).to_bytes(2, "big")
        index.add(d, id)
        want[d].append(id)
    live = [run for tier in index.tiers for run in tier]
    assert sum(run.path is not None for run in live) == len(list((tmp_path / "runs").iterdir())) > 2
    assert sum(len(run.entries) for run in live if run.path is None) < 80
    for run in live:
        for d in (b"\0\0", b"\5\5", b"\xff\xff"):
            assert run.find(d) == next((e for e in run if e[0] == d), None)
    got = list(index.hits())
    assert {h[0]: h[1:] for h in got} == {d: (min(v), len(v)) for d, v in want.items() if len(v) > 1} and len(got) == len({h[0] for h in got})
    assert list((tmp_path / "runs").iterdir()) == []


ROWS = [(1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (None, "same"), (7, "É"), (8, "é"), (9, "x" * 300_000), (10, "X" * 300_000), (11, "twice"), (11, "twice"), (None, "lost"), (None, "LOST")]


def brute(rows, largest):
    groups = defaultdict(list)
    for id, t in rows:
        groups[normalise((t or "").encode())].append(id)
    out = []
    for id, t in rows:
        g = groups[normalise((t or "").encode())]
        known = [x for x in g if x is not None]
        k = (max if largest else min)(known) if known else None
        out.append((id, k, len(g), id == k))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,digest_bytes,memtable", [("largest", 32, 1 << 16), ("smallest", 32, 2), ("largest", 1, 3), ("smallest", 0, 3)])
def test_against_brute_force(docs, keep, digest_bytes, memtable):
    rows = ROWS + [(100 + k, f"text {k % 40}") for k in range(120)]
    got = exact_duplicates(docs(rows).repartition(3), keep=keep, digest_bytes=digest_bytes, memtable=memtable).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute(rows, keep == "largest")


def test_large_group_is_salted(docs):
    got = exact_duplicates(docs([(k, "hot") for k in range(3000)]), keep="largest").collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(2999, 3000)} and len(got) == 3000
    got = exact_duplicates(docs([(None, "hot")] * 2000 + [(5, "hot")])).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(5, 2001)} and len(got) == 2001


def test_empty(docs):
    assert exact_duplicates(docs([])).collect() == []
