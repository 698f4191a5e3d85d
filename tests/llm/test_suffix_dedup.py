import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from dagframe.llm.suffix_dedup import SuffixQueue, op10_suffix_dedup, remove_repeats


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (id, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((id, len(t), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def check(docs, rows, length=200, **options):
    got = remove_repeats(docs(rows).repartition(3), length=length, **options).collect()
    assert sorted(((r["id"], r["n_bytes"], len(r["spans"] or ()), bytes(r["kept_text"])) for r in got), key=repr) == brute(rows, length)


def corpus(words):
    passage, line = words(900, 120), "Übung " * 60
    rows = [(k, words(k, 60, 10**6)) for k in range(20)]
    rows += [(100 + k, words(200 + k, 20 + k, 10**6) + " " + passage[k : 400 + 7 * k] + " " + words(300 + k, 9, 10**6)) for k in range(40)]
    rows += [(200, passage), (201, line), (202, "q" * 900), (203, passage[:199]), (204, passage[5:205]), (205, passage + passage), (206, None), (207, ""), (None, passage), (208, words(5, 60, 10**6)), (208, words(5, 60, 10**6)), (209, "é" * 150), (210, words(7, 3000, 10**6) + passage)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [5000, 3])
def test_against_brute_force(docs, words, hot):
    check(docs, corpus(words), hot=hot)
    check(docs, corpus(words), hot=hot, limit=4_000)


def test_other_lengths(docs):
    r = random.Random(4)
    rows = [(k, "".join(r.choice("ab") for _ in range(r.randrange(60)))) for k in range(60)]
    check(docs, rows, length=12, gram=4)
    check(docs, rows, length=12, gram=4, hot=2)


def test_nothing_repeats(docs, words):
    check(docs, [(1, words(1, 100, 10**6)), (2, words(2, 100, 10**6)), (3, "short")])
    assert remove_repeats(docs([])).collect() == []


def test_queue_is_sorted_and_bounded(tmp_path):
    r = random.Random(3)
    rows = [(r.randrange(-3, 3), bytes(r.choices(b"ab\0\xff", k=r.randrange(5))), k) for k in range(5000)]
    queue = SuffixQueue(f"file://{tmp_path}/queue", limit=8_000, rows=50)
    for k in range(0, len(rows), 700):
        names, suffixes, places = zip(*rows[k : k + 700])
        queue.push(pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(suffixes, pa.binary()), pa.array(places)], ["name", "suffix", "place"]))
    assert len(queue.runs) > 10 and queue.peak < 16_000
    got = [tuple(x.values()) for b in queue.pop() for x in b.to_pylist()]
    assert [g[:2] for g in got] == sorted(x[:2] for x in rows) and sorted(got) == sorted(rows)
    assert list((tmp_path / "queue").iterdir()) == [] and list(SuffixQueue("unused").pop()) == []


def test_query_against_brute_force(spark):
    """The windows of all documents, by 128-bit digests."""
    folder = "/root/testdata/sf0.01"
    got = op10_suffix_dedup(spark, folder)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    digests = {i: [hashlib.blake2b(t[k : k + 200], digest_size=16).digest() for k in range(len(t) - 199)] for i, t in rows}
    count = Counter(d for ds in digests.values() for d in ds)
    want = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k, d in enumerate(digests[i]):
            if count[d] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        want.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
