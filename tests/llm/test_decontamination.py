import random

import pytest

from dagframe.llm import decontamination as D
from dagframe.llm.decontamination import WuManber, contamination, windows_of, words_of


def test_words():
    assert words_of("A-b_C,9é \u2028x\x00y") == [b"a", b"b", b"c", "9é".encode(), "\u2028x".encode(), b"y"] and words_of(None) == [] == words_of("-- ")


def brute(text, items, window=13):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            for p in range(len(words) - m + 1):
                if words[p : p + m] == w[k : k + m]:
                    hit.update(range(p, p + m))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_search_against_brute_force():
    r = random.Random(2)
    pats = {tuple(bytes(r.choices(b"ab", k=1)) for _ in range(r.choice([1, 2, 3, 5, 5, 9]))): {str(k)} for k in range(12)}
    text = [bytes(r.choices(b"abc", k=1)) for _ in range(400)]
    got = {(f, e, tuple(i)) for f, e, i in WuManber(pats).find(D._word_ids(text), text.__getitem__)}
    assert got == {(p, p + len(w), tuple(i)) for w, i in pats.items() for p in range(400) if tuple(text[p : p + len(w)]) == w}


@pytest.mark.parametrize("block", [500_000, 20])
def test_against_brute_force(docs, spark, words, block):
    items = [(k, words(k, 30)) for k in range(6)] + [(10, "short item here"), (11, "lone"), (12, ""), (13, None), (14, words(0, 30)), (None, "w1 w2")]
    rows = [(1, words(50, 60) + " " + words(0, 30)[:70] + "  x"), (2, "Lone. SHORT-item, here"), (3, None), (4, ""), (5, words(51, 400)), (6, words(3, 30)), (6, words(3, 30)), (None, "lone"), (8, words(52, 3000) + " lone")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs(rows).withColumnRenamed("n", "n_hit"), bench, block_words=block).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = brute(r["text"], [i for i in items if i[0] is not None])
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, found)
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n) and sum(s["end"] - s["first"] for s in r["hit_spans"]) == hit


def test_empty(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs([]), none).collect() == []
    assert [tuple(r[c] for c in ("n_words", "n_hit", "contaminated")) for r in contamination(docs([(1, "a b")]), none).collect()] == [(2, 0, False)]
    assert windows_of([(1, "a b")]) == {(b"a", b"b"): {"1"}}


def test_long_items_are_searched_in_parts(words):
    item = words(9, 300)
    parts = list(D._pieces(item, 13, 50))
    assert len(parts) > 4 and set(windows_of([(1, p) for p in parts])) == set(windows_of([(1, item)]))
    assert list(D._pieces("x" * 1000, 13, 50)) == ["x" * 1000] and list(D._pieces(None, 13, 50)) == [None]
