import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dagframe.llm import _attention as A
from dagframe.llm._shared import Scratch
from dagframe.llm.lm_scoring import VOCABULARY, Subwords, embedding, lm_scores, load_ranks, op7_lm_scoring, subword_counts, subword_table, train_model, word_and_pair_counts

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(rows):
    tokens = [(i, re.findall("[^\x20\x09-\x0d]+", (t or "").translate(_FOLD)) + [None]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for (_, ws), h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (_, ws), h in zip(tokens, held)]


@pytest.mark.parametrize("max_words", [10**6, 25])
def test_baseline_and_whole_texts(docs, words, max_words):
    rows = [(k, words(k, 30 + k, 60 + k)) for k in range(40)] + [(50, None), (51, ""), (None, "W1 w2"), (7, words(7, 37, 67)), (60, "x" * 5000), (61, words(61, 6000, 300)), (62, "\u00a0 é\u2028")]
    got = sorted(lm_scores(docs(rows), max_words=max_words).collect(), key=lambda r: (r["id"] is None, r["id"], r["n_tokens"]))
    want = sorted(zip([i for i, _ in rows], base(rows)), key=lambda r: (r[0] is None, r[0], r[1][1]))
    assert [tuple(r)[:5] for r in got] == [(i, *w[:4]) for i, w in want]
    assert np.allclose([r["base_score"] for r in got], [w[4] for _, w in want])
    assert all(r["score"] < 0 for r in got)
    again = [r["score"] for r in got if r["id"] == 7]
    assert len(again) == 2 and again[0] == pytest.approx(again[1], rel=1e-6)


def test_empty(docs):
    assert lm_scores(docs([])).collect() == []


def model(size=40):
    rng = np.random.default_rng(0)
    ids = np.cumsum(rng.integers(1, 3, 4000)) % (size - 1)
    x, y, _ = A.blocks(ids, np.array([0, 2000, 4000]), size - 1)
    p = A.initial(*A.embed(x, y, size))
    p["within"] = A.within_class(np.bincount(ids, minlength=size).astype(float), p["class_of"])
    key, n = np.unique(ids[:-1] * size + ids[1:], return_counts=True)
    return p | A.pair_tables(p["class_of"], key, n), x, y, ids


def test_blocks_score_each_token_once():
    ids, bounds = np.arange(150), np.array([0, 70, 70, 150])
    x, y, text = A.blocks(ids, bounds, 999)
    assert sorted(y[y >= 0].tolist()) == list(range(150)) and set(text[:3]) == {0}
    for r in range(len(x)):
        for k in range(A.SPAN):
            if y[r, k] >= 0:
                before = x[r, A.CONTEXT + k]
                assert before == (999 if y[r, k] in (0, 70) else y[r, k] - 1)


def test_attention_is_causal():
    p, x, y, _ = model()
    a = A.log_probs(p, x[:4], y[:4])
    z = x.copy()
    z[:, A.CONTEXT + 10 :] = 3
    b = A.log_probs(p, z[:4], y[:4])
    assert np.allclose(a[:, :10], b[:, :10]) and not np.allclose(a[:, 10:], b[:, 10:])


def test_probabilities_sum_to_one():
    p, x, y, _ = model()
    total = sum(np.exp(A.log_probs(p, x[:1], np.full((1, A.SPAN), t))[0, 5]) for t in range(40))
    assert total == pytest.approx(1, abs=1e-5)


def test_training_learns_and_gradients_are_right():
    p, x, y, _ = model()
    q = A.train(p, x[:100], y[:100], epochs=8)
    loss = lambda p: -A.log_probs(p, x[100:], y[100:]).sum() / (y[100:] >= 0).sum()
    assert loss(q) < 0.8 * loss(p)
    p = {k: v.astype(np.float64) if v.dtype == np.float32 else v for k, v in p.items()}
    g = A._gradients(p, x[:3], y[:3])
    value = lambda p: -A.log_probs(p, x[:3], y[:3]).sum() / (y[:3] >= 0).sum()
    for name in A.NAMES:
        at = tuple(s // 2 for s in p[name].shape)
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert (value(up) - value(down)) / 2e-4 == pytest.approx(g[name][at], rel=2e-2, abs=1e-5), name
    assert np.allclose(A.flatten(A.restore(q, A.flatten(q))), A.flatten(q))


@pytest.fixture
def trained(spark):
    """``(parameters, subword counts)`` of a table of (id, text) rows, all of which are learnt from."""

    def make(rows, parts=1):
        ranks, scratch = spark.sparkContext.broadcast(load_ranks(VOCABULARY)), Scratch(spark, "test")
        train = scratch.keep(subword_table(spark.createDataFrame(rows, "id long, text string").repartition(parts), ranks))
        every = scratch.keep(word_and_pair_counts(train, ranks))
        pairs = every.where("kind = 1").select("key", "n")
        counts = subword_counts(pairs, Subwords(ranks.value).end + 1)
        return train_model(train, pairs, counts, ranks, scratch), counts

    return make


def test_all_training_documents_train(trained, words):
    rows = [(k, words(k, 60)) for k in range(12)]
    every = A.flatten(trained(rows)[0])
    assert np.array_equal(every, A.flatten(trained(rows[::-1], 3)[0]))
    for k in (0, 5, 11):
        turned = [(i, " ".join(t.split()[::-1]) if i == k else t) for i, t in rows]
        assert not np.allclose(every, A.flatten(trained(turned)[0]), atol=1e-4)


def test_embedding_sees_all_training_texts(trained, words):
    rows = [(k, words(k, 60)) for k in range(20)] + [(99, words(99, 1500) + " zebra xylophone w1 zebra quux")]
    p, counts = trained(rows)
    assert np.abs(p["E"][:-1][counts > 0]).max(axis=1).min() > 0
    ids = Subwords(load_ranks(VOCABULARY)).ids([w.encode() for _, t in rows for w in t.split()])[0]
    assert set(np.flatnonzero(counts)) == {*ids.tolist(), len(counts) - 1}


def test_embedding_in_parts_is_that_of_the_whole(spark, words):
    ranks, scratch = spark.sparkContext.broadcast(load_ranks(VOCABULARY)), Scratch(spark, "test")
    sub = Subwords(ranks.value)
    texts = [words(k, 10 + k, 300) for k in range(40)]
    each = [[*sub.ids([w.encode() for w in t.split()])[0].tolist(), sub.end] for t in texts]
    flat, bounds = np.concatenate(each), np.cumsum([0] + [len(e) for e in each])
    want = A.embed(*A.blocks(flat, bounds, sub.end)[:2], sub.end + 1)
    train = subword_table(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), ranks)
    pairs = word_and_pair_counts(train, ranks).where("kind = 1").select("key", "n")
    counts = subword_counts(pairs, sub.end + 1)
    assert np.array_equal(counts, np.bincount(flat, minlength=sub.end + 1))
    got = embedding(pairs, counts, scratch)
    assert np.allclose(got[0], want[0], atol=1e-2) and (got[1] == want[1]).mean() > 0.999


def plain_log_prob(p, ids, k, start):
    """Natural log probability of ``ids[k]``, by the definition in doubles."""
    p = {n: v.astype(float) if v.dtype == np.float32 else v for n, v in p.items()}
    line = [start, *ids]
    first = max(0, k // A.SPAN * A.SPAN - A.CONTEXT)
    e = p["E"][line[first : k + 1]]
    query = e[-1] @ p["Wq"] / np.sqrt(A.WIDTH)
    a = np.exp([query @ (e[j] @ p["Wk"]) + p["R"][len(e) - 1 - j] for j in range(len(e))])
    h = np.tanh((a / a.sum()) @ (e @ p["Wv"]) @ p["Wo"] + e[-1] @ p["Wh"] + p["b"])
    share = lambda z, at: z[at] - np.log(np.exp(z).sum())
    group, member = divmod(int(p["class_of"][ids[k]]), A.MEMBERS)
    got = share(h @ p["Wg"] + p["bg"], group) + share(h @ p["Wm"][group] + p["bm"][group], member)
    return got + A.within(p, np.array([line[k]]), np.array([ids[k]]))[0]


def test_scores_against_the_definition(spark, docs, trained, words):
    rows = [(k, words(k, 20 + 15 * k, 80)) for k in range(12)]
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    p, _ = trained(learnt)
    sub = Subwords(load_ranks(VOCABULARY))
    got = {r["id"]: r["score"] for r in lm_scores(docs(rows)).collect()}
    for i, t in rows:
        ids = [*sub.ids([w.encode() for w in t.split()])[0].tolist(), sub.end]
        want = sum(plain_log_prob(p, ids, k, sub.end) for k in range(len(ids))) / math.log(10)
        assert got[i] == pytest.approx(want, rel=1e-4)


def test_partitions_do_not_matter(docs, words):
    table = docs([(k, words(k, 30 + k, 300)) for k in range(60)] + [(None, "w1 w2"), (3, words(3, 33, 300))])
    one, many = (sorted((repr(r["id"]), r["score"]) for r in lm_scores(table.repartition(n)).collect()) for n in (1, 12))
    assert [i for i, _ in one] == [i for i, _ in many]
    assert np.allclose([s for _, s in one], [s for _, s in many], rtol=1e-6)


def test_held_out_no_worse_than_word_counts(spark):
    found = op7_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").toPandas()
    assert found["score"].sum() >= found["base_score"].sum()


def test_window_and_classes():
    p, x, y, _ = model(500)
    a = A.log_probs(p, x[5:6], y[5:6])
    z = x[5:6].copy()
    z[0, 0] = (z[0, 0] + 200) % 499
    assert A.CONTEXT >= 32 and not np.array_equal(a[0, 0], A.log_probs(p, z, y[5:6])[0, 0])
    assert len(set(p["class_of"].tolist())) > 100


@pytest.mark.parametrize("max_pairs", [0, 60])
def test_pairs_beyond_the_table_count_too(docs, words, max_pairs):
    table = docs([(k, words(k, 30 + k, 300)) for k in range(40)] + [(None, "w1 w2"), (3, "never seen w7"), (50, None)])
    want, got = (sorted((repr(r["id"]), r["n_tokens"], r["score"]) for r in lm_scores(table, max_pairs=n).collect()) for n in (10**6, max_pairs))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], rtol=1e-6)


def test_words_of_earlier_chunks_are_not_cut_again(monkeypatch):
    import pyarrow as pa

    sub, cut, plain = Subwords(load_ranks(VOCABULARY)), [], Subwords.ids
    monkeypatch.setattr(Subwords, "ids", lambda self, words: cut.extend(words) or plain(self, words))
    line = " ".join(f"w{k} été{k}" for k in range(3000)) + " "
    texts = [line * 60, "other w1", line * 60, None, "w2  other new"]
    got = [ids[a:b].tolist() for _, _, ids, bounds in sub.texts(pa.array(texts)) for a, b in zip(bounds, bounds[1:])]
    # Some share a slot with another word and are cut again.
    assert len(set(cut)) == 6002 and len(cut) < 6100
    for text, ids in zip(texts, got):
        assert ids == [*plain(sub, [w.encode() for w in (text or "").split()])[0].tolist(), sub.end]


def test_memo_with_few_slots():
    keys = np.random.default_rng(0).integers(-500, 500, 4000)
    for bits in (1, 4, 12):
        memo = A.Memo(lambda k, _: k * 3.0, bits)
        assert all(np.array_equal(memo(part), part * 3.0) for part in np.split(keys, 10))


def test_large_logits():
    p, x, y, _ = model()
    p = p | {k: p[k] * np.float32(8) for k in ("Wq", "Wk", "Wg", "Wm")}
    room = A.Room()
    got, g = A.log_probs(p, x[:2], y[:2], room=room), A._gradients(p, x[:2], y[:2], room)
    assert np.isfinite(got).all() and all(np.isfinite(v).all() for v in g.values())
    with np.errstate(all="ignore"):
        assert A._forward(p, x[:2], room)[2].max() <= 1
    ids = [*y[y >= 0][:64].tolist()]
    want = [plain_log_prob(p, ids, k, x[0, A.CONTEXT]) for k in range(64)]
    assert np.allclose(got.ravel()[:64], want, rtol=1e-2, atol=1e-2)
