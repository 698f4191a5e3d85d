import math
import random

from dagframe.llm.token_counts import PretokenTrie, count_tokens, load_vocabulary, pretokens

WORDS = {b"a": -1.0, b"b": -1.5, b"ab": -2.0, b"ba": -1.9, b"aba": -3.1, b"bab": -2.5, b" a": -1.2}


def brute(text, vocabulary, unknown):
    """Best over all segmentations, the earliest start of the last piece at ties."""
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = [(best[s][0] + (vocabulary.get(text[s:end]) if text[s:end] in vocabulary else unknown), -s, best[s][1] + 1) for s in range(end) if text[s:end] in vocabulary or s == end - 1]
        top = max(options)
        best.append((top[0], top[2]))
    return best[-1][1]


def test_trie_against_brute_force():
    r = random.Random(5)
    some = [bytes(r.choice(b"abc ") for _ in range(r.randrange(12))) for _ in range(400)]
    for known in (10, 10_000):
        trie = PretokenTrie(WORDS, known)
        want = [brute(w, WORDS, trie.unknown) for w in some]
        assert trie.counts(some) == want and [trie.counts([w])[0] for w in some] == want


def test_prefixes_are_scored_once():
    trie = PretokenTrie(WORDS)
    trie.counts([b"abab", b"abaa", b"ab", b"abab"])
    assert trie.nodes == 5


def test_nodes_are_the_distinct_prefixes_of_all_calls():
    r, vocabulary = random.Random(8), load_vocabulary()
    some = [b" " + bytes(r.choice(b"thea") for _ in range(r.randrange(1, 9))) for _ in range(3000)] + [b"ab" * 100, b"ab" * 50 + b"c" * 60, b"ab" * 20]
    r.shuffle(some)
    trie = PretokenTrie(vocabulary)
    for k in range(0, len(some), 500):
        part = some[k : k + 500]
        assert trie.counts(part) == [brute(w, vocabulary, trie.unknown) for w in part]
    assert trie.nodes == len({w[:k] for w in some for k in range(1, len(w) + 1)}) == trie.size - 1


def test_long_pretokens_and_the_bound_on_nodes():
    text, want = b"ab" * 1000, None
    for bound in (10**6, 700):
        trie = PretokenTrie(WORDS, max_nodes=bound)
        want = want or brute(text, WORDS, trie.unknown)
        assert trie.counts([text, b"ab"]) == [want, 1] and trie.nodes in (2000, 2002) and trie.size <= bound + 3
        assert trie.counts([text + b"a", b"b" * 70]) == [brute(text + b"a", WORDS, trie.unknown), 70]


def test_pretokens_cover_the_text():
    for t in ("a  b\tc\n", "", " ", "é\u00a0x y", "\x00 \x1f"):
        assert b"".join(pretokens(t.encode())) == t.encode()


def test_public_vocabulary_and_edge_rows(docs):
    rows = [(1, "the cat"), (1, "the cat"), (2, None), (3, ""), (None, "ü\n\nthe " + "x" * 3000), (5, "the " * 50_000)]
    got = count_tokens(docs(rows).withColumnRenamed("n", "n_tokens")).collect()
    vocabulary = load_vocabulary()
    trie = PretokenTrie(vocabulary)
    assert abs(sum(math.exp(v) for v in vocabulary.values()) - 1) < 1e-9
    for r in got:
        cut = pretokens((r["text"] or "").encode())
        assert (r["n_bytes"], r["n_pretokens"], r["n_tokens"]) == (len((r["text"] or "").encode()), len(cut), sum(brute(w, vocabulary, trie.unknown) if len(w) < 50 else trie.counts([w])[0] for w in cut))
    assert len(got) == 6 and count_tokens(docs([])).collect() == []


def test_query(spark):
    from dagframe.llm.token_counts import op6_token_counts

    folder = "/root/testdata/sf0.001"
    got = op6_token_counts(spark, folder)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_bytes", "n_pretokens", "n_tokens")]
    vocabulary, known = load_vocabulary(), {}
    unknown = min(vocabulary.values()) - 10.0
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        cut = pretokens((r["text"] or "").encode())
        for w in cut:
            if w not in known:
                known[w] = brute(w, vocabulary, unknown)
        known[r["doc_id"], "all"] = (len((r["text"] or "").encode()), len(cut), sum(known[w] for w in cut))
    assert all((r["n_bytes"], r["n_pretokens"], r["n_tokens"]) == known[r["doc_id"], "all"] for r in got.collect())
