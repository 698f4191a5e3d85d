"""Token counts under a unigram vocabulary by dynamic programming over a trie of pre-tokens.

A text is cut into pre-tokens: a word with the one white-space byte before it, or a single
white-space byte. Each task keeps one trie and inserts its new distinct pre-tokens, at most 20,000 at a
time. A trie node is a prefix and holds the best score of any segmentation of it and that
segmentation's length, computed once from the nodes above it: all pre-tokens that a task meets share
the work on their prefixes. Nodes that end a pre-token give its count. The pass has no exchange.

Scores of pieces are not fitted: tokenizers are taken as they are, and their files have ranks only.
"""

from __future__ import annotations

import base64
import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import extended
from ._words import _tables, hashes, mix

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A task forgets its pre-tokens' counts beyond so many and begins anew; results do not depend on it.
MAX_KNOWN = 400_000
#: The same for nodes of its trie.
MAX_NODES = 3_000_000
#: Longer pre-tokens are inserted one by one, shorter ones together.
LONG = 64
_PRETOKEN = re.compile(rb"[\x20\x09-\x0D]?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]")


def pretokens(text: bytes) -> list[bytes]:
    return _PRETOKEN.findall(text)


def load_vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    """Pieces and their log probabilities: of a file of ranked pieces, by Zipf's law on the rank."""
    with open(path, "rb") as f:
        ranked = [(base64.b64decode(piece), int(rank)) for piece, rank in (line.split() for line in f if line.strip())]
    total = math.log(sum(1 / (rank + 1) for _, rank in ranked))
    return {piece: -math.log(rank + 1) - total for piece, rank in ranked}


class PretokenTrie:
    """``counts(pretokens)``: pieces in the best segmentation of each; of equal scores, that whose last piece begins first.

    Nodes are found by 64-bit hashes of their prefixes, in sorted arrays that are merged as they grow.
    Pre-tokens that are new are inserted sorted, and the nodes that are new with them are scored level by
    level: a node looks at all pieces that end in it. ``nodes`` counts the nodes scored so far.
    """

    def __init__(self, vocabulary: dict[bytes, float], max_known: int = MAX_KNOWN, max_nodes: int = MAX_NODES):
        self.vocabulary, self.max_known, self.max_nodes, self.nodes = vocabulary, max_known, max_nodes, 0
        #: A byte that is no piece counts as one token, at a score below all pieces.
        self.unknown = min(vocabulary.values(), default=0.0) - 10.0
        pieces = sorted(vocabulary)
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        names = hashes(np.frombuffer(b"".join(pieces), np.uint8), ends - [len(p) for p in pieces], ends) if pieces else np.zeros(0, np.uint64)
        order = np.argsort(names)
        self._names, self._logps = names[order], np.array([vocabulary[p] for p in pieces])[order]
        self._bytes = np.array([vocabulary.get(bytes([k]), self.unknown) for k in range(256)])
        #: The longest piece that ends in these two bytes.
        self._longest = np.ones(1 << 16, np.int64)
        for p in pieces:
            if len(p) > 1:
                self._longest[p[-2] << 8 | p[-1]] = max(len(p), self._longest[p[-2] << 8 | p[-1]])
        self._clear()

    def _clear(self) -> None:
        self.terminal: dict[bytes, int] = {b"": 0}
        #: Node 0 is the root.
        self.size, self._score, self._pieces = 1, np.zeros(1024), np.zeros(1024, np.int32)
        self._index: list[tuple[np.ndarray, np.ndarray]] = []

    def counts(self, pretokens: list[bytes]) -> list[int]:
        known = self.terminal
        new = sorted({w for w in pretokens if w not in known})
        if len(known) + len(new) > self.max_known or self.size > self.max_nodes:
            self._clear()
            known = self.terminal
            new = sorted(set(pretokens) - {b""})
        short = [w for w in new if len(w) <= LONG]
        for k in range(0, len(short), 20_000):
            self._insert(short[k : k + 20_000])
        for w in new:
            if len(w) > LONG:
                known[w] = self._insert_long(w)
        return [known[w] for w in pretokens]

    def _find(self, names: np.ndarray) -> np.ndarray:
        """The nodes of prefixes, 0 where there is none yet."""
        out = np.zeros(len(names), np.int64)
        for keys, node in self._index:
            at = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
            out = np.where(keys[at] == names, node[at], out)
        return out

    def _add(self, names: np.ndarray) -> np.ndarray:
        """Nodes for prefixes that have none; their scores are still to be set."""
        node = np.arange(self.size, self.size + len(names))
        self.size, self.nodes = self.size + len(names), self.nodes + len(names)
        if self.size > len(self._score):
            more = max(self.size, 2 * len(self._score)) - len(self._score)
            self._score, self._pieces = np.append(self._score, np.zeros(more)), np.append(self._pieces, np.zeros(more, np.int32))
        order = np.argsort(names)
        if len(names):
            self._index.append((names[order], node[order]))
        while len(self._index) > 1 and len(self._index[-2][0]) < 2 * len(self._index[-1][0]):
            keys, nodes = (np.concatenate(x) for x in zip(self._index.pop(), self._index.pop()))
            order = np.argsort(keys, kind="stable")
            self._index.append((keys[order], nodes[order]))
        return node

    def _insert(self, words: list[bytes]) -> None:
        if not words:
            return
        size = np.array([len(w) for w in words])
        width = int(size.max())
        text = np.zeros((len(words), width), np.uint8)
        text[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        power, inverse = _tables(width + 1)
        total = np.zeros((len(words), width + 1), np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:width], axis=1, out=total[:, 1:])
        differs = text[1:] != text[:-1]
        shared = np.zeros(len(words), np.int64)
        shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
        depth = np.arange(1, width + 1)
        new = (depth > shared[:, None]) & (depth <= size[:, None])
        row, level = np.nonzero(new)
        names = mix(total[row, level + 1] + (level + 1).astype(np.uint64))
        found = self._find(names)
        fresh = np.flatnonzero(found == 0)
        found[fresh] = self._add(names[fresh])
        node = np.zeros((len(words), width + 1), np.int64)
        node[row, level + 1] = found
        # A prefix shared with the word above has that word's node.
        above = np.maximum.accumulate(np.where(new, np.arange(len(words))[:, None], 0), axis=0)
        node[:, 1:] = np.take_along_axis(node[:, 1:], above, axis=0)
        score, pieces = self._score, self._pieces
        order = fresh[np.argsort(level[fresh], kind="stable")]
        cuts = np.searchsorted(level[order], np.arange(width + 1))
        for d in range(1, width + 1):
            row_ = row[order[cuts[d - 1] : cuts[d]]]
            last = text[row_, d - 1]
            best = score[node[row_, d - 1]] + self._bytes[last]
            n = pieces[node[row_, d - 1]] + 1
            longest = np.minimum(self._longest[text[row_, d - 2].astype(np.int64) << 8 | last], d) if d > 1 else np.ones(len(row_), np.int64)
            for size_ in range(2, int(longest.max(initial=1)) + 1):
                at = np.flatnonzero(longest >= size_)
                r = row_[at]
                name = mix((total[r, d] - total[r, d - size_]) * inverse[d - size_] + np.uint64(size_))
                k = np.minimum(np.searchsorted(self._names, name), len(self._names) - 1)
                hit = np.flatnonzero(self._names[k] == name)
                at, r, k = at[hit], r[hit], k[hit]
                from_ = node[r, d - size_]
                s = score[from_] + self._logps[k]
                up = s >= best[at]
                best[at[up]], n[at[up]] = s[up], pieces[from_[up]] + 1
            at = node[row_, d]
            score[at], pieces[at] = best, n
        self.terminal.update(zip(words, pieces[node[np.arange(len(words)), size]].tolist()))

    def _insert_long(self, text: bytes) -> int:
        """One pre-token, node by node, from the longest prefix that the trie has. Nodes beyond ``max_nodes`` are not kept."""
        power, _ = _tables(len(text) + 1)
        total = np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * power[: len(text)])
        names = mix(total + np.arange(1, len(text) + 1, dtype=np.uint64))
        node = self._find(names)
        have = int(np.argmin(np.append(node, 0) > 0))
        room = max(0, min(len(text), have + self.max_nodes - self.size))
        score, pieces, logp = [0.0, *self._score[node[:have]].tolist()], [0, *self._pieces[node[:have]].tolist()], self.vocabulary.get
        for end in range(have + 1, len(text) + 1):
            best, n = score[-1] + logp(text[end - 1 : end], self.unknown), pieces[-1] + 1
            longest = int(self._longest[text[end - 2] << 8 | text[end - 1]]) if end > 1 else 1
            for start in range(end - 2, max(0, end - longest) - 1, -1):
                p = logp(text[start:end])
                if p is not None and score[start] + p >= best:
                    best, n = score[start] + p, pieces[start] + 1
            score.append(best)
            pieces.append(n)
        if room > have:
            node = self._add(names[have:room])
            self._score[node], self._pieces[node] = score[have + 1 : room + 1], pieces[have + 1 : room + 1]
        self.nodes += len(text) - max(have, room)
        return pieces[-1]


def count_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, max_known: int = MAX_KNOWN) -> DataFrame:
    """``docs`` with ``n_bytes, n_pretokens, n_tokens`` (long).

    Null text counts as empty: all three are 0. Repeated rows are counted each; columns with the
    results' names are replaced; an empty table gives an empty result. The vocabulary is read on the
    driver and broadcast (its size is fixed by the file).
    """
    docs = docs.drop("n_bytes", "n_pretokens", "n_tokens")
    fields, held = docs.schema, docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PretokenTrie(held.value, max_known)
        for b in batches:
            texts = [t or b"" for t in b.column(text_col).cast(pa.binary()).to_pylist()]
            words, tokens, part, size = [], [], [], 0
            for k, t in enumerate(texts):
                part.append(pretokens(t))
                words.append(len(part[-1]))
                size += len(t)
                if size > 1 << 20 or k == len(texts) - 1:
                    flat = trie.counts([w for p in part for w in p])
                    ends = np.cumsum([0] + [len(p) for p in part])
                    tokens.extend(np.diff(np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])[ends]).tolist())
                    part, size = [], 0
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), *(pa.array(x, pa.int64()) for x in (sizes, words, tokens))], [*(f.name for f in fields), "n_bytes", "n_pretokens", "n_tokens"])

    schema = extended(fields, "n_bytes long, n_pretokens long, n_tokens long")
    return docs.mapInArrow(counted, schema)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_pretokens", "n_tokens")
