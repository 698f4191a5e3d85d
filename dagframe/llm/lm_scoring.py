"""Language-model scores: a word-count baseline and a causal self-attention model on subword ids.

Texts are cut into subword ids once; the ids are written and all later passes read them. Both models
learn from all training documents. One pass counts their words and the pairs of neighbouring
subwords, which give the attention model its embedding, its classes and the subwords within a class.
Its weights are then trained in ``ROUNDS``: a round deals its share of the training documents, by hash,
to groups of about as many subwords; each group trains a copy of the weights in its own order, and
the copies are averaged by the blocks they saw. Groups follow from the documents alone and sums are
of whole numbers, so how the table is split doesn't change the weights, and the driver holds one set
of them. Scoring reads whole texts. Counts of the commonest words go to all tasks (``MAX_WORDS`` at
most), as do those of the commonest pairs (``MAX_PAIRS``); those of the others are joined.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _attention as A
from ._shared import Membership, Scratch
from ._words import LOWER, SPACED, chunks, hashes, longs, spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose counts every task holds.
MAX_WORDS = 300_000
#: Pairs of subwords, by which the model tells subwords of a class apart, and sums of them whose counts every task holds, the commonest; the others are joined.
MAX_PAIRS = 400_000
#: Training documents go to 16 parts by hash; a round takes those up to its mark and trains at its rate.
ROUNDS = ((1, 0.01), (6, 0.006), (16, 0.002))
#: Subwords of a training group: a part in 32 of all, within these bounds.
GROUP = (1 << 19, 1 << 23)
#: Subwords that are looked at together, in whole texts.
CHUNK = 1 << 19
#: Subwords of words that are held so as to cut each word once; beyond, they are forgotten.
HELD = 1 << 21
#: Fixed value: the pattern that this vocabulary's tokenizer cuts text by.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII, in UTF-8, at which the tokenizer looks across words.
_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def held_out(id: Column) -> Column:
    """Not learnt from: crc32 of the id as text leaves 2 modulo 7; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


class Subwords:
    """Subword ids of words, each read with a space before it; the end of a text is one id more."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.lengths = np.zeros(self.end, np.int64)
        #: Ids that begin a token of the baseline: a word, or the end of a text.
        self.begins = np.zeros(self.end + 1, bool)
        self.begins[self.end] = True
        for piece, rank in ranks.items():
            self.lengths[rank] = len(piece)
            self.begins[rank] = piece[:1] == b" "
        self.dtype = np.uint16 if self.end < 1 << 16 else np.int32
        self._forget()

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)``: the ids of all words, and where each word's begin."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        text = b" " + b" ".join(words)
        if _BLANK.search(text):
            each = [self.encoding.encode_ordinary((b" " + w).decode("utf-8", "replace")) for w in words]
            return np.concatenate(each).astype(np.int64), np.cumsum([0] + [len(e) for e in each])
        ids = np.array(self.encoding.encode_ordinary(text.decode("utf-8", "replace")), np.int64)
        starts = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        firsts = np.cumsum([0] + [len(w) + 1 for w in words])
        return ids, np.searchsorted(starts, firsts)

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first, last, ids, bounds)`` for runs of whole texts, A-Z lower-cased, each closed by the end."""
        for lo, hi, buf, off in chunks(texts):
            buf = LOWER[buf]
            starts, ends, bounds = spans(buf, off, SPACED)
            index = self._known(buf, starts, ends)
            n = np.diff(self.cuts)[index]
            total = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(total[-1]) + np.repeat(self.cuts[:-1][index] - total[:-1], n)
            out_bounds = total[bounds] + np.arange(len(bounds))
            out = np.full(out_bounds[-1], self.end, self.dtype)
            place = np.ones(len(out), bool)
            place[out_bounds[1:] - 1] = False
            out[place] = self.held[at]
            yield lo, hi, out, out_bounds

    def _known(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of words in ``held`` and ``cuts``, where they are put when they are first met."""
        if len(self.held) > HELD:
            self._forget()
        raw = buf.tobytes()

        def cut(_, places):
            ids, cuts = self.ids([raw[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist())])
            number = np.arange(len(places)) + len(self.cuts) - 1
            self.cuts = np.concatenate([self.cuts, cuts[1:] + len(self.held)])
            self.held = np.concatenate([self.held, ids.astype(self.dtype)])
            return number.astype(float)

        self.number.work = cut
        return self.number(hashes(buf, starts, ends).view(np.int64)).astype(np.int64)

    def _forget(self):
        self.held, self.cuts, self.number = np.zeros(0, self.dtype), np.zeros(1, np.int64), A.Memo(None)


def subword_table(docs: DataFrame, ranks) -> DataFrame:
    """``id, hash, ids`` for each row of ``docs(id, text)``; ``ids``: the text's subword ids as bytes."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(ranks.value)
        for b in batches:
            for lo, hi, ids, bounds in sub.texts(b.column(2)):
                data = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(bounds.astype(np.int64) * ids.itemsize), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), data.cast(pa.binary())], ["id", "hash", "ids"])

    return docs.select("id", F.xxhash64("text").alias("hash"), "text").mapInArrow(cut, "id long, hash long, ids binary")


def _read(column: pa.Array, sub: Subwords) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, ids, bounds)`` of runs of whole texts, from their bytes."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // np.dtype(sub.dtype).itemsize
    data, first = np.frombuffer(column.buffers()[2], sub.dtype), 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(off, off[first] + CHUNK, "right")) - 1)
        yield first, last, data[off[first] : off[last]].astype(np.int64), off[first : last + 1] - off[first]
        first = last


def _words(ids: np.ndarray, sub: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """``(place, key)`` of each word's first subword; ends of texts are no words."""
    starts = np.flatnonzero(sub.begins[ids])
    ends = np.append(starts[1:], len(ids))
    word = ids[starts] != sub.end
    return starts[word], hashes(ids, starts[word], ends[word])


def word_and_pair_counts(train: DataFrame, ranks) -> DataFrame:
    """``kind, key, n``: kind 0 counts words by their hashes, kind 1 subwords with the one before, ``before * size + id``."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, held, size = Subwords(ranks.value), ([], []), [0, 0]

        def flushed(kind):
            key, index = np.unique(np.concatenate([k for k, _ in held[kind]]), return_inverse=True)
            return key, np.bincount(index, np.concatenate([n for _, n in held[kind]])).astype(np.int64)

        def rows(kind, key, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), longs(key), pa.array(n)], ["kind", "key", "n"])

        for b in batches:
            for _, _, ids, bounds in _read(b.column(0), sub):
                before = np.concatenate([[sub.end], ids[:-1]])
                for kind, keys in enumerate((_words(ids, sub)[1], before * (sub.end + 1) + ids)):
                    held[kind].append(np.unique(keys, return_counts=True))
                    size[kind] += len(held[kind][-1][0])
                    if size[kind] > 1_000_000:
                        held[kind][:] = [flushed(kind)]
                        size[kind] = len(held[kind][0][0])
                        if size[kind] > 700_000:
                            yield rows(kind, *held[kind][0])
                            held[kind][:], size[kind] = [], 0
        for kind in (0, 1):
            if held[kind]:
                yield rows(kind, *flushed(kind))

    return train.select("ids").mapInArrow(counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def subword_counts(pairs: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    got = pairs.groupBy(F.pmod("key", F.lit(size)).alias("id")).agg(F.sum("n").alias("n")).toArrow()
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


def embedding(pairs: DataFrame, counts: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """``A.embed`` from all pairs; the driver gets sums and places whose size the vocabulary bounds."""
    size, width = len(counts), 2 * A.NEIGHBOURS
    top, used, spark = A.columns_of(counts), np.flatnonzero(counts), pairs.sparkSession

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy()
            row, column, n = A.neighbours(key // size, key % size, b.column(1).to_numpy(), top, size)
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(column.astype(np.int32)), pa.array(n)], ["row", "col", "n"])

    def dense(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            col, n = part.column(1), part.column(2)
            row = np.repeat(np.arange(part.num_rows), col.value_lengths().to_numpy())
            yield part.column(0).to_numpy(), A.features(row, col.flatten().to_numpy(), n.flatten().to_numpy(), part.num_rows)

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for b in batches:
            for _, x in dense(b):
                gram += x.T @ x
        if gram.any():
            yield pa.RecordBatch.from_arrays([pa.array([gram[np.triu_indices(width)].tobytes()], pa.binary())], ["gram"])

    split = pairs.select("key", "n").mapInArrow(cells, "row int, col int, n long")
    table = scratch.keep(split.groupBy("row").agg(F.collect_list("col").alias("col"), F.collect_list("n").alias("n")))
    gram = np.zeros((width, width))
    # At most a row for each subword, and so few tasks; their sums are whole numbers.
    for r in table.coalesce(4).mapInArrow(products, "gram binary").toLocalIterator():
        gram[np.triu_indices(width)] += np.frombuffer(r[0])
    along = spark.sparkContext.broadcast(A.axes(gram + np.triu(gram, 1).T))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, x in dense(b):
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array([p.tobytes() for p in (x @ along.value).astype(np.float32)], pa.binary())], ["row", "y"])

    got = table.mapInArrow(placed, "row int, y binary").toArrow()
    y = np.zeros((size, A.WIDTH), np.float32)
    if got.num_rows:
        y[got["row"].to_numpy()] = np.frombuffer(b"".join(got["y"].to_pylist()), np.float32).reshape(-1, A.WIDTH)
    scratch.drop(table)
    return A.classes(y[used], used, counts)


def commonest(counts: DataFrame, most: int) -> tuple[DataFrame, int | None]:
    """The ``most`` rows of ``counts(key, n)`` with the highest ``n`` at most; and the ``n`` from which they are all there is, if one tells."""
    least, room = 1, 0
    tiers = counts.groupBy(F.least("n", F.lit(1000)).alias("n")).count().orderBy("n").collect()
    room = sum(r[1] for r in tiers)
    for r in tiers:
        if room <= most:
            break
        room, least = room - r[1], r[0] + 1
    if room <= most and least <= 1000:
        return counts.where(F.col("n") >= least), least
    return counts.orderBy(F.desc("n"), "key").limit(most), None


def train_weights(p: dict, train: DataFrame, total: int, ranks) -> dict:
    """The weights after all ``ROUNDS`` over ``train(id, hash, ids)``, of ``total`` subwords."""
    spark = train.sparkSession
    part, begin = F.pmod(F.xxhash64("id", "hash", F.lit("part")), F.lit(16)), 0
    goal = min(max(total // 32, GROUP[0]), GROUP[1])
    for mark, rate in ROUNDS:
        groups = max(1, math.ceil(total * (mark - begin) / 16 / goal))
        order = F.xxhash64("id", "hash", F.lit(mark))
        rows = train.where((part >= begin) & (part < mark)).select(F.pmod(order, F.lit(groups)).cast("int").alias("group"), order.alias("order"), "id", "hash", "ids")
        rows = rows.repartition(min(4 * groups, 4096), "group").sortWithinPartitions("group", "order", "id", "hash").select("group", "ids")
        held, begin = spark.sparkContext.broadcast(p), mark

        def tuned(batches: Iterable[pa.RecordBatch], held=held, rate=rate) -> Iterator[pa.RecordBatch]:
            sub, trainer, now = None, None, None

            def weights():
                w = A.flatten(trainer.done()).astype(float)
                v = np.append(np.rint(w * 2**20), 1).astype(np.int64) * trainer.seen
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["k", "v"])

            for b in batches:
                sub = sub or Subwords(ranks.value)
                group = b.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if hi > lo and group[lo] != now:
                        if trainer:
                            yield weights()
                        trainer, now = A.Trainer(held.value, rate), group[lo]
                    for _, _, ids, bounds in _read(b.column(1).slice(lo, hi - lo), sub):
                        for x, y, _ in A.block_parts(ids, bounds, sub.end):
                            trainer.add(x, y)
            if trainer:
                yield weights()

        got = rows.mapInArrow(tuned, "k int, v long").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
        if got:
            v = np.array([float(r[1]) for r in sorted(got)])
            p = A.restore(p, v[:-1] / (v[-1] * 2**20))
        held.unpersist()
    return p


def train_model(train: DataFrame, pairs: DataFrame, counts: np.ndarray, ranks, scratch: Scratch, max_pairs: int = MAX_PAIRS) -> dict:
    """The model's parameters, with counts of the commonest pairs; without training documents, untrained ones with uniform classes."""
    return _trained(train, pairs, counts, ranks, scratch, max_pairs)[0]


def _trained(train: DataFrame, pairs: DataFrame, counts: np.ndarray, ranks, scratch: Scratch, max_pairs: int) -> tuple[dict, DataFrame | None]:
    """The parameters, and ``key, n`` of what their tables leave out, if anything: pairs and sums of pairs, with keys as ``A.untold`` names them."""
    rest, p = None, A.initial(*embedding(pairs, counts, scratch))
    p["within"] = A.within_class(counts, p["class_of"])
    if not counts.any():
        return p, None
    several = np.flatnonzero(np.bincount(p["class_of"], minlength=A.CLASSES) > 1)
    classes = train.sparkSession.createDataFrame([(int(k),) for k in np.flatnonzero(np.isin(p["class_of"], several) & (counts > 0))], "next int")
    told = pairs.withColumn("next", F.pmod("key", F.lit(len(counts))).cast("int")).join(F.broadcast(classes), "next", "left_semi").select("key", "n")
    size, class_of = len(counts), p["class_of"]

    def classed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(key // size * A.CLASSES + class_of[key % size]), b.column(1)], ["key", "n"])

    told = scratch.keep(told)
    heads = scratch.keep(told.mapInArrow(classed, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    tables = []
    for kind, all_of in enumerate((told, heads)):
        common, least = commonest(all_of, max_pairs)
        got = common.toArrow()
        tables += A.sorted_table(got["key"].to_numpy(), got["n"].to_numpy())
        if least != 1:
            others = all_of.select((-1 - F.col("key") if kind else F.col("key")).alias("key"), "n").where(F.col("n") < least if least else F.lit(True))
            rest = others if rest is None else rest.union(others)
    p |= dict(zip(("pairs", "pair_n", "heads", "head_n"), tables))
    return train_weights(p, train, int(counts.sum()), ranks), rest


def lm_scores(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY, max_words: int = MAX_WORDS, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """One row per input row: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens of the baseline are runs of other than ASCII white space, A-Z lower-cased, and one end for
    each text. ``base_score``: the sum over tokens of log10((c + 1) / (N + V + 1)), c the token's
    count in training, N all of them, V distinct ones; ``score``: log10 of the text's probability under
    the attention model, the end included. A null or empty text is its end alone. Rows with a null id
    are learnt from. Repeated rows count and are scored each, alike to some seven digits; an empty table gives an empty result.
    Words are told apart by 64-bit hashes of their subword ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    cut = scratch.keep(subword_table(source, ranks))
    train = cut.where(~held_out(F.col("id")))
    every = scratch.keep(word_and_pair_counts(train, ranks))
    words, pairs = (every.where(F.col("kind") == k).select("key", "n") for k in (0, 1))
    counts = subword_counts(pairs, Subwords(ranks.value).end + 1)
    ends = int(counts[-1])
    n_all, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, n_distinct = n_all + ends, n_distinct + (ends > 0)
    weights, rest_pairs = _trained(train, pairs, counts, ranks, scratch, max_pairs)
    model = spark.sparkContext.broadcast(weights)
    # Most pairs that the model's tables don't tell were never seen; the filter spares them the join.
    may = Membership(rest_pairs.select("key")) if rest_pairs is not None else None

    common, least = commonest(words, max_words)
    if least is None:
        common = scratch.keep(common)
    got = common.toArrow()
    order = np.argsort(got["key"].to_numpy().view(np.uint64))
    table = spark.sparkContext.broadcast((got["key"].to_numpy().view(np.uint64)[order], got["n"].to_numpy()[order]))
    del got, order

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, known_n), p, sub = table.value, model.value, Subwords(ranks.value)

        def counted(key, _):
            key = key.view(np.uint64)
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            return np.where(known[at] == key, known_n[at], 0).astype(float) if len(known) else np.zeros(len(key))

        count, room, told = A.Memo(counted), A.Room(), A.within_memo(p)
        for b in batches:
            for lo, hi, ids, bounds in _read(b.column(1), sub):
                place, key = _words(ids, sub)
                c = count(key.view(np.int64))
                have = c > 0
                first = np.searchsorted(place, bounds)
                sums = np.concatenate([[0.0], np.cumsum(np.log10(c + 1.0))])
                n_known = np.concatenate([[0], np.cumsum(have)])
                other = np.concatenate([[0], np.cumsum(~have)])
                rest = key[~have]
                score, of, untold = np.zeros(hi - lo), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for x, y, text in A.block_parts(ids, bounds, sub.end):
                    score += np.bincount(text, A.log_probs(p, x, y, room=room, told=told).sum(axis=1), minlength=hi - lo)
                    if may:
                        some = y >= 0
                        at, pair = A.untold(p, x[:, A.CONTEXT :][some], y[some])
                        keep = may.maybe(pair)
                        of.append(text[np.nonzero(some)[0][at[keep]]])
                        untold.append(pair[keep])
                of = np.concatenate(of)
                untold = np.concatenate(untold)[np.argsort(of, kind="stable")]
                untold_at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=hi - lo))])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo), pa.array(np.diff(first) + 1), pa.array(np.diff(n_known[first])), pa.array(np.diff(sums[first])), pa.array(score / math.log(10)),
                        pa.ListArray.from_arrays(pa.array(other[first].astype(np.int32)), longs(rest)), pa.ListArray.from_arrays(pa.array(untold_at.astype(np.int32)), pa.array(untold)),
                    ],
                    ["id", "n_tokens", "n_known", "common", "score", "rest", "untold"],
                )

    rows = cut.select("id", "ids").mapInArrow(scored, "id long, n_tokens long, n_known long, common double, score double, rest array<long>, untold array<long>")
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()))
    others = words.where(F.col("n") < least) if least is not None else words
    rare = rows.select("row", F.explode("rest").alias("key")).join(others, "key")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("n") + 1)).alias("more"))
    unit = math.log10(n_all + n_distinct + 1)
    known = F.coalesce("more_known", F.lit(0)) + F.col("n_known") + (1 if ends else 0)
    base = F.col("common") + F.coalesce("more", F.lit(0.0)) + math.log10(ends + 1) - F.col("n_tokens") * unit
    score = F.col("score")
    rows_out = rows.join(rare, "row", "left")
    if may:

        def deltas(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                add = A.told_later(model.value, b.column(0).to_numpy(), b.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(add / math.log(10))], ["key", "add"])

        later = rows.select("row", F.explode("untold").alias("key")).join(rest_pairs.mapInArrow(deltas, "key long, add double"), "key")
        rows_out = rows_out.join(later.groupBy("row").agg(F.sum("add").alias("add")), "row", "left")
        score = score + F.coalesce("add", F.lit(0.0))
    scratch.drop(cut)
    return rows_out.select(
        "id", held_out(F.col("id")).alias("held_out"), "n_tokens", known.cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
    )


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
