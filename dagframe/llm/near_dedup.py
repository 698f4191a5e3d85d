"""Near-duplicate documents by a chosen-path set similarity join.

A document's set of word shingles is reduced to ``COORDS`` minwise tokens. Documents with the same
set (told by 128-bit hashes) are one member of the join. Each of several trees branches the members
recursively: at a tree node every member follows the same one or two coordinates, chosen by a hash of
the path, into the child named by its token there, so that two sets of similarity s share a child with
probability about s, and more than one child in expectation where s is at the threshold or above.
Recursion ends where a node has at most ``LEAF`` members. Such nodes are compared exhaustively: on the
tokens first, and members with a partner in the node that may reach the threshold on their full sets.
The first trees link most of what there is to link; the other trees look only for links between
different components, and drop nodes of one component. A member's full set moves at most once for each
of its small nodes.

Nodes that hardly get smaller from a level to the next, are one component but for a few members, or
are large at level ``DEPTH``, hold copies of like texts. They are confirmed in blocks of at most ``BLOCK`` members: each block holds the node's
pivots too, and the members that the node's largest component leaves out are compared with every block
of the node. So no link between two components is missed, and copies cost time in proportion to their
number. The number of trees follows from the target recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Membership, Scratch, components, runs
from ._words import SPACED, longs, mix, word_hashes

COORDS = 64
DEPTH = 10
#: The chance of a second coordinate at a tree node.
EXTRA = 0.5
LEAF = 256
#: A child with this share of its parent's members, or with this share of its members in one component, is not branched any more.
DENSE = 0.8
#: Trees that are confirmed first.
FIRST = 2
#: At most so many large nodes are broadcast as a list of keys.
MAX_LARGE = 100_000
BLOCK = 512
PIVOTS = 16
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, COORDS, dtype=np.uint64) * _U(2) + _U(1)
_B = _RNG.integers(0, 1 << 63, COORDS, dtype=np.uint64)
_PLACE = _RNG.integers(0, 1 << 63, 32, dtype=np.uint64) * _U(2) + _U(1)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of ``k`` consecutive words; of fewer words, one for the whole sequence."""
    n = len(words)
    if not n:
        return words
    m = min(n, k)
    h = np.full(n - m + 1, m, _U)
    for j in range(m):
        h = h + mix(words[j : n - m + 1 + j] * _PLACE[j % 32] + _U(j))
    return np.unique(mix(h))


def set_hash(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Names a set in 128 bits, whatever the order of its elements."""
    return np.bitwise_xor.reduce(mix(s + _U(1)), initial=_U(0)) + _U(len(s)), np.add.reduce(mix(s * _U(3) + _U(7)), initial=_U(0))


def signature(s: np.ndarray) -> np.ndarray:
    """The ``COORDS`` minwise tokens (uint32) of a set that isn't empty."""
    low = None
    for a in range(0, len(s), 2048):
        part = ((s[a : a + 2048, None] * _A + _B) >> _U(32)).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low.astype(np.uint32)


def n_trees(threshold: float, recall: float, depth: int = DEPTH, extra: float = EXTRA) -> int:
    """Trees needed for a pair at the threshold to share a leaf at the last level with probability ``recall``.

    All trees draw from the same tokens, so the chance of a miss is averaged over how many of them agree.
    """
    agree = np.arange(COORDS + 1) / COORDS
    share = np.array([math.comb(COORDS, k) * threshold**k * (1 - threshold) ** (COORDS - k) for k in range(COORDS + 1)])
    p = np.ones(COORDS + 1)
    for _ in range(depth):
        p = (1 - extra) * agree * p + extra * (1 - (1 - agree * p) ** 2)
    trees = 1
    while share @ (1 - p) ** trees > 1 - recall:
        trees += 1
    return trees


def _children(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, child)``: each row's children in its tree node: one coordinate, and with probability ``EXTRA`` a second."""
    one = mix(node ^ _U(0xA5A5A5A5)) % _U(COORDS)
    two = (one + _U(1) + mix(node ^ _U(0x5A5A5A5A)) % _U(COORDS - 1)) % _U(COORDS)
    both = np.flatnonzero(mix(node ^ _U(0x3C3C3C3C)) % _U(1000) < _U(round(1000 * EXTRA)))
    rows = np.concatenate([np.arange(len(node)), both])
    coord = np.concatenate([one, two[both]]).astype(np.int64)
    return rows, mix(mix(node[rows] + _U(1)) * _U(3) + sig[rows, coord].astype(_U) * _A[coord] + coord.astype(_U))


def _matrix(col: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(-1, width)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _similar(sig: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``i < j`` whose tokens agree in at least ``floor`` of the places, most alike first."""
    n = len(sig)
    agree = np.zeros((n, n), np.uint8)
    for c in range(sig.shape[1]):
        agree += sig[:, c, None] == sig[None, :, c]
    i, j = np.nonzero(np.triu(agree >= math.ceil(floor * sig.shape[1]), 1))
    order = np.argsort(-agree[i, j].astype(np.int16), kind="stable")
    return i[order], j[order]


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, threshold: float = 0.8, recall: float = 0.999, leaf: int = LEAF, block: int = BLOCK, rows_named: bool = False) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``; with ``rows_named`` also ``hash``, xxhash64 of
    the text, and ``root``, which names the component itself (null without shingles).

    Words are runs of other than ASCII white space, A-Z lower-cased. Two documents are linked if
    the Jaccard similarity of their shingle sets is at least ``threshold``; ``component_id`` is the
    smallest id reachable over links, the document itself included, and ``kept`` tells whether that is
    its own. A text of fewer words than a shingle has one shingle, the whole sequence; one without
    words (or null) has none and is linked with nothing. Rows with a null id are members of the join
    like others, but never name a component unless all ids of it are null. Rows that repeat an id
    are judged by their texts. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"))
    floor = threshold - 5 * math.sqrt(threshold * (1 - threshold) / COORDS)
    percent = round(threshold * 10**6)

    def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words, bounds in word_hashes(b.column(1), SPACED):
                sets = [shingle_set(words[x:y], shingle) for x, y in zip(bounds[:-1], bounds[1:])]
                n = np.array([len(s) for s in sets])
                some = n > 0
                name = np.array([set_hash(s) for s in sets], _U).reshape(-1, 2).view(np.int64)
                sig = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *(pa.array(name[:, k].copy(), mask=~some) for k in (0, 1)), pa.array(sig, pa.binary()), b.column(2).slice(lo, hi - lo)],
                    ["id", "n", "n1", "n2", "sig", "hash"],
                )

    name = ["n1", "n2"]
    rows = scratch.keep(source.mapInArrow(described, "id long, n long, n1 long, n2 long, sig binary, hash long"))
    nodes = rows.where("n1 is not null").groupBy(*name).agg(F.min("id").alias("low"), F.max("sig").alias("sig"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()))
    tokens, total = nodes.select("node", "sig"), nodes.count()

    # The trees, level by level: (key, node, label), with the size of the node above. Labels are components so far.
    trees = n_trees(threshold, recall)
    at_level = "key long, node long, up long"

    def deeper(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                r, child = _children(b.column("key").to_numpy().view(_U), _matrix(b.column("sig"), np.uint32, COORDS))
                r = pa.array(r)
                yield pa.RecordBatch.from_arrays([longs(child), b.column("node").take(r), b.column("m").take(r)], ["key", "node", "up"])

    def partners(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of small nodes that have a partner of another label, told by tokens."""
        for run in runs(batches, ["key"]):
            sig, label = _matrix(run.column("sig"), np.uint32, COORDS), run.column("label").to_numpy()
            i, j = ([0], [1]) if len(sig) == 2 and (sig[0] == sig[1]).sum() >= floor * COORDS else _similar(sig, floor) if len(sig) > 2 else ([], [])
            apart = label[i] != label[j] if len(i) else np.zeros(0, bool)
            if apart.any():
                who = pa.array(np.unique(np.concatenate([np.asarray(i)[apart], np.asarray(j)[apart]])))
                yield pa.RecordBatch.from_arrays([run.column(c).take(who) for c in ("key", "node", "label")], ["key", "node", "label"])

    by_key = lambda t, *k: t.repartition(*k).sortWithinPartitions(*k)

    def label(t: DataFrame, classes: DataFrame | None) -> DataFrame:
        if classes is None:
            return t.withColumn("label", F.col("node"))
        return t.join(classes, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")

    def grown(first: int, last: int, classes: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """``(leaves, dense)`` of the trees from ``first`` on: members of small nodes with a partner there, and large nodes (grp, node, m) that are not branched."""

        def roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sig = _matrix(b.column(1), np.uint32, COORDS)
                for t in range(first, last):
                    r, child = _children(np.full(len(sig), t, _U), sig)
                    yield pa.RecordBatch.from_arrays([longs(child), b.column(0).take(pa.array(r)), pa.array(np.full(len(r), total))], ["key", "node", "up"])

        level, small, dense, done = tokens.mapInArrow(roots, at_level), None, None, []
        for depth in range(1, DEPTH + 1):
            held = scratch.keep(label(level, classes).select("key", "node", "label", "up"))
            sizes = held.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("up").alias("up"), F.min("label").alias("lo"), F.max("label").alias("hi"))
            sizes = scratch.keep(sizes.where("lo <> hi").select("key", "m", "up"))
            done += [held, sizes]
            big = sizes.where(F.col("m") > leaf).select("key", "m", ((F.col("m") >= DENSE * F.col("up")) | F.lit(depth == DEPTH)).alias("dense"))
            n_big, rest = big.count(), held.drop("up")
            if n_big:
                # Keys of large nodes are dealt with by a broadcast list, so that no task gets all members of one.
                listed = lambda t: F.broadcast(t) if n_big <= MAX_LARGE else t  # noqa: E731, B023
                big = scratch.keep(big)
                # Rows of large nodes are joined with their nodes once; what else is asked of these nodes is asked of the rows joined.
                large = scratch.keep(rest.join(listed(big), "key"))
                rest = rest.join(listed(big.select("key")), "key", "left_anti")
                closed = big.where("dense").select("key")
                if classes is not None:
                    most = large.groupBy("key", "m", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("key", "m").agg(F.max("k").alias("k"))
                    closed = closed.union(most.where(F.col("k") >= DENSE * F.col("m")).select("key")).distinct()
                closed = scratch.keep(closed)
                done += [big, large, closed]
                packed = large.join(listed(closed), "key", "left_semi").select(F.col("key").alias("grp"), "node", "m")
                dense = packed if dense is None else dense.union(packed)
                branched = large.join(listed(closed), "key", "left_anti")
            rest = rest.join(sizes.where(F.col("m") <= leaf).select("key"), "key", "left_semi")
            small = rest if small is None else small.union(rest)
            if not n_big or branched.isEmpty():
                break
            level = branched.join(tokens, "node").select("key", "node", "sig", "m").mapInArrow(deeper, at_level)
        leaves = scratch.keep(by_key(small.join(tokens, "node"), "key").mapInArrow(partners, "key long, node long, label long"))
        dense = scratch.keep(dense.withColumn("blk", F.pmod(F.xxhash64("node"), blocks).cast("int"))) if dense is not None else None
        scratch.drop(*done)
        return leaves, dense

    def full_sets(wanted: DataFrame) -> DataFrame:
        """``node, sig8, shingles`` of members, one copy of each."""
        may = scratch.keep(wanted.distinct().join(nodes.select("node", *name), "node"))
        known = Membership(may.select("n1"))

        def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, _, words, bounds in word_hashes(b.column(0), SPACED):
                    sets = [s for x, y in zip(bounds[:-1], bounds[1:]) if len(s := shingle_set(words[x:y], shingle))]
                    both = np.array([set_hash(s) for s in sets], _U).reshape(-1, 2).view(np.int64)
                    keep = np.flatnonzero(known.maybe(both[:, 0].copy()))
                    keep = keep[np.sort(np.unique(both[keep], axis=0, return_index=True)[1])] if len(keep) else keep
                    for k in range(0, len(keep), 256):
                        part = keep[k : k + 256]
                        yield pa.RecordBatch.from_arrays([*(pa.array(both[part, c]) for c in (0, 1)), pa.array([signature(sets[i]).astype(np.uint8).tobytes() for i in part], pa.binary()), pa.array([sets[i].tobytes() for i in part], pa.binary())], [*name, "sig8", "shingles"])

        sets = source.select("text").mapInArrow(members, "n1 long, n2 long, sig8 binary, shingles binary").join(may, name)
        return scratch.keep(sets.groupBy("node").agg(F.first("sig8").alias("sig8"), F.first("shingles").alias("shingles")))

    def confirmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links on full sets within each ``(grp, part)``, as many as connect what is linked; members of one ``label`` are connected already."""
        for run in runs(batches, ["grp", "part"]):
            node, at = np.unique(run.column("node").to_numpy(), return_index=True)
            run = run.take(pa.array(at))
            data = [np.frombuffer(s, _U) for s in run.column("shingles").to_pylist()]
            union, found = _Union(len(node)), []
            _, first, inverse = np.unique(run.column("label").to_numpy(), return_index=True, return_inverse=True)
            for x, k in enumerate(inverse.tolist()):
                union.join(int(first[k]), x)
            i, j = _similar(_matrix(run.column("sig8"), np.uint8, COORDS), floor)
            for x, y in zip(i.tolist(), j.tolist()):
                if union.find(x) != union.find(y):
                    p, q = data[x], data[y]
                    if 10**6 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                        both = len(np.intersect1d(p, q, assume_unique=True))
                        if 10**6 * both >= percent * (len(p) + len(q) - both):
                            union.join(x, y)
                            found.append((x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(node[[x for x, _ in found]]), pa.array(node[[y for _, y in found]])], ["a", "b"])

    cols = ["grp", "part", "node", "label", "sig8", "shingles"]
    blocks = F.ceil(F.col("m") / block).cast("int")
    confirm = lambda work, sets: by_key(work.join(sets, "node").select(cols), "grp", "part").mapInArrow(confirmed, "a long, b long")
    small_nodes = lambda leaves: leaves.select(F.col("key").alias("grp"), F.lit("").alias("part"), "node", "label")

    leaves, dense = grown(0, min(FIRST, trees), None)
    work = small_nodes(leaves)
    if dense is not None:
        pivots = dense.withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("node"), "node"))).where(F.col("_r") <= PIVOTS).drop("_r")
        spread = dense.select("grp", "blk", "node").union(pivots.select("grp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("blk"), "node"))
        work = work.union(spread.select("grp", F.col("blk").cast("string").alias("part"), "node", F.col("node").alias("label")))
    sets = full_sets(work.select("node"))
    links = scratch.keep(confirm(work, sets))
    classes = scratch.keep(components(links, scratch).toDF("node", "root"))

    # What the first trees left apart. Large nodes: members outside the node's largest component meet all of its blocks.
    others, more = grown(min(FIRST, trees), trees, classes)
    work = small_nodes(others)
    dense = more if dense is None else dense if more is None else dense.union(more)
    if dense is not None:
        labelled = label(dense, classes)
        per_label = labelled.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("k"))
        top = per_label.groupBy("grp").agg(F.max(F.struct("k", "label")).alias("top"), (F.sum("k") - F.max("k")).alias("others")).where("others > 0")
        top = top.select("grp", F.col("top.label").alias("top"), F.ceil(F.col("others") / block).cast("int").alias("rests"))
        labelled = scratch.keep(labelled.join(top, "grp"))
        every = labelled.withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).select("grp", F.concat_ws("-", "mine", "blk").alias("part"), "node", "label")
        mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("rests"))
        apart = labelled.where("label <> top").select("grp", "node", "label", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("blk"))
        work = work.union(every).union(apart.select("grp", F.concat_ws("-", "mine", "blk").alias("part"), "node", "label"))
    work = scratch.keep(work)
    unread = work.select("node").distinct().join(sets.select("node"), "node", "left_anti")
    links = scratch.keep(links.union(confirm(work, sets.union(full_sets(unread)))))
    classes = scratch.keep(components(links, scratch).toDF("node", "root"))
    scratch.drop(sets, leaves, others, work)

    named = nodes.join(classes, "node", "left").select(*name, "low", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select(*name, "component_id", "root")
    out = rows.select("id", "n", *name, "hash").join(named, name, "left")
    component = F.when(F.col("n1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    more = ["hash", "root"] if rows_named else []
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), *more)


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(ws[k:k + least(len(ws), 4) - 1], ' ') AS x
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT r AS a, r AS b FROM n UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
m AS (SELECT c.a AS r, min(w.doc_id) AS low FROM c JOIN w ON w.r = c.b GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(low, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(low, doc_id) AS kept
FROM w LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
