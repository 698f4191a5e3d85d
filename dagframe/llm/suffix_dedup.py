"""Removal of repeated passages by external induced sorting.

A passage is repeated if it is at least ``length`` bytes long and starts elsewhere too. Sorting all
suffixes of a corpus would order mostly suffixes that share nothing. So the starts are sampled as in
induced sorting: among the ``GRAM``-byte strings of each ``length``-byte window the one of least hash
is the window's anchor, which depends on the window's bytes alone, so that equal windows have equal
anchors at equal offsets. Anchors whose bytes occur once in the corpus are dropped.

The other anchors travel to shards as suffix tuples: the anchor's name, the bytes from it on, and the
bytes before it that its windows reach. A shard may be far larger than memory: it goes through a
priority queue on disk (``SuffixQueue``: sorted runs in the shared folder, merged through a heap) that
gives the tuples back by name and suffix, and neighbours in that order give common-prefix values. All
other suffixes of the windows are then induced from the sorted anchors, one byte to the left at a
time: the order by (byte, rank of the suffix after it) refines the ranks, and the common-prefix
values, which each step lengthens by one, tell which windows agree over their whole length.

Names with very many different tuples are taken apart before, by recursion (``_split``): windows that
start at offsets between ``lo`` and ``hi`` before the anchor share the bytes of their core, which
names them anew; the range is halved until no name has too many tuples for one task. The parts are
sorted and induced as the others.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Membership, Scratch, runs
from ._words import _tables, chunks, longs, mix

LENGTH = 200
GRAM = 48
#: Tuples of whole groups that are induced at once.
BATCH = 20_000
#: Names with more different tuples than this are split.
HOT = 1_000
#: Bytes of whole texts that are looked at together, about.
STEP = 1 << 20
#: Bytes of tuples that a queue holds in memory.
QUEUE = 32 << 20
_U = np.uint64


def _anchors(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, anchor, first, last, name)``: each anchor's byte place and the first and last start of its windows."""
    n, width = len(buf), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(_U)
    power, inverse = _tables(n + 1)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum((buf.astype(_U) + _U(1)) * power[:n], out=total[1:])
    name = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    key = (name & _U(0xFFFFFFFF00000000)) | np.arange(len(name), dtype=_U)
    blocks = np.full(-(-len(key) // width) * width, ~_U(0))
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(tail[:starts], head[width - 1 : width - 1 + starts])
    text = np.searchsorted(off, np.arange(starts), "right") - 1
    valid = np.arange(starts) + length <= off[text + 1]
    at = (least & _U(0xFFFFFFFF)).astype(np.int64)
    at[~valid] = -1
    cut = np.flatnonzero(np.diff(at, prepend=-2))
    last = np.append(cut[1:], starts) - 1
    keep = at[cut] >= 0
    cut, last = cut[keep], last[keep]
    return text[cut], at[cut], cut, last, name[at[cut]]


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def induced_repeats(name: np.ndarray, low: np.ndarray, high: np.ndarray, tuples: list[bytes], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """A mask, row by offset: whether the window that starts so far before the anchor has an equal.

    Rows are sorted by name, then by the bytes from the anchor on. ``tuples``: the bytes from ``high``
    before the anchor to ``length - low`` after it; offsets from ``low`` to ``high`` are asked for.
    """
    n, reach = len(name), length - gram
    size = np.array([len(t) for t in tuples])
    flat = np.frombuffer(b"".join(tuples), np.uint8)
    begin = np.cumsum(size) - size
    col = np.arange(length)
    inside = col[None, :] < (length - low)[:, None]
    suffix = np.where(inside, flat[np.minimum((begin + high)[:, None] + col, len(flat) - 1)], 0)
    differs = (suffix[1:] != suffix[:-1]) | ~inside[1:] | ~inside[:-1]
    prefix = np.full(n, -1)
    prefix[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    prefix[1:][name[1:] != name[:-1]] = -1
    rank = np.cumsum(prefix < 0)
    out = np.zeros((n, reach + 1), bool)
    live = np.arange(n)
    for o in range(reach + 1):
        live = live[high[live] >= o]
        if not len(live):
            break
        if o:
            byte = flat[(begin + high)[live] - o]
            _, rank[live] = np.unique(rank[live] * 256 + byte, return_inverse=True)
        same = np.bincount(rank[live])[rank[live]] > 1
        live = live[same]
        ask = live[low[live] <= o]
        if len(ask):
            klass = np.cumsum(prefix < length - o)
            _, which, count = np.unique(rank[ask] * (n + 1) + klass[ask], return_inverse=True, return_counts=True)
            out[ask, o] = count[which] > 1
    return out


class SuffixQueue:
    """A priority queue of rows by ``(name, suffix)`` that holds at most about ``limit`` bytes in memory.

    ``push`` takes rows; beyond the limit they are written as a sorted run to ``folder``. ``pop`` gives all
    rows back in order: a heap holds the least key of each run, and the run at its top gives its rows up
    to the next run's key. Runs are read ``rows`` rows at a time and deleted behind.
    """

    def __init__(self, folder: str, limit: int = QUEUE, rows: int = 1024):
        self.folder, self.limit, self.rows = folder, limit, rows
        self.held: list[pa.RecordBatch] = []
        self.size = self.peak = 0
        self.runs: list[str] = []
        self._fs = None

    def push(self, batch: pa.RecordBatch) -> None:
        for k in range(0, batch.num_rows, self.rows):
            part = batch.slice(k, self.rows)
            self.held.append(part)
            self.size += part.nbytes
            self.peak = max(self.peak, self.size)
            if self.size >= self.limit:
                self._spill()

    def _sorted(self) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(self.held).sort_by([("name", "ascending"), ("suffix", "ascending")])
        self.held, self.size = [], 0
        return table.to_batches(max_chunksize=self.rows)

    def _spill(self) -> None:
        if self._fs is None:
            self._fs, self.folder = fs.FileSystem.from_uri(self.folder)
            self._fs.create_dir(self.folder)
        path = f"{self.folder}/{uuid.uuid4().hex}"
        batches = self._sorted()
        with self._fs.open_output_stream(path) as out, pa.ipc.new_file(out, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for b in batches:
                w.write_batch(b)
        self.runs.append(path)

    def _read(self, path: str) -> Iterator[pa.RecordBatch]:
        with self._fs.open_input_file(path) as file:
            reader = pa.ipc.open_file(file)
            for k in range(reader.num_record_batches):
                yield reader.get_batch(k)
        self._fs.delete_file(path)

    def pop(self) -> Iterator[pa.RecordBatch]:
        sources = [self._read(path) for path in self.runs]
        if self.held:
            sources.append(iter(self._sorted()))
        heads = [next(s) for s in sources]
        key = lambda b, k: (b["name"][k].as_py(), b["suffix"][k].as_py())
        heap = [(*key(b, 0), k) for k, b in enumerate(heads)]
        heapq.heapify(heap)
        out, size = [], 0
        while heap:
            *_, k = heapq.heappop(heap)
            b = heads[k]
            n = bisect_right(range(b.num_rows), heap[0][:2], key=lambda r: key(b, r)) if heap else b.num_rows
            n = max(n, 1)
            out.append(b.slice(0, n))
            size += n
            heads[k] = b.slice(n) if n < b.num_rows else next(sources[k], None)
            if heads[k] is not None:
                heapq.heappush(heap, (*key(heads[k], 0), k))
            if size >= self.rows or not heap:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out, size = [], 0
        self.runs = []


def _split(rows: DataFrame, scratch: Scratch, length: int, reach: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """``(parts, spans)``: tuples under finer names that have at most ``hot`` different ones each, and what is settled on the way.

    Rows whose core occurs once are done. Rows with equal bytes and offsets repeat all of their windows
    (``id, hash, begin, stop``), and one of them stands for all, with their number as its weight; counts are
    combined before the exchange, so equal rows never meet in one task. At single offsets none are left.
    """
    columns = ["name", "low", "high", "weight", "id", "hash", "anchor", "bytes"]
    rest, parts, spans = rows.select(*columns).withColumns({"lo": F.lit(0), "hi": F.lit(reach)}), None, None
    while True:
        rest = rest.withColumn("mid", F.expr("cast((lo + hi) / 2 as int)"))
        near = rest.where("low <= mid").selectExpr("name", "lo", "mid as hi", "low", "least(high, mid) as high", "weight", "id", "hash", "anchor", "substring(bytes, high - least(high, mid) + 1) as bytes")
        far = rest.where("high > mid").selectExpr("name", "mid + 1 as lo", "hi", "greatest(low, mid + 1) as low", "high", "weight", "id", "hash", "anchor", "substring(bytes, 1, length(bytes) - greatest(low, mid + 1) + low) as bytes")
        node, row = ["name", "lo", "hi"], ["low", "high", "whole", "whole_2"]
        keyed = near.union(far).withColumns({
            "name": F.xxhash64("name", "lo", "hi", F.expr(f"substring(bytes, high - lo + 1, {length} - hi + lo)")),
            "whole": F.xxhash64("bytes"), "whole_2": F.xxhash64(F.lit("second"), "bytes"),
        })
        counted = keyed.groupBy(*node, *row).agg(F.sum("weight").alias("n"))
        shared = counted.groupBy(*node).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("different")).where("all > 1").drop("all")
        state = scratch.keep(keyed.join(counted, [*node, *row]).join(shared, node))
        full = state.where("n > weight").select("id", "hash", (F.col("anchor") - F.col("high")).alias("begin"), (F.col("anchor") - F.col("low") + length).alias("stop"))
        spans = full if spans is None else spans.union(full)
        one = state.groupBy(*node, *row).agg(F.max("n").alias("weight"), F.max("different").alias("different"), F.min(F.struct("id", "hash", "anchor", "bytes")).alias("r"))
        one = scratch.keep(one.select(*node, "low", "high", "weight", "different", "r.*"))
        small = one.where(f"different > 1 and different <= {hot}").select(*columns)
        parts = small if parts is None else parts.union(small)
        rest = one.where(f"different > {hot}").drop("different")
        if rest.isEmpty():
            return parts, spans


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, limit: int = QUEUE) -> DataFrame:
    """``id, hash, begin, stop``: byte ranges of ``docs(id, hash, text)`` that repeated windows cover; they may overlap."""

    def names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, off in chunks(b.column(0), STEP):
                name, n = np.unique(_anchors(buf, off, length, gram)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([longs(name), pa.array(n)], ["name", "n"])

    counts = docs.select("text").mapInArrow(names, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts.where("n > 1"))
    known = Membership(counts.select("name"))

    def tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, buf, off in chunks(b.column(2), STEP):
                text, anchor, first, last, name = _anchors(buf, off, length, gram)
                at = np.flatnonzero(known.maybe(name.view(np.int64)))
                if not len(at):
                    continue
                text, anchor, first, last, name = (x[at] for x in (text, anchor, first, last, name))
                stop = last + length
                raw = buf.tobytes()
                data = [raw[x:y] for x, y in zip(first.tolist(), stop.tolist())]
                seen: dict[tuple[int, bytes], int] = {}
                times = np.ones(len(at), np.int64)
                sent = np.ones(len(at), bool)
                # Equal tuples of a chunk are one tuple with a weight; all of their windows are repeated.
                for k, pair in enumerate(zip(name.tolist(), data)):
                    j = seen.setdefault(pair, k)
                    if j != k:
                        times[j] += 1
                        times[k] = 2
                        sent[k] = False
                place = pa.array(lo + text)
                base = off[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        longs(name), pa.array((anchor - last).astype(np.int32)), pa.array((anchor - first).astype(np.int32)), pa.array(times),
                        b.column(0).take(place), b.column(1).take(place), pa.array((anchor - base).astype(np.int32)), pa.array(data, pa.binary(), mask=~sent),
                    ],
                    ["name", "low", "high", "weight", "id", "hash", "anchor", "bytes"],
                )

    folder = f"{scratch.root}/queue"
    schema = "name long, low int, high int, weight long, id long, hash long, anchor int, bytes binary"
    every = scratch.keep(docs.select("id", "hash", "text").mapInArrow(tuples, schema))

    def induced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(held):
            t = pa.Table.from_batches(held).combine_chunks()
            name, low, high, anchor = (t[c].to_numpy() for c in ("name", "low", "high", "anchor"))
            mask = induced_repeats(name, low, high, t["bytes"].to_pylist(), length, gram)
            edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, least = np.nonzero(edge == 1)
            _, past = np.nonzero(edge == -1)
            take = pa.array(row)
            return pa.RecordBatch.from_arrays(
                [t["id"].combine_chunks().take(take), t["hash"].combine_chunks().take(take), pa.array((anchor[row] - past + 1).astype(np.int32)), pa.array((anchor[row] - least + length).astype(np.int32))],
                ["id", "hash", "begin", "stop"],
            )

        queue = SuffixQueue(folder, limit)
        for b in batches:
            queue.push(b)
        size = 0
        for run in runs(queue.pop(), ["name"]):
            if run.num_rows == 1:
                continue
            held.append(run)
            size += run.num_rows
            if size >= BATCH:
                yield settle(held)
                held, size = [], 0
        if held:
            yield settle(held)

    out = "id long, hash long, begin int, stop int"
    full = "id", "hash", (F.col("anchor") - F.col("high")).alias("begin"), (F.col("anchor") - F.col("low") + length).alias("stop")
    spans = every.where("weight > 1").select(*full)
    sent = every.where("bytes is not null")
    frequent = scratch.keep(counts.where(F.col("n") > hot).select("name"))
    if not frequent.isEmpty():
        parts, settled = _split(scratch.keep(sent.join(frequent, "name").select(*sent.columns)), scratch, length, length - gram, hot)
        sent, spans = sent.join(frequent, "name", "left_anti").select(*sent.columns).union(parts), spans.union(settled)
    queued = sent.withColumn("suffix", F.expr("substring(bytes, high + 1)")).repartition("name")
    return spans.union(queued.mapInArrow(induced, out))


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, limit: int = QUEUE) -> DataFrame:
    """One row per input row: ``id, n_bytes, spans, kept_text`` (binary) with every byte of a repeated window removed.

    A window of ``length`` bytes is repeated if its bytes start at any other place, in the same text or
    another (repeated rows are other texts). ``spans``: the maximal removed byte ranges. Null text counts
    as empty; texts shorter than ``length`` are kept whole. Null ids are allowed. An empty table gives
    an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))

    def union(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [_merged(zip(x, y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            both = pa.array([[{"begin": x, "stop": y} for x, y in s] for s in lists], pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), both], ["id", "hash", "spans"])

    found = repeated_spans(source, scratch, length, gram, hot, limit)
    lists = found.distinct().groupBy("id", "hash").agg(F.collect_list("begin").alias("begin"), F.collect_list("stop").alias("stop"))
    lists = scratch.keep(lists.mapInArrow(union, "id long, hash long, spans array<struct<begin:int,stop:int>>"))
    known = Membership(lists.select("hash"))

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("hit", pa.array(known.maybe(b.column("hash").to_numpy())))

    every = source.mapInArrow(split, "id long, hash long, text string, hit boolean")
    whole = every.where("not hit").select("id", F.lit(None).cast("array<struct<begin:int,stop:int>>").alias("spans"), "text")
    cut = every.where("hit").join(lists.withColumnRenamed("id", "_id").withColumnRenamed("hash", "_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left").select("id", "spans", "text")

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, texts = [], []
            for spans, data in zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                sizes.append(len(data))
                at, parts = 0, []
                for s in spans or ():
                    parts.append(data[at : s["begin"]])
                    at = s["stop"]
                texts.append(b"".join([*parts, data[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), b.column(1), pa.array(texts, pa.binary())], ["id", "n_bytes", "spans", "kept_text"])

    return whole.union(cut).mapInArrow(kept, "id long, n_bytes long, spans array<struct<begin:int,stop:int>>, kept_text binary")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.coalesce("spans", F.array().cast("array<struct<begin:int,stop:int>>"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept_text")).cast("long").alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"), F.sha2("kept_text", 256).alias("kept_sha256"),
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT r, k, hash(substr(h, 2 * k + 1, 400)) AS m
  FROM (SELECT r, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS k FROM d)),
t AS (SELECT r, k FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT r, k, sum(CASE WHEN k <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY k) AS island
  FROM (SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS before FROM t)),
s AS (SELECT r, min(k) AS begin, max(k) + 200 AS stop FROM g GROUP BY r, island),
p AS (
  SELECT r, begin, substr(h, 2 * after + 1, 2 * (begin - after)) AS piece
  FROM (SELECT r, begin, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY begin), 0) AS after
    FROM (SELECT r, begin, stop FROM s UNION ALL SELECT r, len(h) // 2, NULL FROM d)) JOIN d USING (r)),
k AS (SELECT r, string_agg(piece, '' ORDER BY begin) AS h FROM p GROUP BY r)
SELECT doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, (len(d.h) // 2 - len(k.h) // 2)::BIGINT AS n_removed,
  (SELECT count(*) FROM s WHERE s.r = d.r)::BIGINT AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN k USING (r)
"""
