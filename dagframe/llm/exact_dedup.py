"""Exact de-duplication with a log-structured merge index over text digests.

Each input task keeps a memtable from digest to (best id, count). A full memtable is flushed as a
run sorted by digest, so a text repeated a million times leaves one entry for each run. Runs go to
digest ranges; there a ``MergeIndex`` compacts runs of like size, keeping the best id and adding
counts. Long runs lie in the shared folder and are merged as streams, with a Bloom filter for each
run in memory, which tells most digests apart that no other run has. Digests met more than once are hits. Every hit is verified: its bytes are compared with those of the row that
stays, whose text is copied to as many salts as the group needs. Texts that share a digest but not
the bytes are grouped again by their bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from heapq import merge
from itertools import batched, groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Membership, Scratch

MEMTABLE = 1 << 16
#: Rows of a group that are compared with one copy of the text that stays.
SALT_ROWS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def normalise(text: bytes | None) -> bytes:
    return (text or b"").translate(_LOWER)


class Run:
    """Entries ``(digest, id, count)`` sorted by digest, in memory or in a file, with a Bloom filter of about ten bits each."""

    ROWS = 4096

    def __init__(self, entries: Iterable[tuple[bytes, int | None, int]], size: int, folder: str | None = None):
        """``size``: at least the number of entries. With a ``folder`` they are written there as they come."""
        self.bits = 1 << max(6, (10 * size).bit_length())
        self.filter, self.size, self.least = bytearray(self.bits // 8), 0, []
        self._fs = self.path = None
        if folder is None:
            self.entries = list(self._noted(entries))
            self.digests = [e[0] for e in self.entries]
            return
        self._fs, folder = fs.FileSystem.from_uri(folder)
        self._fs.create_dir(folder)
        self.path = f"{folder}/{uuid.uuid4().hex}"
        schema = pa.schema([("digest", pa.binary()), ("id", pa.int64()), ("n", pa.int64())])
        with self._fs.open_output_stream(self.path) as out, pa.ipc.new_file(out, schema) as w:
            for part in batched(self._noted(entries), self.ROWS):
                self.least.append(part[0][0])
                w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], schema=schema))

    def _noted(self, entries: Iterable) -> Iterator:
        for e in entries:
            self.size += 1
            for at in self._places(e[0]):
                self.filter[at >> 3] |= 1 << (at & 7)
            yield e

    def _places(self, digest: bytes) -> list[int]:
        h = int.from_bytes(hashlib.blake2b(digest, digest_size=12).digest(), "big")
        return [(h >> s) % self.bits for s in (0, 32, 64)]

    def __iter__(self) -> Iterator[tuple[bytes, int | None, int]]:
        if self.path is None:
            yield from self.entries
            return
        with self._fs.open_input_file(self.path) as file:
            reader = pa.ipc.open_file(file)
            for k in range(reader.num_record_batches):
                yield from zip(*(c.to_pylist() for c in reader.get_batch(k).columns))

    def maybe(self, digest: bytes) -> bool:
        return all(self.filter[at >> 3] >> (at & 7) & 1 for at in self._places(digest))

    def find(self, digest: bytes) -> tuple[bytes, int | None, int] | None:
        if not self.maybe(digest):
            return None
        if self.path is None:
            k = bisect_left(self.digests, digest)
            return self.entries[k] if k < len(self.digests) and self.digests[k] == digest else None
        block = bisect_right(self.least, digest) - 1
        if block < 0:
            return None
        with self._fs.open_input_file(self.path) as file:
            digests, ids, counts = (c.to_pylist() for c in pa.ipc.open_file(file).get_batch(block).columns)
        k = bisect_left(digests, digest)
        return (digest, ids[k], counts[k]) if k < len(digests) and digests[k] == digest else None

    def drop(self) -> None:
        if self.path is not None:
            self._fs.delete_file(self.path)


class MergeIndex:
    """A log-structured merge index. ``keep``: ``smallest`` or ``largest`` id of equal digests; a null id loses.

    With a ``folder``, runs of more than ``memtable`` entries are kept there, so that memory holds runs of one
    memtable, filters and the heads of the runs that are merged.
    """

    def __init__(self, keep: str = "smallest", memtable: int = MEMTABLE, fan_in: int = 4, folder: str | None = None):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep must be smallest or largest, not {keep!r}")
        self.pick, self.limit, self.fan_in, self.folder = (min if keep == "smallest" else max), memtable, fan_in, folder
        self.memtable: dict[bytes, tuple[int | None, int]] = {}
        self.tiers: list[list[Run]] = []

    def better(self, a: int | None, b: int | None) -> int | None:
        return b if a is None else a if b is None else self.pick(a, b)

    def add(self, digest: bytes, id: int | None, count: int = 1) -> None:
        old = self.memtable.get(digest)
        self.memtable[digest] = (id, count) if old is None else (self.better(old[0], id), old[1] + count)
        if len(self.memtable) >= self.limit:
            self.append(self.flush())

    def flush(self) -> list[tuple[bytes, int | None, int]]:
        run = sorted(((d, *v) for d, v in self.memtable.items()), key=lambda e: e[0])
        self.memtable = {}
        return run

    def append(self, entries: Iterable[tuple[bytes, int | None, int]], size: int | None = None, tier: int = 0) -> None:
        """Takes a sorted run; ``fan_in`` runs of a tier are compacted to one of the next."""
        while tier >= len(self.tiers):
            self.tiers.append([])
        size = len(entries) if size is None else size
        self.tiers[tier].append(Run(entries, size, self.folder if size > self.limit else None))
        if len(self.tiers[tier]) >= self.fan_in:
            old, self.tiers[tier] = self.tiers[tier], []
            self.append(self.compacted(old), sum(r.size for r in old), tier + 1)
            for r in old:
                r.drop()

    def compacted(self, old: list[Run]) -> Iterator[tuple[bytes, int | None, int]]:
        for digest, same in groupby(merge(*old, key=lambda e: e[0]), key=lambda e: e[0]):
            _, best, count = next(same)
            for _, id, n in same:
                best, count = self.better(best, id), count + n
            yield digest, best, count

    def hits(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Digests met more than once, each once. Entries that no other run's filter knows are not merged."""
        if self.memtable:
            self.append(self.flush())
        live = [r for tier in self.tiers for r in tier]

        def shared(run: Run) -> Iterator[tuple[bytes, int | None, int]]:
            others = [r for r in live if r is not run]
            return (e for e in run if e[2] > 1 or any(r.maybe(e[0]) for r in others))

        yield from (e for e in self.compacted([shared(r) for r in live]) if e[2] > 1)
        for r in live:
            r.drop()
        self.tiers = []


def _key(digest: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(digest, digest_size=8).digest(), "big", signed=True)


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "smallest", digest_bytes: int = 32, memtable: int = MEMTABLE) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, sha256`` (hex of the normalised text).

    Texts are equal if identical after lower-casing A-Z. Null text counts as empty. A null id never
    stays while its group has another; where all ids of a group are null, ``keep_id`` is null and
    all rows are kept. Rows that repeat an id and its text are one document, so all of them say the
    same. An empty table gives an empty result; other columns are not read. ``digest_bytes`` shortens
    the index key (whole: 32); results do not depend on it, as hits are verified by their bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = [hashlib.sha256(normalise(t)).digest() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.binary())], ["id", "sha"])

    table = scratch.keep(source.mapInArrow(digests, "id long, sha binary"))
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def flushed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MergeIndex(keep, memtable + 1)
        run = 0

        def batch():
            nonlocal run
            entries = index.flush()
            run += 1
            d = [e[0] for e in entries]
            first = [int.from_bytes(x[:4].ljust(4, b"\0"), "big") * shards >> 32 for x in d]
            return pa.RecordBatch.from_arrays(
                [pa.array(first, pa.int32()), pa.array([run] * len(d), pa.int32()), pa.array(d, pa.binary()), pa.array([e[1] for e in entries], pa.int64()), pa.array([e[2] for e in entries], pa.int64())],
                ["shard", "run", "digest", "id", "n"],
            )

        for b in batches:
            for id, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                index.add(sha[:digest_bytes], id)
                if len(index.memtable) >= memtable:
                    yield batch()
        if index.memtable:
            yield batch()

    folder = f"{scratch.root}/runs"

    def compact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(index):
            for part in batched(index.hits(), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e[0] for e in part], pa.binary()), pa.array([_key(e[0]) for e in part], pa.int64()), pa.array([e[1] for e in part], pa.int64()), pa.array([e[2] for e in part], pa.int64())],
                    ["digest", "key", "keep_id", "group_size"],
                )

        rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in ("shard", "task", "run", "digest", "id", "n"))))
        for _, shard in groupby(rows, key=lambda r: r[0]):
            index = MergeIndex(keep, memtable, folder=folder)
            for _, run in groupby(shard, key=lambda r: r[1:3]):
                index.append([r[3:] for r in run])
            yield from found(index)

    hits = scratch.keep(
        table.mapInArrow(flushed, "shard int, run int, digest binary, id long, n long")
        .withColumn("task", F.spark_partition_id())
        .repartition(shards, "shard").sortWithinPartitions("shard", "task", "run", "digest")
        .mapInArrow(compact, "digest binary, key long, keep_id long, group_size long")
    )
    known = Membership(hits.select("key"))

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [normalise(t) for t in b.column(1).to_pylist()]
            digest = [hashlib.sha256(t).digest()[:digest_bytes] for t in text]
            mask = pa.array(known.maybe(pa.array([_key(d) for d in digest], pa.int64()).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.binary()), pa.array(digest, pa.binary())], ["id", "text", "digest"]).filter(mask)

    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    rows = source.mapInArrow(suspects, "id long, text binary, digest binary").withColumn("at", F.monotonically_increasing_id()).join(hits, "digest")
    stays = rows.where(F.col("id").eqNullSafe(F.col("keep_id"))).select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    first = stays.groupBy("digest", "salt").agg(F.min("kept_text").alias("kept_text"))
    # By place, as rows that are alike in all columns have to part too.
    compared = rows.withColumn("salt", F.pmod("at", salts).cast("int")).join(first, ["digest", "salt"])
    unequal = scratch.keep(compared.where(F.col("text") != F.col("kept_text")).select("digest").distinct())

    out = table.withColumn("digest", F.substring("sha", 1, digest_bytes))
    if unequal.isEmpty():
        out = out.join(hits.drop("key"), "digest", "left")
    else:
        best = F.min("id") if keep == "smallest" else F.max("id")
        again = rows.join(unequal, "digest").groupBy("digest", F.sha2("text", 512).alias("sha512"), "text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = scratch.keep(again.select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"))
        fine = hits.drop("key").join(unequal, "digest", "left_anti")
        out = out.join(fine, "digest", "left").join(again.toDF("sha", "keep_2", "size_2"), "sha", "left")
        out = out.withColumns({"keep_id": F.coalesce("keep_id", "keep_2"), "group_size": F.coalesce("group_size", "size_2")})
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        "id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("sha256"),
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = exact_duplicates(docs, keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
