"""Scratch tables, run-wise grouping and connected components shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def extended(fields: T.StructType, ddl: str) -> T.StructType:
    """A schema with more columns behind."""
    return T.StructType([*fields, *T.StructType.fromDDL(ddl)])


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``. Unset, it is a temporary one where Spark runs on this machine alone, and an error else."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="dagframe-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


class Scratch:
    """Tables that cut lineage: each is written once to the shared folder and read back.

    ``keep`` returns the reread table. ``drop`` deletes those that no later step reads; what a
    result still reads stays until ``close`` or the end of the JVM.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def keep(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count}"
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path), True)

    def close(self) -> None:
        """Deletes all tables, once no result that reads them is needed any more."""
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.root), True)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal keys, each run as one batch; the input is sorted by the keys."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is None or any(c[0] != v for c, v in zip(cols, last))
        last = [c[-1] for c in cols]
        cuts = np.flatnonzero(new).tolist()
        if held and (not cuts or cuts[0] > 0):
            end = cuts[0] if cuts else batch.num_rows
            held.append(batch.slice(0, end))
        if cuts:
            if held:
                yield _joined(held)
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)
            held = [batch.slice(cuts[-1])]
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(a, b)``, both long: ``(node, root)``, root the smallest node reached.

    Alternates large-star and small-star steps (each a min per node and a join back), so that no
    task needs a whole component and a hub is split by the adaptive join. Each step is written to
    the shared folder; the loop ends when a step changes nothing, told by two sums over the links.
    An empty input gives an empty result. Links with a null end are ignored.
    """

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()

    cur = scratch.keep(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = state(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.keep(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        nxt = scratch.keep(small)
        scratch.drop(cur, large)
        now = state(nxt)
        cur, done = nxt, now == seen
        seen = now
        if done:
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


class Membership:
    """A Bloom filter over long keys that every executor holds; at most ``MAX_BITS`` bits whatever the input.

    A miss is certain, a hit is not, so callers join afterwards: the filter only spares the exchange
    of rows that cannot match. It is built from one row of bits for each 64-bit word, OR-ed by Spark.
    """

    MAX_BITS = 1 << 27

    def __init__(self, keys: DataFrame):
        """``keys``: one long column; nulls are ignored."""
        import numpy as np

        spark = keys.sparkSession
        keys = keys.toDF("k").where("k is not null")
        n = keys.count()
        self.bits = bits = min(self.MAX_BITS, 1 << max(10, (10 * n).bit_length()))

        def mark(batches):
            for b in batches:
                at = np.concatenate([_places(b.column(0).to_numpy(), j, bits) for j in range(3)])
                word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
                mask = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(mask, inverse, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["w", "m"])

        rows = keys.mapInArrow(mark, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow() if n else None
        table = np.zeros(bits // 64, np.uint64)
        if rows is not None:
            table[rows["w"].to_numpy()] = rows["m"].to_numpy().view(np.uint64)
        self.table = spark.sparkContext.broadcast(table)

    def maybe(self, keys):
        """A mask over a numpy array of longs: False where the key is surely absent."""
        import numpy as np

        table, out = self.table.value, np.ones(len(keys), bool)
        for j in range(3):
            at = _places(keys, j, self.bits)
            out &= (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out

    def __getstate__(self):
        return {"bits": self.bits, "table": self.table}


def _places(keys, j: int, bits: int):
    import numpy as np

    from ._words import mix

    return mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019 * (j + 1) & (2**64 - 1))) & np.uint64(bits - 1)
