"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Each row has a key of its own: two hashes of all its columns and its number among rows that are alike
in all of them. What is drawn for a row follows from the key, so a retried task draws the same again.
Keys lie in source blocks by hash. The driver draws the matrix of counts, block by shard, from the
multivariate hypergeometric law with the block sizes and the shard sizes as margins: the law of the
counts under a uniform shuffle. Each block permutes its keys and cuts them by its row of the matrix;
after the exchange each shard permutes again, by a random key in key ranges whose offsets are known
from counts, so that no task holds a whole shard. Only keys take part in this; the rows themselves
move once, to meet their keys' shards and slots. Rows that are alike move as one row with their keys.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch

#: Rows of a source block and of a key range of a shard, about.
BLOCK_ROWS = 20_000
#: At most so many numbers in the matrix, which is broadcast; beyond it the blocks grow.
MATRIX_CELLS = 1 << 21
#: Rows that are alike in all columns are dealt with so many at a time.
ALIKE = 10_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """numpy's sampler, and beyond its bound of 10**9 the ratio-of-uniforms rejection on the same law."""
    if not draws or not good:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mean, var = draws * good / total, draws * (good / total) * (bad / total) * (total - draws) / (total - 1)

    def logp(k: int) -> float:
        return -sum(map(math.lgamma, (k + 1, good - k + 1, draws - k + 1, bad - draws + k + 1)))

    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    top, width = logp(mode), 1.7155277699214135 * math.sqrt(var + 0.5) + 0.8989161620588988
    while True:
        u = rng.random()
        k = math.floor(mean + 0.5 + width * (rng.random() - 0.5) / u) if u else -1
        if low <= k <= high and 2 * math.log(u) <= logp(k) - top:
            return k


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts with row sums ``blocks`` and column sums ``shards``, drawn as a uniform shuffle would give them."""
    if sum(blocks) != sum(shards):
        raise ValueError("blocks and shards must hold the same number of rows")
    rng, left = np.random.default_rng(seed), list(shards)
    out = np.zeros((len(blocks), len(shards)), np.int64)
    for b, rows in enumerate(blocks):
        pool = sum(left)
        for s in range(len(shards)):
            pool -= left[s]
            k = _hypergeometric(rng, left[s], pool, rows)
            out[b, s], rows = k, rows - k
            left[s] -= k
    return out


def _content(df: DataFrame) -> list[Column]:
    """What tells rows apart: hashes skip nulls, so these are told too, and nested columns go as text."""
    out = []
    for f in df.schema:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        out += [c.isNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if nested else c]
    return out


def shuffle_to_shards(df: DataFrame, n_shards: int, id_col: str = "doc_id", seed: int = 0, block_rows: int = BLOCK_ROWS, shard_col: str = "shard", slot_col: str = "slot", alike: int = ALIKE) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, 0 to the shard's size less one): a uniform shuffle.

    Shard sizes differ by one at most. All columns are kept; a column already named like a result
    column is replaced. Every row is shuffled for itself, whatever its id: rows with null or repeated
    ids, and rows that repeat another in all columns, part like any others. ``id_col`` must be there.
    An empty table gives an empty result.
    """
    spark = df.sparkSession
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    df = df.drop(shard_col, slot_col)
    df.select(id_col)
    scratch, content, key = Scratch(spark, "shards"), _content(df), ["_h1", "_h2"]
    rows = df.select(F.struct("*").alias("row"), F.xxhash64(*content).alias("_h1"), F.xxhash64(F.lit("second"), *content).alias("_h2"))
    counts = scratch.keep(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()

    # Every row's key: ``at`` counts rows alike, ``alike`` of them to a ``_part``.
    parts = counts.withColumn("_part", F.lit(0) if most <= alike else F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / alike).cast("int"))))
    if most > alike:
        parts = parts.repartition(*key, "_part")
    first = F.col("_part").cast("long") * alike
    keys = parts.select(*key, "_part", F.explode(F.sequence(first + 1, F.least(F.col("n"), first + alike))).alias("at"))
    draw = lambda what: F.xxhash64(*key, "at", F.lit(seed), F.lit(what))
    n_blocks = max(1, min(-(-total // block_rows), MATRIX_CELLS // n_shards))
    keys = keys.withColumn("block", F.pmod(draw("block"), F.lit(n_blocks)).cast("int"))
    sizes = [0] * n_blocks
    for r in keys.groupBy("block").count().collect():
        sizes[r[0]] = r[1]
    shards = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    cuts = np.cumsum(communication_matrix(sizes, shards, seed), axis=1)
    matrix = spark.createDataFrame([(b, row.tolist()) for b, row in enumerate(cuts)], "block int, cuts array<long>")

    place = F.row_number().over(Window.partitionBy("block").orderBy(draw("first"), *key, "at"))
    ranges = max(1, -(-max(shards) // block_rows))
    local = keys.withColumn("place", place).join(F.broadcast(matrix), "block").withColumn("second", draw("second"))
    share = F.floor((F.col("second") / F.lit(2.0**64) + 0.5) * ranges)
    local = scratch.keep(local.select(*key, "_part", "at", "second", F.size(F.filter("cuts", lambda c: c < F.col("place"))).cast("int").alias("_shard"), F.least(share, F.lit(ranges - 1)).cast("int").alias("range")))
    before = Window.partitionBy("_shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.groupBy("_shard", "range").agg(F.count(F.lit(1)).alias("n")).select("_shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("_shard", "range").orderBy("second", *key, "at"))
    placed = local.withColumn("rank", rank).join(offsets, ["_shard", "range"])
    placed = placed.select(*key, "_part", "_shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("_slot"))

    if most > 1:
        rows = rows.groupBy(*key).agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n"))
    if most > alike:
        rows, key = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / alike).cast("int")))), [*key, "_part"]
    return rows.select(*key, "row").join(placed, key).select("row.*", F.col("_shard").alias(shard_col), F.col("_slot").alias(slot_col))


def op4_sharding(spark, sf_dir: str, n_shards: int = 8) -> DataFrame:
    """Whole documents are shuffled; sizes and checksums are taken from the rows as they lie in their shards."""
    text = F.coalesce("text", F.lit(""))
    return shuffle_to_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_shards).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
