"""A corpus pipeline of five stages, each one operator of ``dagframe.llm`` over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagframe.llm._shared import Scratch
from dagframe.llm.decontamination import contamination
from dagframe.llm.mixing import TARGETS, labelled_languages, mix
from dagframe.llm.near_dedup import near_duplicates
from dagframe.llm.sharding import shuffle_to_shards
from dagframe.llm.toxicity import fit_toxicity, graded_labels, score_toxicity

N_SHARDS = 8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ordinal model calls toxic; it is fitted on labelled rows of the raw table."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(raw, graded_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_toxicity(docs, model).where(~F.col("toxic")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the smallest id, of several the least hash of its text.

    A row without an id is kept if its whole group has none. Rows without words stay.
    """
    found = near_duplicates(docs, rows_named=True).where("root is not null")
    each = Scratch(spark, "pipeline").keep(found.groupBy("root", "id", "hash").agg(F.count(F.lit(1)).alias("n")))
    least = each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("low"))
    first = F.col("id").eqNullSafe(F.col("low.id")) & (F.col("hash") == F.col("low.hash"))
    judged = each.join(least, "root").select("id", "hash", "n", first.alias("first")).where("not first or n > 1")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text).alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash"))
    once = rows.join(judged.where("first"), same, "left_semi").dropDuplicates(["own_id", "own_hash"])
    return rows.join(judged, same, "left_anti").union(once).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages cover a twentieth of the words or more, those of items without an id too."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    found = contamination(docs, items)
    return found.where(~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the languages' expected tokens meet the target weights."""
    return mix(docs, labelled_languages(spark, sf_dir), TARGETS).select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each row's shard and slot under a uniform shuffle."""
    return shuffle_to_shards(docs, N_SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: The ordinal model, the hashed classifier and the random shuffle have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and reread."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return kept
        docs = scratch.keep(kept)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
