"""Mixing sources to target weights by soft membership.

A naive Bayes classifier over hashed words, fitted on a labelled table, gives each document a
posterior over domains. Non-negative rates per document are then fitted by projected gradient least
squares so that the expected tokens of each domain, sum of rate * tokens * posterior, meet the
targets. A step needs one sum for each domain from the corpus and moves every document's rate by its
own posterior, so the driver sees as many numbers as there are domains. DataFrame operations only.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

#: Words are hashed into so many buckets; the classifier's table, which is broadcast, has a row for each.
BUCKETS = 1 << 14
#: At most so many labelled rows fit the classifier: those with the smallest hashes of their ids.
MAX_LABELLED = 5_000
#: A document's words count as so many independent ones at most, which keeps posteriors soft.
SHARPNESS = 20.0
#: Parameters of the query.
TARGETS = {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.14}


def _words(text: Column) -> Column:
    """Lower-cased words; white space is one of six ASCII characters. Some may be empty."""
    return F.split(F.lower(text), "[ \t\n\x0b\f\r]+")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_domains(labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float]]:
    """``(bucket, w0, w1, ...)``, the log likelihood of a bucket in each domain, and the domains' shares.

    ``labelled(text, domain)``. Without labelled rows the shares are equal and all likelihoods too.
    """
    spark = labelled.sparkSession
    labelled = labelled.where(F.col("domain").isin(domains))
    shares = dict(labelled.groupBy("domain").count().collect())
    total = sum(shares.values())
    priors = [(shares.get(d, 0) + 1) / (total + len(domains)) for d in domains]
    words = labelled.select("domain", F.explode(_words(F.coalesce("text", F.lit("")))).alias("word")).where("word <> ''")
    counts = {(r[0], r[1]): r[2] for r in words.groupBy("domain", _bucket(F.col("word")).alias("bucket")).count().collect()}
    size = {d: sum(n for (e, _), n in counts.items() if e == d) for d in domains}
    table = [(b, *(math.log((counts.get((d, b), 0) + 0.1) / (size[d] + 0.1 * BUCKETS)) for d in domains)) for b in range(BUCKETS)]
    return spark.createDataFrame(table, "bucket int, " + ", ".join(f"w{k} double" for k in range(len(domains)))), priors


def domain_posteriors(docs: DataFrame, table: DataFrame, priors: list[float], sharpness: float = SHARPNESS) -> DataFrame:
    """``id, hash, copies, tokens, p0, p1, ...`` for each distinct ``(id, text)`` of ``docs(id, text)``.

    ``copies`` counts its rows; ``tokens`` are its words. A text without words has the priors.
    """
    n = len(priors)
    text = F.coalesce("text", F.lit(""))
    # Hashes are taken before words become rows, so that no row of a word reads the text again.
    buckets = F.transform(F.filter(_words(text), lambda w: w != ""), _bucket)
    each = docs.select("id", F.xxhash64(text).alias("hash"), buckets.alias("buckets"))
    each = each.select("id", "hash", F.posexplode_outer("buckets").alias("at", "bucket")).withColumn("first", F.when(F.coalesce("at", F.lit(0)) == 0, 1).otherwise(0))
    sums = [F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(n)]
    each = each.join(F.broadcast(table), "bucket", "left").groupBy("id", "hash").agg(F.sum("first").alias("copies"), F.count("bucket").alias("words"), *sums)
    scale = F.when(F.col("words") > 0, sharpness / F.greatest(F.col("words") / F.col("copies"), F.lit(sharpness)) / F.col("copies")).otherwise(0.0)
    each = each.select("id", "hash", "copies", (F.col("words") / F.col("copies")).cast("long").alias("tokens"), *((F.col(f"s{k}") * scale + math.log(priors[k])).alias(f"z{k}") for k in range(n)))
    top = F.greatest(*(F.col(f"z{k}") for k in range(n))) if n > 1 else F.col("z0")
    each = each.select("id", "hash", "copies", "tokens", *(F.exp(F.col(f"z{k}") - top).alias(f"u{k}") for k in range(n)))
    whole = sum((F.col(f"u{k}") for k in range(1, n)), F.col("u0"))
    return each.select("id", "hash", "copies", "tokens", *((F.col(f"u{k}") / whole).alias(f"p{k}") for k in range(n)))


def fit_rates(posteriors: DataFrame, targets: list[float], steps: int = 40, tolerance: float = 1e-6) -> tuple[Column, list[float]]:
    """The rate as a column of ``posteriors``, and the domains' expected shares under it.

    Rates begin at 1; the target total is the present one. A step subtracts the posterior times the
    relative error of each domain and cuts off at zero. A domain that no document may belong to
    cannot be reached and is left out.
    """
    n, rate = len(targets), F.lit(1.0)
    mass = lambda r: posteriors.agg(*(F.coalesce(F.sum(r * F.col("copies") * F.col("tokens") * F.col(f"p{k}")), F.lit(0.0)) for k in range(n))).first()
    start = now = mass(rate)
    total = sum(start)
    goal = [t * total / sum(targets) for t in targets]
    for _ in range(steps):
        if max((abs(a - g) for a, g, s in zip(now, goal, start) if s > 0), default=0) <= tolerance * total:
            break
        step = [(a - g) / s if s > 0 else 0.0 for a, g, s in zip(now, goal, start)]
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"p{k}") * step[k] for k in range(1, n)), F.col("p0") * step[0]))
        now = mass(rate)
    return rate, [a / max(sum(now), 1e-300) for a in now]


def _repeats(rate: Column, seed: int) -> Column:
    """Whole times, and once more with the probability of the fraction, by a hash of the row."""
    u = F.pmod(F.xxhash64("id", "hash", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text_col: str = "text", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """``id, hash, copies, tokens, p0.., rate, repeats`` for each distinct ``(id, text)``; ``hash``: xxhash64 of the text.

    ``targets``: a weight for each domain; ``labelled(text, domain)``. ``repeats``: how often the mix
    takes each of the rows. Warns of the shares reached where targets are missed. Null text counts as empty; null ids are allowed. An empty table gives an
    empty result.
    """
    if not targets or min(targets.values()) < 0 or not sum(targets.values()):
        raise ValueError("targets must be weights of at least one domain")
    scratch = Scratch(docs.sparkSession, "mixing")
    table, priors = fit_domains(labelled, list(targets))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = scratch.keep(domain_posteriors(source, table, priors))
    rate, shares = fit_rates(known, list(targets.values()))
    wanted = [t / sum(targets.values()) for t in targets.values()]
    if any(shares) and max(abs(a - t) for a, t in zip(shares, wanted)) > 1e-4:
        warnings.warn(f"targets are not met; the expected shares are {dict(zip(targets, shares))}", stacklevel=2)
    return known.withColumn("rate", rate).withColumn("repeats", _repeats(F.col("rate"), seed))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text_col: str = "text", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as their rates say, with the columns of ``docs``."""
    rates = mixing_rates(docs, labelled, targets, text_col, id_col, seed).where("repeats > 0").select("id", "hash", "repeats")
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"), own.alias("own_hash"))
    joined = rows.join(rates, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")


def labelled_languages(spark, sf_dir: str, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Documents that the labelled table covers, at most ``max_labelled`` of its ids, with their language as the domain."""
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").where("doc_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("lang").alias("domain"))
    return docs.join(F.broadcast(ids), "doc_id").select("text", "domain")


def op9_mixing(spark, sf_dir: str, targets: dict[str, float] = TARGETS) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rates = mixing_rates(docs, labelled_languages(spark, sf_dir), targets)
    each = rates.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    shares = [F.round(f"p{k}", 6).alias(f"p_{d}") for k, d in enumerate(targets)]
    return each.select(F.col("id").alias("doc_id"), F.col("tokens").alias("n_tokens"), *shares, F.round("rate", 6).alias("rate"), "repeats")
