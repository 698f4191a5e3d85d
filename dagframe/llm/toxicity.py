"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

One weight vector serves all ordered thresholds: P(grade > k) = sigmoid(w.x - t_k). Features are
hashed lower-cased words and their first 5, 6 and 7 bytes, each as two flags: that a text has it at
all, and that it has it ``OFTEN`` times. The model is fitted in numpy on a bounded sample of labelled
rows; scoring is a single pass over whole texts without an exchange.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import extended
from ._words import ALNUM, LOWER, chunks, hashes, mix, spans

BUCKETS = 1 << 20
PREFIXES = (5, 6, 7)
OFTEN = 3
#: At most so many labelled rows fit the model: those with the smallest hashes of their ids.
MAX_LABELLED = 8_000


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class OrdinalModel:
    """``weights`` of the flags (float32, mostly zero; ``often`` follows ``any``) and rising ``cuts``, one less than there are grades."""

    weights: np.ndarray
    cuts: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and cut."""
        return _sigmoid(z[:, None] - self.cuts[None, :])


def fit_ordinal(features: list[np.ndarray], grades: np.ndarray, flags: int = 2 * BUCKETS, l2: float = 0.05, steps: int = 600, min_rows: int = 5, min_z: float = 4.0, later_z: float = 4.0, thinned: int = 4) -> OrdinalModel:
    """Fits by gradient steps with per-coordinate scaling. ``features``: the distinct flags of each row.

    Only flags that ``min_rows`` rows have get a weight, and of them those whose share is higher above grade 0
    than in it by ``min_z`` standard errors; these have no weight below zero, as evidence of toxicity only adds.
    Flags whose share differs as much, either way, between rows above a further grade and in it get one of either sign. Each row is used again ``thinned`` times with a fifth of
    its flags, so that a few strong words suffice where training rows have many. Without rows, or with one grade only, nothing is learned:
    the weights are zero and all rows are given the grade of the most.
    """
    n_cuts = max(1, int(grades.max(initial=0)))
    share = np.array([(np.sum(grades > k) + 0.5) / (len(grades) + 1) for k in range(n_cuts)])
    cuts = np.log((1 - share) / share)
    weights = np.zeros(flags, np.float32)
    if not (grades > 0).any() or (grades > 0).all():
        return OrdinalModel(weights, cuts)
    signed = np.zeros(flags, bool)
    for k in range(n_cuts):
        above, at = grades > k, grades == k
        if above.any() and at.any():
            c1, c0 = np.zeros(flags, np.float32), np.zeros(flags, np.float32)
            for f, g in zip(features, grades):
                if g >= k:
                    (c1 if g > k else c0)[f] += 1
            n1, n0 = above.sum(), at.sum()
            p = (c1 + c0) / (n1 + n0)
            z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
            z[c1 + c0 < min_rows] = 0
            if k:
                signed |= np.abs(z) >= later_z
            else:
                positive = z >= min_z
            del c1, c0, p, z
    chosen = np.flatnonzero(positive | signed)
    least = np.where(signed[chosen] & ~positive[chosen], -np.inf, 0.0)
    place = np.full(flags, -1)
    place[chosen] = np.arange(len(chosen))
    kept = [place[f][place[f] >= 0] for f in features]
    rows, cols = np.repeat(np.arange(len(kept)), [len(k) for k in kept]), np.concatenate(kept)
    del place, positive, signed
    rng, n = np.random.default_rng(0), len(grades)
    parts = [(rows, cols)]
    for copy in range(1, thinned + 1):
        held = rng.random(len(rows)) < 0.2
        parts.append((rows[held] + copy * n, cols[held]))
    rows, cols = (np.concatenate(x) for x in zip(*parts))
    grades = np.tile(grades, thinned + 1)
    w = np.zeros(len(chosen))
    scale_w, scale_c = np.full(len(chosen), 1e-6), np.full(n_cuts, 1e-6)
    for _ in range(steps):
        x = np.bincount(rows, w[cols], minlength=len(grades))
        up = np.hstack([np.ones((len(grades), 1)), _sigmoid(x[:, None] - cuts), np.zeros((len(grades), 1))])
        prob = np.maximum(-np.diff(up, axis=1), 1e-9)
        slope = up * (1 - up)
        own = np.arange(len(grades)), grades
        lo, hi = slope[own], slope[own[0], grades + 1]
        d = (lo - hi) / prob[own]
        dc = np.array([np.sum(np.where(grades == k, hi, 0) / prob[own]) - np.sum(np.where(grades == k + 1, lo, 0) / prob[own]) for k in range(n_cuts)])
        gw = np.bincount(cols, d[rows], minlength=len(w)) - l2 * w
        scale_w += gw**2
        scale_c += dc**2
        w = np.maximum(w + 0.5 * gw / np.sqrt(scale_w), least)
        cuts = np.maximum.accumulate(cuts + 0.3 * dc / np.sqrt(scale_c))
    weights[chosen] = w
    return OrdinalModel(weights, cuts)


def _rows(texts: pa.Array, half: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, row, bucket)`` of each word and prefix, for runs of whole texts; rows count from ``first``."""
    for lo, hi, buf, off in chunks(texts):
        buf = LOWER[buf]
        starts, ends, bounds = spans(buf, off, ALNUM)
        row = np.repeat(np.arange(hi - lo), np.diff(bounds))
        rows, keys = [row], [hashes(buf, starts, ends)]
        for n in PREFIXES:
            long = np.flatnonzero(ends - starts >= n)
            rows.append(row[long])
            keys.append(mix(hashes(buf, starts[long], starts[long] + n) + np.uint64(n)))
        yield lo, hi, np.concatenate(rows), (np.concatenate(keys) & np.uint64(half - 1)).astype(np.int64)


def _flags(row: np.ndarray, bucket: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(row, flag)`` of words; flags from ``half`` on stand for ``OFTEN`` occurrences."""
    pairs, n = np.unique(row * half + bucket, return_counts=True)
    often = pairs[n >= OFTEN]
    return np.concatenate([pairs // half, often // half]), np.concatenate([pairs % half, often % half + half])


def fit_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_labelled: int = MAX_LABELLED) -> OrdinalModel:
    """Fits on ``labels(id, grade)``, grades 0, 1, ...; rows with a null id or grade are ignored.

    Labelled rows without a document, and repeats of a text among them, are not used.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col("grade").cast("int").alias("grade")).where("id is not null and grade >= 0")
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "grade").limit(max_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, row, bucket in _rows(b.column("text"), BUCKETS):
                row, flag = _flags(row, bucket, BUCKETS)
                order = np.argsort(row, kind="stable")
                sets = np.split(flag[order].astype(np.int32), np.searchsorted(row[order], np.arange(1, hi - lo)))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), b.column("grade").slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "grade", "features"])

    got = rows.mapInArrow(described, "id long, grade int, features binary").toArrow().sort_by([("id", "ascending"), ("grade", "ascending")])
    kept = {f: g for f, g in zip(got["features"].to_pylist(), got["grade"].to_pylist())}
    return fit_ordinal([np.frombuffer(f, np.int32) for f in kept], np.array(list(kept.values()), np.int64))


def score_toxicity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``severity`` (the expected grade), ``p_toxic`` (P(grade > 0)), ``grade``, ``toxic`` (``grade`` is over 0).

    ``grade``: of the cuts whose P(grade > k) is ``threshold`` or more, the number.
    Null and empty texts have no features: the model's intercepts alone decide. Repeated rows are
    scored each; columns with the results' names are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("severity", "p_toxic", "grade", "toxic")
    fields, held = docs.schema, docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            z, half = np.zeros(b.num_rows), len(model.weights) // 2
            known = (model.weights[:half] != 0) | (model.weights[half:] != 0)
            for lo, hi, row, bucket in _rows(b.column(text_col), half):
                at = np.flatnonzero(known[bucket])
                row, flag = _flags(row[at], bucket[at], half)
                z[lo:hi] = np.bincount(row, model.weights[flag], minlength=hi - lo)
            above = model.above(z)
            grades = (above >= threshold).sum(axis=1)
            cols = [b.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(above.sum(axis=1)), pa.array(above[:, 0].copy()), pa.array(grades, pa.int32()), pa.array(grades > 0)],
                [*(f.name for f in fields), "severity", "p_toxic", "grade", "toxic"],
            )

    schema = extended(fields, "severity double, p_toxic double, grade int, toxic boolean")
    return docs.mapInArrow(scored, schema)


def graded_labels(labels: DataFrame) -> DataFrame:
    """The table has two flags and no severity. Taken as ordered: 0 not toxic, 1 toxic in text of low quality, 2 toxic in readable text."""
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 1).otherwise(2)).alias("grade"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, graded_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    found = score_toxicity(docs, model)
    return found.select("doc_id", F.round("severity", 9).alias("severity"), F.round("p_toxic", 9).alias("p_toxic"), "grade", "toxic", (~F.col("toxic")).alias("kept"))
