import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagframe.llm import toxicity as T
from dagframe.llm._words import hashes, mix
from dagframe.llm.toxicity import fit_ordinal, fit_toxicity, graded_labels, op5_toxicity, score_toxicity


def test_ordinal_fit_recovers_order():
    r = random.Random(0)
    rows, grades = [], []
    for _ in range(600):
        g = r.choice([0, 0, 0, 1, 2])
        rows.append(np.array(sorted({r.randrange(10, 60) for _ in range(8)} | ({1} if g else set()) | ({2} if g > 1 else set()))))
        grades.append(g)
    m = fit_ordinal(rows, np.array(grades), flags=128)
    assert len(m.cuts) == 2 and m.cuts[0] < m.cuts[1] and m.weights[1] > 1 and m.weights[2] > 1
    z = np.array([m.weights[f].sum() for f in rows])
    guess = (m.above(z) >= 0.5).sum(axis=1)
    assert np.mean(guess == np.array(grades)) > 0.9


def test_one_grade_or_no_rows():
    for rows, grades in (([], []), ([np.array([1])], [0])):
        m = fit_ordinal(rows, np.array(grades, int), flags=16)
        assert not m.weights.any() and len(m.cuts) == 1


@pytest.fixture
def labelled(docs, spark, words):
    r = random.Random(3)
    rows, grades = [], []
    for k in range(400):
        g = int(r.random() < 0.25) * r.choice([1, 2])
        rows.append((k, words(k, 40) + " vile" * (g > 0) + " Vile awful" * (2 * (g > 1))))
        grades.append((k, g))
    return docs(rows), spark.createDataFrame([*grades, (None, 1), (3, None), (9999, 2)], "doc_id long, grade int")


def test_held_out_accuracy(docs, labelled, words):
    model = fit_toxicity(*labelled)
    odd = [(1, "so VILE"), (2, words(77, 50)), (3, None), (4, ""), (5, words(78, 5000) + " vile"), (1, "so VILE"), (None, "vile awful vile awful")]
    got = score_toxicity(docs(odd).withColumnRenamed("n", "severity"), model).collect()
    assert len(got) == 7 and {r["toxic"] for r in got if r["doc_id"] in (1, 5, None)} == {True} and {r["toxic"] for r in got if r["doc_id"] in (2, 3, 4)} == {False}
    by = {r["text"]: r for r in got}
    assert by["vile awful vile awful"]["severity"] > by["so VILE"]["severity"] > by[""]["severity"] == by[None]["severity"]
    assert "kept" in got[0].asDict() and got[0]["shard"] == "x"


def test_empty_tables(docs, spark):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = fit_toxicity(docs([]), none)
    assert score_toxicity(docs([]), model).collect() == [] and score_toxicity(docs([(1, "a")]), model).count() == 1


def plain_scores(text, model, threshold=0.5):
    """Severity, P(toxic) and grade by the definition."""
    half, seen = len(model.weights) // 2, Counter()
    one = lambda w: hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
        names = [one(w)] + [mix(one(w[:n]) + np.uint64(n)) for n in T.PREFIXES if len(w) >= n]
        seen.update(int(h[0]) % half for h in names)
    z = sum(float(model.weights[b]) + (float(model.weights[b + half]) if n >= T.OFTEN else 0) for b, n in seen.items())
    above = [1 / (1 + math.exp(c - z)) for c in model.cuts]
    return sum(above), above[0], sum(a >= threshold for a in above)


def test_query_against_the_definition(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit_toxicity(docs.select("doc_id", "text"), graded_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    got = op5_toxicity(spark, folder)
    assert got.dtypes == [("doc_id", "bigint"), ("severity", "double"), ("p_toxic", "double"), ("grade", "int"), ("toxic", "boolean"), ("kept", "boolean")]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = got.collect()
    assert {r["doc_id"] for r in got} == set(text)
    for r in got:
        severity, p, grade = plain_scores(text[r["doc_id"]], model)
        assert r["severity"] == pytest.approx(severity, abs=1e-6) and r["p_toxic"] == pytest.approx(p, abs=1e-6)
        assert (r["grade"], r["toxic"], r["kept"]) == (grade, grade > 0, grade == 0)


def test_held_out_labels(spark):
    """Fitted on half of the labelled rows, judged on the others."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = graded_labels(spark.read.parquet(f"{folder}/labels.parquet")).withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0)
    model = fit_toxicity(docs, labels.where("fit"))
    got = score_toxicity(docs.join(labels.where("not fit").withColumnRenamed("grade", "want"), "doc_id"), model)
    n = {(r["want"], r["grade"]): r["count"] for r in got.groupBy("want", "grade").count().collect()}
    per = {g: sum(v for (w, _), v in n.items() if w == g) for g in range(3)}
    share = {g: sum(v for (w, k), v in n.items() if w == g and k) / per[g] for g in range(3)}
    assert share[0] < 0.03 and share[2] > 0.9 and share[2] >= share[1] > 0.4
