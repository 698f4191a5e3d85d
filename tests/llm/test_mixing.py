import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dagframe.llm.mixing import BUCKETS, domain_posteriors, fit_domains, fit_rates, mix, mixing_rates


@pytest.fixture
def corpus(spark, docs, words):
    text = lambda d, k: words(k, 20 + k % 30, 200).replace("w", d)
    rows = [(k, text("a" if k % 10 < 7 else "b", k)) for k in range(300)] + [(400, None), (401, ""), (402, "\t\n"), (None, text("b", 5)), (8, text("a", 8)), (8, text("b", 9))]
    labelled = spark.createDataFrame([(text("a", k), "a") for k in range(500, 540)] + [(text("b", k), "b") for k in range(540, 560)] + [(None, "a"), ("x", None), ("y", "c")], "text string, domain string")
    return docs(rows), labelled, rows


def test_rates_meet_targets(corpus):
    docs, labelled, rows = corpus
    got = mixing_rates(docs, labelled, {"a": 0.5, "b": 0.5}).collect()
    assert sum(r["copies"] for r in got) == len(rows)
    assert all(abs(r["p0"] + r["p1"] - 1) < 1e-9 and r["rate"] >= 0 for r in got)
    mass = [sum(r["rate"] * r["copies"] * r["tokens"] * r[f"p{k}"] for r in got) for k in (0, 1)]
    total = sum(len((t or "").split()) for _, t in rows)
    assert mass == pytest.approx([total / 2] * 2, rel=1e-4)
    assert all((r["p0"] > 0.5) == (r["id"] % 10 < 7) for r in got if r["id"] is not None and r["id"] < 300 and r["id"] != 8)


def test_posterior_against_brute_force(spark, corpus):
    docs, labelled, rows = corpus
    table, priors = fit_domains(labelled, ["a", "b"])
    likely = {r["bucket"]: (r["w0"], r["w1"]) for r in table.collect()}
    assert len(likely) == BUCKETS and priors == pytest.approx([42 / 63, 21 / 63])
    got = {r["id"]: r for r in mixing_rates(docs, labelled, {"a": 1, "b": 3}).collect() if r["id"] in (1, 9, 400)}
    for id, r in got.items():
        ws = (dict(rows)[id] or "").split()
        buckets = [b[0] for b in spark.createDataFrame([(w,) for w in ws], "w string").select(F.pmod(F.xxhash64("w"), F.lit(BUCKETS))).collect()] if ws else []
        z = [math.log(priors[d]) + (20 / max(20, len(ws)) * sum(likely[b][d] for b in buckets) if ws else 0) for d in (0, 1)]
        assert r["p0"] == pytest.approx(1 / (1 + math.exp(z[1] - z[0])), abs=1e-6)


def test_mix_repeats_rows(corpus):
    docs, labelled, _ = corpus
    rates = {(r["id"], r["hash"]): r for r in mixing_rates(docs, labelled, {"a": 1, "b": 9}).collect()}
    out = mix(docs, labelled, {"a": 1, "b": 9})
    assert out.columns == docs.columns
    got = Counter((r[0], r[1]) for r in out.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    assert got == {k: r["repeats"] * r["copies"] for k, r in rates.items() if r["repeats"]}
    assert all(abs(r["repeats"] - r["rate"]) < 1 for r in rates.values())


def test_projection_keeps_rates_at_zero(spark):
    post = spark.createDataFrame([(1, 0, 1, 100, 0.9, 0.1), (2, 0, 1, 100, 0.1, 0.9)], "id int, hash int, copies int, tokens long, p0 double, p1 double")
    rate, share = fit_rates(post, [0.0, 1.0])
    assert min(r[0] for r in post.select(rate).collect()) == 0 and share[1] == pytest.approx(0.9, abs=0.02)


def test_empty_and_bad(docs, spark):
    none = spark.createDataFrame([], "text string, domain string")
    assert mix(docs([]), none, {"a": 1}).collect() == []
    assert mix(docs([(1, "x y")]), none, {"a": 1, "b": 1}).count() == 1
    with pytest.raises(ValueError):
        mix(docs([]), none, {})


def test_missed_targets_are_reported(docs, spark):
    none = spark.createDataFrame([], "text string, domain string")
    with pytest.warns(UserWarning, match="targets are not met"):
        mixing_rates(docs([(1, "x y"), (2, "z")]), none, {"a": 9, "b": 1})


def test_a_very_long_text(docs, spark, words):
    labelled = spark.createDataFrame([("a b c", "a"), ("x y z", "b")], "text string, domain string")
    got = {r["id"]: r for r in mixing_rates(docs([(1, "a b " * 100_000), (2, "x " * 300)]), labelled, {"a": 0.5, "b": 0.5}).collect()}
    assert got[1]["tokens"] == 200_000 and got[2]["tokens"] == 300 and got[1]["p0"] > 0.9 > 0.1 > got[2]["p0"]


def test_words_do_not_read_their_text_again(spark, docs):
    """The expansion into words drops the text: what is hashed or split for each word grows with the square of a text's length."""
    table, priors = fit_domains(spark.createDataFrame([("a b", "a"), ("x y", "b")], "text string, domain string"), ["a", "b"])
    got = domain_posteriors(docs([(1, "a b a"), (1, "a b a"), (2, " "), (3, None)]).select(F.col("doc_id").alias("id"), "text"), table, priors)
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    above = plan[: next(i for i, line in enumerate(plan) if "Generate" in line)]
    assert not any("text#" in line for line in above)
    assert {r["id"]: (r["copies"], r["tokens"]) for r in got.collect()} == {1: (2, 3), 2: (1, 0), 3: (1, 0)}
