import corpus_pipeline
from corpus_pipeline import STAGES, run

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_against_its_rule(spark, tmp_path):
    from tests_llm_helpers import near_groups, windows_hit

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, before, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows, kept = {r["doc_id"]: r["text"] for r in before.collect()}, [r["doc_id"] for r in after.collect()]
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            assert not [i for i in set(rows) - set(kept) if labels.get(i) == 0]
        elif name == "near_dedup":
            groups = near_groups(rows)
            assert sorted(kept) == sorted(min(g) for g in groups)
        elif name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            assert sorted(kept) == sorted(i for i, t in rows.items() if not windows_hit(t, items))
        elif name == "mixing":
            assert set(kept) <= set(rows) and 0.7 * len(rows) < len(kept) < 1.4 * len(rows)
        else:
            assert after.columns == [*columns, "shard", "slot"] and sorted(kept) == sorted(r["doc_id"] for r in before.collect())
            sizes = [r["count"] for r in after.groupBy("shard").count().collect()]
            assert len(sizes) == corpus_pipeline.N_SHARDS and max(sizes) - min(sizes) <= 1
        if k < len(STAGES) - 1:
            assert after.columns == columns
        before = after


def test_run(spark):
    out = run(spark, FOLDER)
    assert out.count() > 100 and {"doc_id", "text", "shard", "slot"} <= set(out.columns)


def test_near_dedup_keeps_one_row_of_each_group(spark, docs, words):
    one, two, three = (words(k, 40, 5000) for k in range(3))
    rows = [(1, one), (2, one + " x"), (2, two), (5, three), (5, three), (None, three), (None, "alone here"), (None, "alone here"), (7, ""), (7, ""), (8, None)]
    got = corpus_pipeline.near_dedup(spark, docs(rows), FOLDER)
    assert got.columns == docs([]).columns
    want = [(1, one), (2, two), (5, three), (None, "alone here"), (7, ""), (7, ""), (8, None)]
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=repr) == sorted(want, key=repr)


def folder_of(spark, path, rows):
    """Tables of (doc_id, text) rows with more columns, labels and a benchmark."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, hash int, `odd name` array<int>"
    full = [(i, t, "en" if k % 2 else "fr", "s", len(t or ""), k, "x", None, [None, k]) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("q", "of " * 5), (None, None), (None, "an item without an id")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_nulls_repeats_long_texts_and_more_columns(spark, words, tmp_path):
    rows = [(1, words(1, 50)), (1, words(1, 50)), (1, words(2, 50)), (None, words(3, 40)), (None, None), (4, None), (5, ""), (6, words(6, 30000, 9000)), (7, "x" * 20000), (8, "a  b\t")]
    out = run(spark, folder_of(spark, tmp_path / "t", rows))
    assert {"odd name", "lang", "shard", "slot"} <= set(out.columns)
    got = out.collect()
    assert {(r["doc_id"], r["text"]) for r in got} <= set(rows) and len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert max(r["slot"] for r in got) <= len(got) // corpus_pipeline.N_SHARDS


def test_empty_tables(spark, tmp_path):
    assert run(spark, folder_of(spark, tmp_path / "t", [])).collect() == []


def test_rows_that_mixing_repeats_are_not_neighbours(spark):
    at = {}
    for r in run(spark, "/root/testdata/sf0.01").select("doc_id", "shard", "slot").collect():
        at.setdefault(r["doc_id"], []).append((r["shard"], r["slot"]))
    again = [v for v in at.values() if len(v) > 1]
    together = sum(len({s for s, _ in v}) == 1 for v in again)
    near = sum(any((s, k + 1) in v for s, k in v) for v in again)
    assert len(again) > 50 and together < 0.35 * len(again) and near < 0.1 * len(again)


def test_benchmark_items_without_an_id_count(spark, docs, tmp_path):
    folder = folder_of(spark, tmp_path / "t", [(1, "x")])
    got = corpus_pipeline.decontamination(spark, docs([(1, "An item; without an ID!"), (2, "another text"), (None, None)]), folder)
    assert sorted(repr(r["doc_id"]) for r in got.collect()) == ["2", "None"]
