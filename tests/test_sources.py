import pytest

from dagframe.engine import Engine
from dagframe.plans import Workflow, samples
from dagframe.sources.tables import read_table, read_text


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_delimited_text(spark, tmp_path):
    p = tmp_path / "t.tbl"
    p.write_bytes(b'1|a||x|\n2|b|q||\n\n3|c|"z|w|\n4|d|e|last')
    assert rows(read_text(spark, str(p))) == [("1", "a", "", "x"), ("2", "b", "q", ""), ("3", "c", '"z', "w"), ("4", "d", "e", "last")]
    assert rows(read_text(spark, str(p), columns=[3, 0]))[0] == ("x", "1")


def test_ragged_rows_are_filled_with_nulls(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("h1,h2\n1\n2,3,4\n")
    assert rows(read_text(spark, str(p))) == [("h1", "h2", None), ("1", None, None), ("2", "3", "4")]


def test_other_files_are_whole_lines(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("a|b,c\n\nd\n")
    assert rows(read_table(spark, str(p))) == [("a|b,c",), ("d",)]


def test_pdf_is_refused(spark):
    with pytest.raises(ValueError):
        read_table(spark, "x.pdf")


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    w = Workflow()
    w.add("FileSource", "f", fileName=str(tmp_path))
    assert rows(Engine(spark).execute(w)["f"]) == [("x\ny",)]


def test_sample_plan_over_text(spark, tmp_path):
    (tmp_path / "customer.tbl").write_text("".join(f"{k}|n{k}|\n" for k in range(1, 5)))
    (tmp_path / "orders.tbl").write_text("".join(f"{k}|{c}|F|\n" for k, c in enumerate([1, 1, 2, 3, 3, 9])))
    w = samples.order_count_distribution(str(tmp_path / "customer.tbl"), str(tmp_path / "orders.tbl"))
    assert rows(Engine(spark).execute(w)["sort"]) == [(1, 1), (2, 2)]


def test_materialise_and_rescan(spark, tmp_path):
    t = {"t": spark.createDataFrame([(k, str(k)) for k in range(20)], "k int, v string")}
    for kind, back, props in (("LocalMaterializer", "LocalScanSource", {}), ("HashBasedMaterializer", "HashBasedFolderScan", {"attributeName": "k", "numBuckets": 3})):
        path = str(tmp_path / kind)
        w = Workflow()
        w.chain(w.add("ScanSource", tableName="t"), w.add(kind, "m", fileName=path, **props))
        assert Engine(spark, t).execute(w)["m"].count() == 0
        w = Workflow()
        w.add(back, "s", fileName=path)
        assert sorted(rows(Engine(spark).execute(w)["s"])) == [(k, str(k)) for k in range(20)]
