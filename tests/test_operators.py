"""Operators on small rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from dagframe.engine import Engine
from dagframe.operators import REGISTRY, register_operator
from dagframe.plans import PlanError, Workflow


def run(spark, tables, *operators, **options):
    w = Workflow()
    w.chain(*(w.add(t, **p) for t, p in operators))
    (df,) = Engine(spark, tables).execute(w, **options).values()
    return df


def rows(df):
    return [tuple(r) for r in df.collect()]


def scan(name="t"):
    return "ScanSource", {"tableName": name}


def where(name, kind, how, value, **more):
    return "Comparison", {"attributeName": name, "attributeType": kind, "comparisonType": how, "compareTo": value, **more}


@pytest.fixture
def texts(spark):
    return {"t": spark.createDataFrame([(v,) for v in ["12", " 12 ", "+15", "9", "12.5", "", "2147483648", None]], "v string")}


def test_int_values_that_do_not_parse_are_dropped(spark, texts):
    assert rows(run(spark, texts, scan(), where("v", "int", ">=", "10"))) == [("12",), (" 12 ",), ("+15",)]


@pytest.mark.parametrize("how,want", [("=", 1), (">", 1), (">=", 2), ("<", 1), ("<=", 2), ("≠", 2), ("!=", 2), ("~", 1)])
def test_comparisons(spark, how, want):
    t = {"t": spark.createDataFrame([(1,), (2,), (3,), (None,)], "v int")}
    assert run(spark, t, scan(), where("_c0", "int", how, 2)).count() == want


def test_typed_columns_are_not_truncated(spark):
    t = {"t": spark.createDataFrame([(12.5,), (12.0,)], "v double")}
    assert rows(run(spark, t, scan(), where("v", "int", ">", 12))) == [(12.5,)]


def test_dates(spark):
    t = {"t": spark.createDataFrame([("1996-01-02",), ("1/2/1996",), ("x",)], "v string")}
    assert rows(run(spark, t, scan(), where("v", "date", ">", "1996-01-01"))) == [("1996-01-02",)]
    assert rows(run(spark, t, scan(), where("v", "date", ">", "1996-01-01", dateFormat="d/M/yyyy"))) == [("1/2/1996",)]


def test_string_order_is_binary_unless_collated(spark):
    t = {"t": spark.createDataFrame([("a",), ("C",)], "v string")}
    assert rows(run(spark, t, scan(), where("v", "string", "<", "B"))) == []
    assert rows(run(spark, t, scan(), where("v", "string", "<", "B", collation="UNICODE"))) == [("a",)]


@pytest.mark.parametrize("bad", [where("v", "int", "=", "1.5"), where("w", "int", "=", "1"), where("v", "date", "=", "soon"), ("Projection", {"projectionAttributes": "_c9"})])
def test_bad_properties_name_the_operator(spark, texts, bad):
    with pytest.raises(PlanError, match=bad[0]):
        run(spark, texts, scan(), bad)


def test_keyword_is_a_case_sensitive_substring(spark):
    t = {"t": spark.createDataFrame([("other",), ("The",), ("",), (None,)], "v string")}
    assert rows(run(spark, t, scan(), ("KeywordMatcher", {"attributeName": "v", "keyword": "the"}))) == [("other",)]
    assert run(spark, t, scan(), ("KeywordMatcher", {"attributeName": "v"})).count() == 3
    found = rows(run(spark, t, scan(), ("KeywordMatcher", {"attributes": ["v"], "query": "he", "spanListName": "at"})))
    assert [[tuple(s) for s in r[1]] for r in found] == [[("v", 2, 4)], [("v", 1, 3)]]


def test_projection_repeats(spark):
    t = {"t": spark.createDataFrame([(1, "a")], "x int, y string")}
    df = run(spark, t, scan(), ("Projection", {"projectionAttributes": "_c1, x, _c1"}))
    assert df.columns == ["y", "x", "y_2"] and rows(df) == [("a", 1, "a")]


def join(spark, kind, **keys):
    t = {
        "i": spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k int, x string"),
        "o": spark.createDataFrame([("p", 1), ("q", 3), ("r", None)], "y string, k int"),
    }
    w = Workflow()
    w.add(kind, "j", **keys)
    for s in "io":
        w.add("ScanSource", s, tableName=s)
        w.link(s, "j")
    (df,) = Engine(spark, t).execute(w).values()
    return df


KEYS = {"innerTableAttribute": "k", "outerTableAttribute": "k"}


@pytest.mark.parametrize("kind,columns,want", [
    ("HashJoin", ["y", "k", "x"], {("p", 1, "a"), ("p", 1, "b")}),
    ("HashRippleJoin", ["k", "x", "y"], {(1, "a", "p"), (1, "b", "p")}),
    ("CrossRippleJoin", ["k", "x", "y", "k_2"], {(1, "a", "p", 1), (1, "b", "p", 1)}),
])
def test_join_layouts(spark, kind, columns, want):
    df = join(spark, kind, **KEYS)
    assert df.columns == columns and set(rows(df)) == want


def test_cartesian_product(spark):
    assert join(spark, "CrossRippleJoin").count() == 12


def test_outer_join_is_an_extension(spark):
    assert join(spark, "HashJoin", how="left", **KEYS).count() == 4


def test_keys_of_different_types_compare_as_text(spark):
    t = {"i": spark.createDataFrame([("1",), ("01",), ("",)], "k string"), "o": spark.createDataFrame([(1,)], "k int")}
    w = Workflow()
    w.add("HashJoin", "j", **KEYS)
    for s in "io":
        w.add("ScanSource", s, tableName=s)
        w.link(s, "j")
    assert rows(Engine(spark, t).execute(w)["j"]) == [(1,)]


def grouped(function, final=True, other=None):
    local = ("GroupBy", {"groupByAttribute": "k", "aggregationAttribute": "v", "aggregationFunction": function})
    return [scan(), local] + ([("GroupByFinal", {"aggregationFunction": other or function})] if final else [])


@pytest.fixture
def pairs(spark):
    return {"t": spark.createDataFrame([("a", "1"), ("a", "x"), ("b", "3"), ("a", "2"), ("c", "x")], "k string, v string")}


@pytest.mark.parametrize("fuse", [True, False])
@pytest.mark.parametrize("function,want", [
    ("sum", {("a", 3.0), ("b", 3.0), ("c", None)}), ("avg", {("a", 1.5), ("b", 3.0), ("c", None)}), ("min", {("a", 1.0), ("b", 3.0), ("c", None)}),
    ("max", {("a", 2.0), ("b", 3.0), ("c", None)}), ("count", {("a", 3), ("b", 1), ("c", 1)}),
])
def test_group_by(spark, pairs, function, want, fuse):
    assert set(rows(run(spark, pairs, *grouped(function), fuse=fuse))) == want


def test_local_average_layout(spark, pairs):
    assert set(rows(run(spark, pairs, *grouped("avg", False)))) == {("a", 3.0, 2), ("b", 3.0, 1), ("c", None, 0)}


def test_unequal_pair(spark, pairs):
    assert set(rows(run(spark, pairs, *grouped("count", other="sum")))) == {("a", 3.0), ("b", 1.0), ("c", 1.0)}


def test_unknown_function_counts(spark, pairs):
    assert set(rows(run(spark, pairs, *grouped("median")))) == {("a", 3), ("b", 1), ("c", 1)}


def test_empty_inputs(spark):
    t = {"t": spark.createDataFrame([], "k string, v string")}
    assert rows(run(spark, t, scan(), ("Aggregation", {}))) == [(0,)]
    assert rows(run(spark, t, *grouped("sum"))) == [] and rows(run(spark, t, scan(), ("InsertionSort", {"attributeName": "k", "attributeType": "string"}))) == []


def test_sort_by_type(spark):
    t = {"t": spark.createDataFrame([("10",), ("9",), ("x",), ("2",)], "v string")}
    order = lambda kind: [r[0] for r in rows(run(spark, t, scan(), ("InsertionSort", {"attributeName": "v", "attributeType": kind})))]
    assert order("string") == ["10", "2", "9", "x"] and order("int") == ["2", "9", "10", "x"]


def test_sentiment_shapes(spark):
    t = {"t": spark.createDataFrame([("a Good day",), ("bad, bad!",), (None,)], "v string")}
    df = run(spark, t, scan(), ("SentimentAnalysis", {"targetAttribute": "v"}))
    assert [r[1] for r in rows(df)] == ["positive(Prob:0.7311,Score:1.0)", "negative(Prob:0.1192,Score:-2.0)", "positive(Prob:0.5000,Score:0.0)"]
    assert run(spark, t, scan(), ("NlpSentiment", {"attribute": "v", "resultAttribute": "s"})).columns == ["v", "s"]


def test_union_needs_equal_width(spark):
    t = {"a": spark.createDataFrame([(1, 2)], "x int, y int"), "b": spark.createDataFrame([(1,)], "x int")}
    w = Workflow()
    for s in "ab":
        w.add("ScanSource", s, tableName=s)
    w.add("Aggregation", "n")
    w.link("a", "n").link("b", "n")
    with pytest.raises(PlanError, match="different numbers"):
        Engine(spark, t).execute(w)


def test_user_operators(spark):
    try:
        @register_operator("Twice", properties={"attributeName": {"type": "string"}})
        def twice(session, inputs, p):
            """Doubles."""
            return inputs[0].selectExpr(f"{p['attributeName']} * 2 AS d")

        t = {"t": spark.createDataFrame([(4,)], "x int")}
        assert rows(run(spark, t, scan(), ("Twice", {"attributeName": "x"}))) == [(8,)]
        with pytest.raises(ValueError):
            register_operator("Twice")(twice)
    finally:
        REGISTRY.pop("Twice", None)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5)), max_size=20), st.lists(st.integers(0, 3), max_size=10))
def test_random_rows(spark, left, right):
    t = {"t": spark.createDataFrame(left, "k int, v int"), "u": spark.createDataFrame([(k,) for k in right], "k int")}
    sums = {k: float(sum(v for j, v in left if j == k)) for k, _ in left}
    assert dict(rows(run(spark, t, *grouped("sum"), fuse=False))) == sums == dict(rows(run(spark, t, *grouped("sum"))))
    w = Workflow()
    w.add("HashJoin", "j", **KEYS)
    for s in "tu":
        w.add("ScanSource", s, tableName=s)
        w.link(s, "j")
    assert Engine(spark, t).execute(w)["j"].count() == sum(right.count(k) for k, _ in left)
    values = [r[1] for r in rows(run(spark, t, scan(), ("InsertionSort", {"attributeName": "v", "attributeType": "int"})))]
    assert values == sorted(v for _, v in left)
