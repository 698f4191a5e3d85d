"""Registered queries of the workflow engine, each a workflow, with the same question in DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine
from .functions.sentiment import NEGATIVE, POSITIVE
from .plans import Workflow, samples
from .streaming.control import StreamRun

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str, names: list[str] | None = None, after: Callable[[DataFrame], DataFrame] | None = None, **options):
    """Registers a workflow builder; its one sink, with columns named ``names``, is the result."""

    def add(build: Callable[[], Workflow]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            (df,) = Engine.over(spark, sf_dir).execute(build(), **options).values()
            df = df.toDF(*names) if names else df
            return after(df) if after else df

        QUERIES[name], ORACLES[name] = run, sql
        return build

    return add


def _flow(*operators: tuple[str, dict]) -> Workflow:
    w = Workflow()
    return w.chain(*(w.add(type, **p) for type, p in operators))


def _scan(table: str) -> tuple[str, dict]:
    return "ScanSource", {"tableName": table}


def _project(*names: str) -> tuple[str, dict]:
    return "Projection", {"projectionAttributes": ",".join(names)}


def _where(name: str, kind: str, how: str, value) -> tuple[str, dict]:
    return "Comparison", {"attributeName": name, "attributeType": kind, "comparisonType": how, "compareTo": value}


def _numbered(df: DataFrame) -> DataFrame:
    """Numbers rows in the order in which the engine puts them out, so that a comparison of results proves it.

    Ids rise from row to row and partition to partition; the offsets of the partitions make them numbers.
    The rows are kept, as ids of another evaluation may be others.
    """
    at = df.withColumn("_at", F.monotonically_increasing_id()).persist()
    part = F.shiftrightunsigned("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = at.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn("rank", (F.col("_at") - F.shiftleft("_part", 33) + F.col("_before") + 1).cast("long")).drop("_at", "_part", "_before")


_query("scan_project", "SELECT o_orderkey, o_custkey FROM orders")(lambda: _flow(_scan("orders"), _project("o_orderkey", "_c1")))
_query("project_reorder_repeat", "SELECT n_name, n_nationkey, n_name AS n_name_2 FROM nation")(lambda: _flow(_scan("nation"), _project("n_name", "n_nationkey", "n_name")))

for _name, _filter, _sql in [
    ("filter_eq", ("o_orderstatus", "string", "=", "F"), "o_orderstatus = 'F'"),
    ("filter_ne", ("o_orderstatus", "string", "≠", "F"), "o_orderstatus <> 'F'"),
    ("filter_gt", ("o_totalprice", "double", ">", "150000.5"), "o_totalprice > 150000.5"),
    ("filter_ge", ("o_orderkey", "int", ">=", "1000"), "o_orderkey >= 1000"),
    ("filter_lt", ("o_orderdate", "date", "<", "1996-01-01"), "o_orderdate < TIMESTAMP '1996-01-01'"),
    ("filter_le", ("o_custkey", "int", "<=", 300), "o_custkey <= 300"),
    ("filter_unknown_is_eq", ("o_orderstatus", "string", "~", "O"), "o_orderstatus = 'O'"),
]:
    _query(_name, f"SELECT o_orderkey, o_custkey FROM orders WHERE {_sql}")(lambda f=_filter: _flow(_scan("orders"), _where(*f), _project("o_orderkey", "o_custkey")))

_query("filter_chain", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R' AND l_shipdate <= TIMESTAMP '1998-09-02'")(
    lambda: _flow(_scan("lineitem"), _where("l_quantity", "double", ">", 25), _where("l_returnflag", "string", "=", "R"), _where("l_shipdate", "date", "<=", "1998-09-02"), _project("l_orderkey", "l_linenumber"))
)
_query("keyword_search", "SELECT doc_id FROM documents WHERE contains(text, 'the')")(lambda: _flow(_scan("documents"), ("KeywordMatcher", {"attributeName": "text", "keyword": "the"}), _project("doc_id")))
_query("keyword_multi", "SELECT c_custkey FROM customer WHERE contains(c_name, 'A') OR contains(c_mktsegment, 'A')")(lambda: _flow(_scan("customer"), ("KeywordMatcher", {"attributes": ["c_name", "c_mktsegment"], "query": "A"}), _project("c_custkey")))
_query("keyword_source", "SELECT doc_id FROM documents WHERE contains(text, 'and') OR contains(source, 'and')")(lambda: _flow(("KeywordSource", {"tableName": "documents", "query": "and", "attributes": ["text", "source"]}), _project("doc_id")))

_query("count_all", "SELECT count(*) AS count FROM lineitem")(lambda: _flow(_scan("lineitem"), ("Aggregation", {})))
_query("count_filtered", "SELECT count(*) AS count FROM lineitem WHERE l_quantity > 25")(lambda: _flow(_scan("lineitem"), _where("l_quantity", "double", ">", "25"), ("Aggregation", {})))
_query("count_empty", "SELECT count(*) AS count FROM lineitem WHERE l_quantity > 1000")(lambda: _flow(_scan("lineitem"), _where("l_quantity", "double", ">", "1000"), ("Aggregation", {})))
_query(
    "global_multi_agg",
    "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, sum(l_quantity) AS total, count(*) AS n FROM lineitem",
    after=lambda df: df.withColumn("mean", F.round("mean", 6)),
)(lambda: _flow(_scan("lineitem"), ("Aggregation", {"listOfAggregations": [{"attribute": "l_quantity", "aggregator": a, "resultAttribute": r} for a, r in (("min", "lo"), ("max", "hi"), ("average", "mean"), ("sum", "total"), ("count", "n"))]})))


def _grouped(function: str) -> Workflow:
    return _flow(_scan("lineitem"), ("GroupBy", {"groupByAttribute": "l_returnflag", "aggregationAttribute": "l_quantity", "aggregationFunction": function}), ("GroupByFinal", {"aggregationFunction": function}))


for _f in ("sum", "min", "max", "avg", "count"):
    _query(f"groupby_{_f}", f"SELECT l_returnflag, {'round(avg(l_quantity), 6)' if _f == 'avg' else 'count(*)' if _f == 'count' else f'{_f}(l_quantity)'} AS v FROM lineitem GROUP BY 1", ["l_returnflag", "v"], (lambda df: df.withColumn("v", F.round("v", 6))) if _f == "avg" else None)(lambda f=_f: _grouped(f))
    _query(f"groupby_{_f}_unfused", ORACLES[f"groupby_{_f}"], ["l_returnflag", "v"], (lambda df: df.withColumn("v", F.round("v", 6))) if _f == "avg" else None, fuse=False)(lambda f=_f: _grouped(f))

_query("groupby_local_avg", "SELECT l_returnflag, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1", ["l_returnflag", "s", "n"])(
    lambda: _flow(_scan("lineitem"), ("GroupBy", {"groupByAttribute": "l_returnflag", "aggregationAttribute": "l_quantity", "aggregationFunction": "avg"}))
)
_query("groupby_mismatched", "SELECT l_returnflag, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1", ["l_returnflag", "v"])(
    lambda: _flow(_scan("lineitem"), ("GroupBy", {"groupByAttribute": "l_returnflag", "aggregationAttribute": "l_quantity", "aggregationFunction": "count"}), ("GroupByFinal", {"aggregationFunction": "sum"}))
)
_query("having_filter", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12", ["o_custkey", "n"])(
    lambda: _flow(_scan("orders"), ("GroupBy", {"groupByAttribute": "o_custkey", "aggregationAttribute": "o_orderkey", "aggregationFunction": "count"}), ("GroupByFinal", {"aggregationFunction": "count"}), _where("_c1", "int", ">", 12))
)

for _kind, _key in [("int", "o_custkey"), ("double", "o_totalprice"), ("date", "o_orderdate"), ("string", "o_orderpriority")]:
    _query(f"sort_{_kind}", f"SELECT {_key}, row_number() OVER (ORDER BY {_key}) AS rank FROM orders", after=lambda df, k=_key: _numbered(df).select(k, "rank"))(
        lambda k=_key, t=_kind: _flow(_scan("orders"), ("InsertionSort", {"attributeName": k, "attributeType": t}), _project("o_orderkey", k))
    )
_query("sort_text_of_number", "SELECT q, row_number() OVER (ORDER BY q) AS rank FROM (SELECT l_quantity::VARCHAR AS q FROM lineitem)", after=lambda df: _numbered(df).select(F.col("l_quantity").cast("string").alias("q"), "rank"))(
    lambda: _flow(_scan("lineitem"), ("InsertionSort", {"attributeName": "l_quantity", "attributeType": "string"}), _project("l_orderkey", "l_linenumber", "l_quantity"))
)


def _join(type: str, inner: str, outer: str, **keys) -> Workflow:
    w = Workflow()
    w.add(type, "join", **keys)
    for t in (inner, outer):
        w.add("ScanSource", t, tableName=t)
        w.link(t, "join")
    return w


_CUSTOMER_ORDERS = {"innerTableAttribute": "c_custkey", "outerTableAttribute": "o_custkey"}
_query("hash_join", "SELECT orders.*, c_name, c_nationkey, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")(lambda: _join("HashJoin", "customer", "orders", **_CUSTOMER_ORDERS))
_query("ripple_join", "SELECT customer.*, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey")(lambda: _join("HashRippleJoin", "customer", "orders", **_CUSTOMER_ORDERS))
_query("cross_join_keyed", "SELECT * FROM region JOIN nation ON r_regionkey = n_regionkey")(lambda: _join("CrossRippleJoin", "region", "nation", innerTableAttribute="r_regionkey", outerTableAttribute="n_regionkey"))
_query("cross_join", "SELECT * FROM region CROSS JOIN nation")(lambda: _join("CrossRippleJoin", "region", "nation"))
_query("order_count_distribution", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1", ["n", "customers"])(samples.order_count_distribution)
_query("quantity_sorted", "SELECT q, row_number() OVER (ORDER BY q) AS rank FROM (SELECT l_quantity::VARCHAR AS q FROM lineitem)", after=lambda df: _numbered(df.select(F.col("l_quantity").cast("string").alias("q"))))(samples.sorted_quantities)
_query("pricing_summary", "SELECT l_returnflag, sum(l_quantity) AS total, row_number() OVER (ORDER BY l_returnflag) AS rank FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1", ["l_returnflag", "total"], _numbered)(samples.quantity_by_flag)


@_query("fan_in_union", "SELECT count(*) AS count FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def _fan_in() -> Workflow:
    w = _flow(_scan("orders"))
    w.add("Aggregation", "count")
    for s in "FO":
        w.add("Comparison", s, attributeName="o_orderstatus", attributeType="string", comparisonType="=", compareTo=s)
        w.chain("ScanSource-0", s, "count")
    return w


@_query("fan_out_join", "SELECT a.n_nationkey, a.n_name, b.n_name AS n_name_2 FROM nation a JOIN nation b USING (n_nationkey)")
def _fan_out() -> Workflow:
    w = _flow(_scan("nation"), _project("n_nationkey", "n_name"))
    w.add("HashRippleJoin", "join", innerTableAttribute="n_nationkey", outerTableAttribute="n_nationkey")
    for side in ("a", "b"):
        w.add("Comparison", side, attributeName="n_nationkey", attributeType="int", comparisonType=">=", compareTo=0)
        w.chain("Projection-1", side, "join")
    return w


_query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10")(lambda: _flow(_scan("orders"), _project("o_orderkey"), ("InsertionSort", {"attributeName": "o_orderkey", "attributeType": "int"}), ("ViewResults", {"limit": 20, "offset": 10})))


@_query("three_way_join_agg", "SELECT r_name, count(*) AS customers FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1", ["r_name", "customers"])
def _three_way() -> Workflow:
    w = _join("HashJoin", "region", "nation", innerTableAttribute="r_regionkey", outerTableAttribute="n_regionkey")
    w.add("ScanSource", "customer", tableName="customer")
    w.add("HashJoin", "join2", innerTableAttribute="n_nationkey", outerTableAttribute="c_nationkey")
    w.link("join", "join2").link("customer", "join2")
    return w.chain("join2", w.add("GroupBy", groupByAttribute="r_name", aggregationAttribute="c_custkey", aggregationFunction="count"), w.add("GroupByFinal", aggregationFunction="count"))


def _lexicon_sql(words: tuple[str, ...]) -> str:
    return f"len(regexp_extract_all(' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), '  ') || ' ', ' ({'|'.join(words)}) '))"


_query(
    "sentiment_lexicon",
    f"SELECT text, CASE WHEN s >= 0 THEN 'positive' ELSE 'negative' END || printf('(Prob:%.4f,Score:%.1f)', 1 / (1 + exp(-s)), s) AS sentiment FROM (SELECT text, ({_lexicon_sql(POSITIVE)} - {_lexicon_sql(NEGATIVE)})::DOUBLE AS s FROM documents)",
)(lambda: _flow(_scan("documents"), ("SentimentAnalysis", {"targetAttribute": "text"})))
_query(
    "sentiment_column",
    f"SELECT doc_id, CASE WHEN s >= 0 THEN 'positive' ELSE 'negative' END || printf('(Prob:%.4f,Score:%.1f)', 1 / (1 + exp(-s)), s) AS feeling FROM (SELECT doc_id, ({_lexicon_sql(POSITIVE)} - {_lexicon_sql(NEGATIVE)})::DOUBLE AS s FROM documents)",
)(lambda: _flow(_scan("documents"), ("NlpSentiment", {"attribute": "text", "resultAttribute": "feeling"}), _project("doc_id", "feeling")))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; of this machine only where Spark runs on it alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _registered(name: str, sql: str):
    def add(query: Query) -> Query:
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return add


@_registered("materialize_rescan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 10")
def materialize_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes buckets by a key with one workflow and reads them back with another."""
    path, engine = _scratch(spark, "buckets"), Engine.over(spark, sf_dir)
    engine.execute(_flow(_scan("orders"), _project("o_orderkey", "o_custkey"), ("HashBasedMaterializer", {"fileName": path, "attributeName": "o_custkey", "numBuckets": 4})))
    (df,) = engine.execute(_flow(("HashBasedFolderScan", {"fileName": path}), _where("o_custkey", "int", ">", 10))).values()
    return df


@_registered("materialize_local", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 3")
def materialize_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a table with one workflow and reads it back with another."""
    path, engine = _scratch(spark, "table"), Engine.over(spark, sf_dir)
    engine.execute(_flow(_scan("nation"), _project("n_nationkey", "n_name"), ("LocalMaterializer", {"fileName": path})))
    (df,) = engine.execute(_flow(("LocalScanSource", {"fileName": path}), _where("n_nationkey", "int", ">=", 3))).values()
    return df


def _text_of(spark: SparkSession, sf_dir: str, kind: str, *values: Column) -> str:
    """Orders as lines of text fields, for the text source."""
    path = f"{_scratch(spark, 'text')}.{kind}"
    spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat_ws({"tbl": "|", "csv": ","}[kind], *values)).write.text(path)
    return path


@_registered("scan_tbl", "SELECT o_orderkey::VARCHAR AS key, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F'")
def scan_tbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bar-delimited text whose lines end in a bar; an empty field in the middle."""
    path = _text_of(spark, sf_dir, "tbl", F.col("o_orderkey").cast("string"), F.lit(""), F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit(""))
    (df,) = Engine(spark).execute(_flow(("ScanSource", {"tableName": path}), _where("_c2", "string", "=", "F"), _project("_c0", "_c3"))).values()
    return df.toDF("key", "priority")


@_registered("scan_csv_columns", "SELECT o_orderpriority AS priority, o_orderkey::VARCHAR AS key FROM orders")
def scan_csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-delimited text of which two fields are read, in another order."""
    path = _text_of(spark, sf_dir, "csv", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    (df,) = Engine(spark).execute(_flow(("ScanSource", {"tableName": path, "columns": [2, 0]}))).values()
    return df.toDF("priority", "key")


def _mixed(spark: SparkSession, sf_dir: str) -> str:
    """Text in which the number of every third order is no number."""
    number = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string"))
    return _text_of(spark, sf_dir, "tbl", F.col("o_orderkey").cast("string"), number, F.col("o_orderstatus"))


@_registered("filter_text_numbers", "SELECT o_orderkey::VARCHAR AS key FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey > 50")
def filter_text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings are parsed for a comparison of numbers; what does not parse is dropped."""
    (df,) = Engine(spark).execute(_flow(("ScanSource", {"tableName": _mixed(spark, sf_dir)}), _where("_c1", "int", ">", "50"), _project("_c0"))).values()
    return df.toDF("key")


@_registered("sort_text_numbers", "SELECT number, row_number() OVER (ORDER BY TRY_CAST(number AS INT) NULLS LAST) AS rank FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE o_custkey::VARCHAR END AS number FROM orders)")
def sort_text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings are sorted as numbers; what does not parse comes last."""
    (df,) = Engine(spark).execute(_flow(("ScanSource", {"tableName": _mixed(spark, sf_dir)}), ("InsertionSort", {"attributeName": "_c1", "attributeType": "int"}), _project("_c1"))).values()
    return _numbered(df.toDF("number"))


@_registered("groupby_text_numbers", "SELECT o_orderstatus AS status, sum(CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END)::DOUBLE AS total FROM orders GROUP BY 1")
def groupby_text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings are summed as numbers; what does not parse is left out."""
    group = {"groupByAttribute": "_c2", "aggregationAttribute": "_c1", "aggregationFunction": "sum"}
    (df,) = Engine(spark).execute(_flow(("ScanSource", {"tableName": _mixed(spark, sf_dir)}), ("GroupBy", group), ("GroupByFinal", {"aggregationFunction": "sum"}))).values()
    return df.toDF("status", "total")


@_registered("file_source", "SELECT 1::BIGINT AS files, sum(len(r_name) + 1)::BIGINT AS length FROM region")
def file_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole file as one row."""
    path = _scratch(spark, "file")
    spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name").coalesce(1).write.text(path)
    (df,) = Engine(spark).execute(_flow(("FileSource", {"fileName": path}))).values()
    return df.agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).cast("long").alias("length"))


@_registered("several_sinks", "SELECT 'F' AS sink, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'O', count(*) FROM orders WHERE o_orderstatus = 'O'")
def several_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan with two sinks."""
    w = _flow(_scan("orders"))
    for s in "FO":
        w.add("Comparison", s, attributeName="o_orderstatus", attributeType="string", comparisonType="=", compareTo=s)
        w.add("Aggregation", f"count {s}")
        w.chain("ScanSource-0", s, f"count {s}")
    got = Engine.over(spark, sf_dir).execute(w)
    a, b = (got[f"count {s}"].select(F.lit(s).alias("sink"), F.col("count").alias("n")) for s in "FO")
    return a.union(b)


@_registered("keyword_spans", "SELECT c_custkey, strpos(c_mktsegment, 'U') - 1 AS at FROM customer WHERE contains(c_mktsegment, 'U')")
def keyword_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a keyword stands."""
    (df,) = Engine.over(spark, sf_dir).execute(_flow(("KeywordSource", {"tableName": "customer", "query": "U", "attributes": ["c_mktsegment"], "spanListName": "spans"}))).values()
    return df.select("c_custkey", F.col("spans")[0]["start"].cast("long").alias("at"))


@_registered("checkpoint_join", ORACLES["three_way_join_agg"])
def checkpoint_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inputs of joins and global group-bys go through written tables."""
    (df,) = Engine.over(spark, sf_dir, work_dir=_scratch(spark, "steps")).execute(_three_way(), checkpoint=True).values()
    return df.toDF("r_name", "customers")


@_registered("stream_groupby", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_custkey > 10 GROUP BY 1")
def stream_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files that is filtered as it comes; the group-by runs over what was delivered."""
    path = _scratch(spark, "stream")
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus").repartition(3).write.parquet(f"{path}/in.parquet")
    w = Workflow()
    w.add("ScanSource", "scan", tableName=f"{path}/in.parquet")
    w.add("Comparison", "some", attributeName="o_custkey", attributeType="int", comparisonType=">", compareTo=10)
    w.add("GroupBy", "local", groupByAttribute="o_orderstatus", aggregationAttribute="o_orderkey", aggregationFunction="count")
    w.add("GroupByFinal", "global", aggregationFunction="count")
    w.chain("scan", "some", "local", "global")
    return StreamRun(Engine(spark), w, "scan", f"{path}/run").start().wait().results().toDF("status", "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["pricing_summary"](spark, sf_dir)
