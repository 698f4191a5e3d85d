"""Sources and materialisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.columns import Name, column, resolve
from .registry import register_operator

_TEXT = {"type": "string"}


@register_operator("ScanSource", title="Scan", about="Reads a table, by a registered name or a path.", group="Source", inputs=0, properties={"tableName": _TEXT, "columns": {"type": "array"}, "numColumns": {"type": "integer"}}, required=("tableName",))
def scan(session, inputs, p):
    return session.table(p["tableName"], p.get("columns"), p.get("numColumns"))


@register_operator("FileSource", title="File", about="The content of one or more files, a row for each.", group="Source", inputs=0, properties={"fileName": _TEXT}, required=("fileName",))
def file_source(session, inputs, p):
    return session.spark.read.text(p["fileName"], wholetext=True).withColumnRenamed("value", "content")


def _matches(df, names, query):
    return reduce(lambda a, b: a | b, (column(df, n).cast("string").contains(query) for n in names))


def _with_spans(df, names, query, span_list):
    """Adds the first occurrence in each attribute as an array of (attribute, start, end)."""
    if not span_list:
        return df
    at = [(n, F.locate(query, column(df, n).cast("string"))) for n in names]
    each = [F.when(k > 0, F.struct(F.lit(resolve(df, n)).alias("attribute"), (k - 1).alias("start"), (k - 1 + len(query)).alias("end"))) for n, k in at]
    return df.withColumn(span_list, F.array_compact(F.array(*each)))


_KEYWORD = {"query": _TEXT, "attributes": {"type": "array"}, "spanListName": _TEXT}


@register_operator("KeywordSource", title="Keyword source", about="Rows of a table that contain a keyword in any of the attributes.", group="Source", inputs=0, properties={"tableName": _TEXT, **_KEYWORD}, required=("tableName", "query", "attributes"))
def keyword_source(session, inputs, p):
    df = session.table(p["tableName"])
    return _with_spans(df.where(_matches(df, p["attributes"], p["query"])), p["attributes"], p["query"], p.get("spanListName"))


@register_operator("KeywordMatcher", title="Keyword search", about="Keeps rows in which an attribute contains a keyword, case and all.", group="Search", properties={"attributeName": _TEXT, "keyword": _TEXT, **_KEYWORD})
def keyword_matcher(session, inputs, p):
    """One attribute and keyword, or several attributes and a query; no keyword matches all rows that have the attribute."""
    (df,) = inputs
    query = p.get("keyword", p.get("query")) or ""
    names = p.get("attributes") or [p["attributeName"]]
    return _with_spans(df.where(_matches(df, names, query)), names, query, p.get("spanListName"))


@register_operator("LocalScanSource", title="Materialised scan", about="Reads what a materialiser wrote.", group="Source", inputs=0, properties={"fileName": _TEXT}, required=("fileName",))
def materialised_scan(session, inputs, p):
    return session.spark.read.parquet(p["fileName"])


@register_operator("HashBasedFolderScan", title="Bucket scan", about="Reads the buckets that a hash materialiser wrote.", group="Source", inputs=0, properties={"fileName": _TEXT}, required=("fileName",))
def bucket_scan(session, inputs, p):
    return session.spark.read.parquet(p["fileName"]).drop("bucket")


@register_operator("LocalMaterializer", title="Materialise", about="Writes its input to a shared folder and emits no rows.", group="Storage", properties={"fileName": _TEXT}, required=("fileName",))
def materialise(session, inputs, p):
    (df,) = inputs
    session.defer(lambda: df.write.mode("overwrite").parquet(p["fileName"]))
    return df.limit(0)


@register_operator("HashBasedMaterializer", title="Hash materialise", about="Writes its input in buckets by the hash of a key and emits no rows.", group="Storage", properties={"fileName": _TEXT, "attributeName": _TEXT, "numBuckets": {"type": "integer", "default": 8}}, required=("fileName", "attributeName"))
def hash_materialise(session, inputs, p):
    (df,) = inputs
    n = int(p.get("numBuckets") or 8)
    bucket = F.pmod(F.hash(column(df, p["attributeName"])), F.lit(n))
    tasks = max(n, int(session.spark.conf.get("spark.sql.shuffle.partitions")))
    # A bucket is dealt to several tasks by its rows, so that neither few buckets nor a hot key bind the run to few of them.
    salt = F.pmod(F.xxhash64(*(column(df, Name(c)) for c in df.columns)), F.lit(-(-tasks // n)))
    dealt = df.withColumn("bucket", bucket).repartition(tasks, "bucket", salt)
    session.defer(lambda: dealt.write.mode("overwrite").partitionBy("bucket").parquet(p["fileName"]))
    return df.limit(0)


