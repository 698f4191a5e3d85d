"""Projection, comparison, sort, limit and sentiment."""

from __future__ import annotations



from ..functions.columns import TYPES, as_type, column, constant, resolve, unique
from .registry import register_operator

_TEXT = {"type": "string"}
_KIND = {"type": "string", "enum": list(TYPES)}

COMPARISONS = {
    "=": lambda a, b: a == b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "≠": lambda a, b: a != b,
    "!=": lambda a, b: a != b,
    "<>": lambda a, b: a != b,
}


@register_operator("Projection", title="Projection", about="Keeps attributes in the order given; repeats are allowed.", properties={"projectionAttributes": _TEXT}, required=("projectionAttributes",))
def projection(session, inputs, p):
    (df,) = inputs
    refs = p["projectionAttributes"]
    names = [resolve(df, r.strip()) for r in (refs.split(",") if isinstance(refs, str) else refs)]
    return df.select(*(column(df, n).alias(a) for n, a in zip(names, unique(names))))


@register_operator("Comparison", title="Comparison", about="Keeps rows whose attribute compares with a constant; values that do not parse are dropped.", properties={"attributeName": _TEXT, "attributeType": _KIND, "comparisonType": _TEXT, "compareTo": {}, "dateFormat": _TEXT, "collation": _TEXT}, required=("attributeName", "attributeType", "comparisonType", "compareTo"))
def comparison(session, inputs, p):
    """An unknown comparison is equality."""
    (df,) = inputs
    value = as_type(df, p["attributeName"], p["attributeType"], p.get("dateFormat"), p.get("collation"))
    compare = COMPARISONS.get(p["comparisonType"], COMPARISONS["="])
    return df.where(compare(value, constant(p["compareTo"], p["attributeType"])))


@register_operator("InsertionSort", title="Sort", about="Sorts all rows by one attribute, ascending; values that do not parse come last.", group="Sort", properties={"attributeName": _TEXT, "attributeType": _KIND, "dateFormat": _TEXT, "collation": _TEXT}, required=("attributeName", "attributeType"))
def sort(session, inputs, p):
    (df,) = inputs
    return df.orderBy(as_type(df, p["attributeName"], p["attributeType"], p.get("dateFormat"), p.get("collation")).asc_nulls_last())


@register_operator("ViewResults", title="View results", about="A page of its input.", group="Results", outputs=0, properties={"limit": {"type": "integer", "default": 10}, "offset": {"type": "integer", "default": 0}})
def view_results(session, inputs, p):
    (df,) = inputs
    return df.offset(int(p.get("offset") or 0)).limit(int(p["limit"]) if p.get("limit") is not None else 10)


@register_operator("SentimentAnalysis", title="Sentiment", about="Replaces the row by a text and its sentiment.", group="Analytics", properties={"targetAttribute": _TEXT}, required=("targetAttribute",))
def sentiment_analysis(session, inputs, p):
    (df,) = inputs
    text = column(df, p["targetAttribute"]).cast("string")
    return df.select(text.alias("text"), session.sentiment(text).alias("sentiment"))


@register_operator("NlpSentiment", title="Sentiment column", about="Appends the sentiment of an attribute.", group="Analytics", properties={"attribute": _TEXT, "resultAttribute": _TEXT}, required=("attribute", "resultAttribute"))
def nlp_sentiment(session, inputs, p):
    (df,) = inputs
    return df.withColumn(p["resultAttribute"], session.sentiment(column(df, p["attribute"]).cast("string")))


