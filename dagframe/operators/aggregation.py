"""Global and grouped aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import Name, column, numeric, resolve, unique
from .registry import register_operator

_TEXT = {"type": "string"}
FUNCTIONS = ("max", "min", "avg", "count", "sum")


def _value(df, function: str, ref: str):
    """Counts are of rows; the others ignore what is no number, and are null where nothing is."""
    if function not in FUNCTIONS or function == "count":
        return F.count(F.lit(1))
    return {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}[function](numeric(df, ref))


def grouped(df, p, partial: bool):
    """``key, value``; the partial average is ``key, sum, count``."""
    key, ref = resolve(df, p["groupByAttribute"]), resolve(df, p["aggregationAttribute"])
    function = p["aggregationFunction"] if p["aggregationFunction"] in FUNCTIONS else "count"
    groups = df.groupBy(column(df, key).alias(key))
    if partial and function == "avg":
        out = groups.agg(F.sum(numeric(df, ref)).alias("a1"), F.count(numeric(df, ref)).alias("a2"))
        return out.toDF(*unique([key, f"sum_{ref}", f"count_{ref}"]))
    return groups.agg(_value(df, function, ref).alias("a1")).toDF(*unique([key, f"{function}_{ref}"]))


@register_operator("GroupBy", title="Local group-by", about="Aggregates by one key, in the layout that the global group-by merges.", properties={"groupByAttribute": _TEXT, "aggregationAttribute": _TEXT, "aggregationFunction": {"type": "string"}}, required=("groupByAttribute", "aggregationAttribute", "aggregationFunction"))
def group_by(session, inputs, p):
    (df,) = inputs
    return grouped(df, p, True)


@register_operator("GroupByFinal", title="Global group-by", about="Merges partial aggregates by their first column.", properties={"aggregationFunction": {"type": "string"}}, required=("aggregationFunction",), blocking=True)
def group_by_final(session, inputs, p):
    (df,) = inputs
    key, value = map(Name, df.columns[:2])
    function = p["aggregationFunction"]
    v = numeric(df, value)
    if function == "avg":
        if len(df.columns) < 3:
            raise ValueError("the partial average has a sum and a count")
        merged, name = F.sum(v) / F.sum(numeric(df, Name(df.columns[2]))), value.replace("sum_", "avg_", 1)
    elif function in ("max", "min", "sum"):
        merged, name = {"max": F.max, "min": F.min, "sum": F.sum}[function](v), value
    else:
        merged, name = F.sum(v.cast("long")), value
    return df.groupBy(column(df, key).alias(key)).agg(merged.alias("a1")).toDF(*unique([key, name]))


@register_operator("GroupByFused", title="Group-by", about="A local and a global group-by of one function in one.", properties={"groupByAttribute": _TEXT, "aggregationAttribute": _TEXT, "aggregationFunction": {"type": "string"}}, required=("groupByAttribute", "aggregationAttribute", "aggregationFunction"), blocking=True)
def group_by_fused(session, inputs, p):
    (df,) = inputs
    return grouped(df, p, False)


@register_operator("Aggregation", title="Aggregation", about="Aggregates all rows; without a list it counts them.", properties={"listOfAggregations": {"type": "array"}})
def aggregation(session, inputs, p):
    """Items ``attribute, aggregator, resultAttribute``; aggregators min, max, average, sum and count."""
    (df,) = inputs
    wanted = p.get("listOfAggregations")
    if not wanted:
        return df.agg(F.count(F.lit(1)).alias("count"))
    names = {"average": "avg"}
    for w in wanted:
        if names.get(w["aggregator"], w["aggregator"]) not in FUNCTIONS:
            raise ValueError(f"unknown aggregator {w['aggregator']!r}")
    return df.agg(*(_value(df, names.get(w["aggregator"], w["aggregator"]), w["attribute"]).alias(w["resultAttribute"]) for w in wanted))
