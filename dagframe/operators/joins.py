"""Equi-joins that differ in their column layouts, and the Cartesian product.

Input 0 is the inner (build) side, input 1 the outer. Null keys never match; empty strings do.
Catalyst and adaptive execution choose the physical join and split skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import resolve, unique
from .registry import register_operator

_TEXT = {"type": "string"}
_KEYS = {"innerTableAttribute": _TEXT, "outerTableAttribute": _TEXT}
_HOW = {"how": {"type": "string", "enum": ["inner", "left", "right", "full"], "default": "inner"}}


def _joined(first: DataFrame, second: DataFrame, first_key: str, second_key: str, keep_second_key: bool, how: str = "inner") -> DataFrame:
    """All columns of ``first``, then those of ``second``, its key only if asked for; repeated names are numbered."""
    k1, k2 = resolve(first, first_key), resolve(second, second_key)
    names = first.columns, [c for c in second.columns if keep_second_key or c != k2]
    final = unique([*names[0], *names[1]])
    a = first.toDF(*(f"a{i}" for i in range(len(first.columns))))
    b = second.toDF(*(f"b{i}" for i in range(len(second.columns))))
    left, right = a[f"a{first.columns.index(k1)}"], b[f"b{second.columns.index(k2)}"]
    if first.schema[k1].dataType != second.schema[k2].dataType:
        left, right = left.cast("string"), right.cast("string")
    kept = [f"a{i}" for i in range(len(first.columns))] + [f"b{i}" for i, c in enumerate(second.columns) if keep_second_key or c != k2]
    return a.join(b, left == right, how).select(*kept).toDF(*final)


@register_operator("HashJoin", title="Hash join", about="Joins on one key: the outer row, then the inner row without its key.", group="Join", inputs=2, properties=_KEYS | _HOW, required=tuple(_KEYS), blocking=True)
def hash_join(session, inputs, p):
    inner, outer = inputs
    how = {"left": "left", "right": "right"}.get(p.get("how"), p.get("how") or "inner")
    return _joined(outer, inner, p["outerTableAttribute"], p["innerTableAttribute"], False, how)


@register_operator("HashRippleJoin", title="Ripple join", about="Joins on one key: the inner row, then the outer row without its key.", group="Join", inputs=2, properties=_KEYS, required=tuple(_KEYS), blocking=True)
def ripple_join(session, inputs, p):
    inner, outer = inputs
    return _joined(inner, outer, p["innerTableAttribute"], p["outerTableAttribute"], False)


@register_operator("CrossRippleJoin", title="Cross join", about="The Cartesian product; with keys, a join that keeps both.", group="Join", inputs=2, properties={**_KEYS, "batchingLimit": _TEXT})
def cross_join(session, inputs, p):
    inner, outer = inputs
    if p.get("innerTableAttribute") and p.get("outerTableAttribute"):
        return _joined(inner, outer, p["innerTableAttribute"], p["outerTableAttribute"], True)
    names = unique([*inner.columns, *outer.columns])
    a = inner.toDF(*names[: len(inner.columns)])
    return a.crossJoin(outer.toDF(*names[len(inner.columns) :]))


