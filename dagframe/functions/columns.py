"""Column references and typed comparison values."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = ("int", "double", "date", "string")
_SQL = {"int": "INT", "double": "DOUBLE", "date": "TIMESTAMP", "string": "STRING"}


class Name(str):
    """A column's name, as opposed to a reference that may be a place."""


def resolve(df: DataFrame, ref: str) -> Name:
    """A column's name, from its place ``_cN`` or the name. Places come first: they are counted anew in each output."""
    if isinstance(ref, Name):
        return ref
    if (m := re.fullmatch(r"_c(\d+)", ref or "")) and int(m[1]) < len(df.columns):
        return Name(df.columns[int(m[1])])
    if ref in df.columns:
        return Name(ref)
    raise KeyError(f"no column {ref} among {', '.join(df.columns)}")


def column(df: DataFrame, ref: str) -> Column:
    return F.col("`" + resolve(df, ref).replace("`", "``") + "`")


def as_type(df: DataFrame, ref: str, kind: str, date_format: str | None = None, collation: str | None = None) -> Column:
    """The column as it is compared or sorted. Only strings are parsed, and what does not parse is null."""
    if kind not in TYPES:
        raise ValueError(f"attributeType must be one of {', '.join(TYPES)}, not {kind!r}")
    c, type = column(df, ref), df.schema[resolve(df, ref)].dataType
    if kind == "string":
        c = c if isinstance(type, T.StringType) else c.cast("string")
        return F.collate(c, collation) if collation else c
    if isinstance(type, T.StringType):
        if kind == "date" and date_format:
            return F.try_to_timestamp(c, F.lit(date_format))
        return c.try_cast(_SQL[kind])
    if kind == "date":
        return c if isinstance(type, (T.TimestampType, T.TimestampNTZType, T.DateType)) else c.cast("string").try_cast("TIMESTAMP")
    return c if isinstance(type, T.NumericType) else c.cast("string").try_cast(_SQL[kind])


def constant(value, kind: str) -> Column:
    """The literal that a column is compared with; a constant of the wrong form is an error."""
    text = str(value)
    if kind == "int":
        if not re.fullmatch(r"\s*[+-]?\d+\s*", text):
            raise ValueError(f"{value!r} is no int")
        return F.lit(int(text))
    if kind == "double":
        return F.lit(float(text))
    if kind == "date":
        return F.lit(datetime.fromisoformat(text.strip())).cast("timestamp_ntz")
    return F.lit(text)


def numeric(df: DataFrame, ref: str) -> Column:
    """The column as double; strings that do not parse are null."""
    c, type = column(df, ref), df.schema[resolve(df, ref)].dataType
    return c.cast("double") if isinstance(type, T.NumericType) else c.cast("string").try_cast("double")


def unique(names: list[str]) -> list[str]:
    """The names, later repeats numbered."""
    out: list[str] = []
    for n in names:
        k, name = 2, n
        while name in out:
            name, k = f"{n}_{k}", k + 1
        out.append(name)
    return out
