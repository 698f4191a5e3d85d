"""Tables from files: parquet, and text whose delimiter follows from the suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = {"tbl": "|", "csv": ","}


def delimiter(path: str) -> str | None:
    """``|`` for .tbl, ``,`` for .csv; other files are one field a line."""
    return DELIMITERS.get(path.rsplit(".", 1)[-1].lower())


def read_text(spark: SparkSession, path: str, columns: list[int] | None = None, n_columns: int | None = None) -> DataFrame:
    """Lines cut at the delimiter, as strings ``_c0, _c1, ...`` renumbered after ``columns`` are kept.

    No quoting, escaping or header. Blank lines are no rows. An empty last field is dropped (so a
    delimiter may close a line), an empty middle field is kept, and fields that a row lacks are null.
    The width is ``n_columns``, or the highest of ``columns``, else that of the widest line, which
    takes a pass over the file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).where("value <> ''")
    sep = delimiter(path)
    if sep is None:
        return lines.select(F.col("value").alias("_c0"))
    fields = F.split("value", "\\" + sep, -1)
    rows = lines.select(F.when(F.element_at(fields, -1) == "", F.slice(fields, F.lit(1), F.size(fields) - 1)).otherwise(fields).alias("f"))
    if columns is None:
        width = n_columns or rows.agg(F.max(F.size("f"))).first()[0] or 1
        columns = list(range(width))
    return rows.select(*(F.get("f", F.lit(c)).alias(f"_c{k}") for k, c in enumerate(columns)))


def read_table(spark: SparkSession, path: str, columns: list[int | str] | None = None, n_columns: int | None = None) -> DataFrame:
    """A file or folder by its suffix; any file system that Spark knows, web HDFS included."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "pdf":
        raise ValueError("pdf files are not read")
    if kind == "parquet":
        df = spark.read.parquet(path)
        return df if columns is None else df.select(*(df.columns[c] if isinstance(c, int) else c for c in columns))
    return read_text(spark, path, columns, n_columns)
