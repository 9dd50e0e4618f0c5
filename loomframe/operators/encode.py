"""Encoding of categories and turning a frame on its side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.errors import LoomError, need_columns
from loomframe.operators.columns import quoted
from loomframe.operators.impute import numbered


def onehot(df: DataFrame, columns: str | Sequence[str], prefix: bool = True, drop_first: bool = False, most: int = 10_000) -> DataFrame:
    """0/1 columns {c}_{v} (or {v}) for the sorted distinct values, which one job collects; NULL is 0 everywhere. More
    than `most` values are an error: that many columns help nobody."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    need_columns(df.columns, columns)
    for c in columns:
        text = quoted(c).cast("string")
        found = [r[0] for r in df.select(text.alias("v")).where("v IS NOT NULL").distinct().limit(most + 1).collect()]
        if len(found) > most:
            raise LoomError(f"'{c}' has more than {most} values")
        values = sorted(found)[1 if drop_first else 0 :]
        taken = {x.lower() for x in df.columns}
        for v in values:
            if (f"{c}_{v}" if prefix else v).lower() in taken:
                raise LoomError(f"there is a column '{f'{c}_{v}' if prefix else v}' already", "Names differ by more than case")
        df = df.withColumns({f"{c}_{v}" if prefix else v: F.coalesce(text == v, F.lit(False)).cast("int") for v in values})
    return df


def label(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """{c}_code: 0 to n - 1 over the values sorted as strings; NULL stays NULL. Ranks are given to the distinct values only,
    range by range, where the ranges are cut by a sample of the values."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    need_columns(df.columns, columns)
    for c in columns:
        values = df.select(quoted(c).cast("string").alias("__v")).where("__v IS NOT NULL").distinct()
        codes = numbered(values, "__v", f"{c}_code").withColumn(f"{c}_code", F.col(f"{c}_code").cast("int"))
        df = df.join(codes, quoted(c).cast("string") == F.col("__v"), "left").drop("__v")
    return df


def transpose(df: DataFrame, header: str | None = None, most: int = 1000) -> DataFrame:
    """Rows to columns, for frames of at most `most` rows: one row per column, named in `key`; columns are the values of
    `header`, or column_0, column_1 and so on in reading order. All values become one common type."""
    small = df.limit(most + 1)
    if small.count() > most:
        raise LoomError(f"more than {most} rows can't become columns")
    if header is not None:
        need_columns(df.columns, [header])
        return df.transpose(quoted(header))
    order = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1
    return small.select(F.concat(F.lit("column_"), order).alias("__h"), "*").transpose(F.col("__h"))


def melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(map(quoted, keys)), list(map(quoted, values)), variable, value)
