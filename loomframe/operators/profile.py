"""Profiles of frames: one row per column, and what stands out."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.operators.columns import filter_rows, numeric, quoted


def _numbers(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def analyze(df: DataFrame, columns: Sequence[str] | None = None, where: str | None = None, approximate: bool = False) -> DataFrame:
    """column, dtype, count (of rows), null_count, null_pct, unique (NULL counts as a value), mean, std, min, max (numbers
    only), from one aggregation. approximate: unique by sketches of fixed size instead of exact sets."""
    df = filter_rows(df, where, columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    numbers = set(_numbers(df))
    none = F.lit(None).cast("double")
    n = F.count(F.lit(1))
    stats = []
    for i, c in enumerate(df.columns):
        x = quoted(c)
        y = x.cast("double")
        kind = df.schema[c].dataType
        orderly = x if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(x)
        different = F.approx_count_distinct(orderly) if approximate else F.countDistinct(orderly)
        nulls = n - F.count(x)
        stats.append(
            F.struct(
                F.lit(i).alias("nth"), F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), n.alias("count"), nulls.alias("null_count"),
                F.coalesce(F.try_divide(nulls * 100.0, n), F.lit(0.0)).alias("null_pct"), (different + (nulls > 0).cast("int")).alias("unique"),
                *[(f(y) if c in numbers else none).alias(a) for f, a in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max"))],
            )
        )
    return df.agg(F.array(*stats).alias("x")).select(F.inline("x")).drop("nth")


def outliers(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Per numeric column: lower, upper (quartiles -/+ factor x their distance) and the number of values outside."""
    columns = list(columns or _numbers(df))
    numeric(df, columns)
    quartiles = df.agg(*[F.percentile(quoted(c).cast("double"), F.array(F.lit(0.25), F.lit(0.75))).alias(f"q{i}") for i, c in enumerate(columns)])
    joined = df.crossJoin(F.broadcast(quartiles))  # one row
    out = []
    for i, c in enumerate(columns):
        a, b = F.get(F.col(f"q{i}"), F.lit(0)), F.get(F.col(f"q{i}"), F.lit(1))
        low, high = a - factor * (b - a), b + factor * (b - a)
        out.append(F.struct(F.lit(c).alias("column"), F.min(low).alias("lower"), F.max(high).alias("upper"), F.count_if((quoted(c) < low) | (quoted(c) > high)).alias("outliers")))
    return joined.agg(F.array(*out).alias("x")).select(F.inline("x"))


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_a, column_b, correlation for each pair of numeric columns."""
    columns = list(columns or _numbers(df))
    numeric(df, columns)
    pairs = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.corr(quoted(a).cast("double"), quoted(b).cast("double")).alias("correlation")) for a, b in combinations(columns, 2)]
    return df.agg(F.array(*pairs).alias("x")).select(F.inline("x"))


def distribution(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, low, high, rows: equal widths between the smallest and the largest value."""
    numeric(df, [column])
    x = quoted(column).cast("double")
    ends = df.agg(F.min(x).alias("__a"), F.max(x).alias("__b"))
    width = (F.col("__b") - F.col("__a")) / bins
    number = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(x - F.col("__a"), width)), F.lit(0)))
    joined = df.where(x.isNotNull()).crossJoin(F.broadcast(ends))  # one row
    counted = joined.groupBy(number.cast("int").alias("bin"), "__a", "__b").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("bin", (F.col("__a") + F.col("bin") * width).alias("low"), (F.col("__a") + (F.col("bin") + 1) * width).alias("high"), "rows")


def nulls(df: DataFrame) -> DataFrame:
    """column, null_count for the columns that have any."""
    return df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(quoted(c).isNull()).alias("null_count")) for c in df.columns]).alias("x")).select(F.inline("x")).where("null_count > 0")


def as_text(profile: DataFrame) -> str:
    """A profile, which has a row per column, as text."""
    rows = profile.collect()
    lines = [f"{len(rows)} columns"]
    for r in rows:
        numbers = "" if r["mean"] is None else f", mean {r['mean']:g}, std {r['std'] if r['std'] is not None else float('nan'):g}, {r['min']:g} to {r['max']:g}"
        lines.append(f"{r['column']} ({r['dtype']}): {r['count']} rows, {r['null_count']} null ({r['null_pct']:.1f} %), {r['unique']} different{numbers}")
    return "\n".join(lines)


def as_dict(profile: DataFrame) -> dict:
    rows = [r.asDict() for r in profile.collect()]
    return {"columns": [r["column"] for r in rows], "rows": rows[0]["count"] if rows else 0, "profile": rows}
