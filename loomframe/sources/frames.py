"""Frames from and to other libraries, and from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.errors import LoomError


def as_frame(spark: SparkSession, data) -> DataFrame:
    """A Spark frame of a Spark, pandas, polars or Arrow one."""
    if isinstance(data, DataFrame):
        return data
    kind = type(data).__module__.partition(".")[0]
    if kind == "polars":
        data = data.to_arrow()
    elif kind not in ("pandas", "pyarrow"):
        raise LoomError(f"'{type(data).__name__}' is no frame", "Give a Spark, pandas, polars or Arrow one")
    return spark.createDataFrame(data)


def as_type(df: DataFrame, kind: str | None):
    """None: the Spark frame itself; pandas, arrow or polars: a local copy, for results that fit into the driver."""
    if kind in (None, "spark"):
        return df
    if kind == "pandas":
        return df.toPandas()
    if kind == "arrow":
        return df.toArrow()
    if kind == "polars":
        import polars

        return polars.from_arrow(df.toArrow())
    raise LoomError(f"no type '{kind}'", "There are: spark, pandas, arrow, polars")


def read(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    return spark.read.format(format).options(**options).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by=(), **options) -> None:
    df.write.format(format).mode(mode).partitionBy(*partition_by).options(**options).save(path)
