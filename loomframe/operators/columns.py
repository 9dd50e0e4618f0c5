"""Column transforms: calculation, filter, sort, rounding, splitting, extraction, units."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import LoomError, need_columns
from loomframe.functions.formulas import build, half_up
from loomframe.functions.units import convert

_NUMBERS = (T.NumericType,)


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric(df: DataFrame, columns: Sequence[str]) -> None:
    need_columns(df.columns, list(columns))
    for c in columns:
        if not isinstance(df.schema[c].dataType, _NUMBERS):
            raise LoomError(f"column '{c}' isn't numeric", f"It is {df.schema[c].dataType.simpleString()}")


def calc(df: DataFrame, formulas: str | Sequence[str] | Mapping[str, str], names: str | Sequence[str] | None = None) -> DataFrame:
    """New columns from formulas, one after the other, so that later ones can use earlier ones. Default names: result,
    or result_0, result_1 and so on."""
    if isinstance(formulas, Mapping):
        pairs = list(formulas.items())
    else:
        texts = [formulas] if isinstance(formulas, str) else list(formulas)
        own = [names] if isinstance(names, str) else list(names) if names else ["result"] if len(texts) == 1 else [f"result_{i}" for i in range(len(texts))]
        if len(own) != len(texts):
            raise LoomError(f"{len(texts)} formulas but {len(own)} names")
        pairs = list(zip(own, texts, strict=True))
    for name, text in pairs:
        df = df.withColumn(name, build(text, df.schema))
    return df


def filter_rows(df: DataFrame, where: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows for which the predicate holds, then the named columns."""
    if where:
        df = df.where(build(where, df.schema))
    if columns:
        need_columns(df.columns, list(columns))
        df = df.select(*map(quoted, columns))
    return df


def rows(df: DataFrame, spec: str, order_by: str | Sequence[str]) -> DataFrame:
    """Rows by place in an order, counted from 1: 'first:10', 'last:5', '25-50', '61', 'first', 'last'."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    m = re.fullmatch(r"(first|last)(?::(\d+))?|(\d+)(?:-(\d+))?", spec.strip())
    if not m:
        raise LoomError(f"'{spec}' names no rows", "For example first:10, last:5, 25-50, 61")
    if m[1]:
        order = [quoted(k).asc_nulls_first() if m[1] == "first" else quoted(k).desc_nulls_last() for k in keys]
        return df.orderBy(*order).limit(int(m[2] or 1))
    low, high = int(m[3]), int(m[4] or m[3])
    return df.orderBy(*[quoted(k).asc_nulls_first() for k in keys]).offset(max(0, low - 1)).limit(max(0, high - max(1, low) + 1))


def sort(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str] = "asc") -> DataFrame:
    """Sorted by columns, nulls first either way. order: one direction, or one for each column."""
    by = [by] if isinstance(by, str) else list(by)
    orders = [order] * len(by) if isinstance(order, str) else list(order)
    need_columns(df.columns, by)
    if len(orders) != len(by) or any(o not in ("asc", "desc") for o in orders):
        raise LoomError(f"'{order}' is no order", "There are: asc, desc")
    return df.orderBy(*[quoted(c).asc_nulls_first() if o == "asc" else quoted(c).desc_nulls_first() for c, o in zip(by, orders, strict=True)])


def banker(x: Column, digits: int) -> Column:
    """Halves (within 1e-10 at that scale) go to the even neighbour."""
    m = 10.0**digits
    low = F.floor(x * m)
    part = x * m - low
    even = F.when(low % 2 == 0, low).otherwise(low + 1)
    return F.when(F.abs(part - 0.5) < 1e-10, even).otherwise(F.floor(x * m + 0.5)) / m


def round_columns(df: DataFrame, columns: str | Sequence[str], how: str = "round", digits: int = 2, names: Mapping[str, str] | None = None) -> DataFrame:
    """New columns {c}_round (or a given name). how: round (halves up), up, down, banker."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    numeric(df, columns)
    m = 10.0**digits
    ways = {"round": lambda x: half_up(x, digits), "up": lambda x: F.ceil(x * m) / m, "down": lambda x: F.floor(x * m) / m, "banker": lambda x: banker(x, digits)}
    if how not in ways:
        raise LoomError(f"no way of rounding '{how}'", f"There are: {', '.join(ways)}")
    return df.withColumns({(names or {}).get(c, f"{c}_round"): ways[how](quoted(c).cast("double")) for c in columns})


def split(df: DataFrame, column: str, by: str = " ", parts: int = 2) -> DataFrame:
    """{c}_1 to {c}_N: the pieces between literal separators; NULL where there is none."""
    need_columns(df.columns, [column])
    pieces = F.split(quoted(column).cast("string"), re.escape(by) if by else "", -1)
    return df.withColumns({f"{column}_{i + 1}": F.get(pieces, F.lit(i)) for i in range(parts)})


def _hour(c: Column) -> Column:
    return F.hour(c)


#: Components of dates and times.
DATE_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": _hour, "minute": F.minute, "second": F.second, "quarter": F.quarter,
    "day_of_week": lambda c: F.weekday(c) + 1, "day_name": lambda c: F.date_format(c, "EEEE"), "month_name": lambda c: F.date_format(c, "MMMM"), "week": F.weekofyear, "day_of_year": F.dayofyear,
    "is_weekend": lambda c: F.weekday(c) >= 5, "is_business_hour": lambda c: (F.weekday(c) < 5) & F.hour(c).between(9, 16),
    "time_of_day": lambda c: F.when(F.hour(c) < 6, "night").when(F.hour(c) < 12, "morning").when(F.hour(c) < 18, "afternoon").otherwise("evening"),
}
#: Components of strings.
TEXT_PARTS = {
    "username": lambda c: F.get(F.split(c, "@"), F.lit(0)), "domain": lambda c: F.get(F.split(c, "@"), F.lit(1)),
    "scheme": lambda c: F.try_parse_url(c, F.lit("PROTOCOL")), "host": lambda c: F.try_parse_url(c, F.lit("HOST")), "path": lambda c: F.try_parse_url(c, F.lit("PATH")), "query": lambda c: F.try_parse_url(c, F.lit("QUERY")),
    "fragment": lambda c: F.try_parse_url(c, F.lit("REF")), "port": lambda c: F.nullif(F.regexp_extract(c, r"^[a-zA-Z][\w+.-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1), F.lit("")).cast("int"),
    "country_code": lambda c: F.nullif(F.regexp_extract(c, r"^\s*\+(\d{1,3})[-. (]", 1), F.lit("")), "extension": lambda c: F.nullif(F.regexp_extract(c, r"(?:x|ext\.?)\s*(\d+)\s*$", 1), F.lit("")),
    "digits": lambda c: F.regexp_replace(c, r"\D", ""), "area_code": lambda c: F.nullif(F.regexp_extract(c, r"(?:\+?1[-. ]?)?\(?(\d{3})\)?[-. ]?\d{3}[-. ]?\d{4}", 1), F.lit("")),
}


def extract(df: DataFrame, columns: str | Sequence[str], parts: Sequence[str] | None = None, pattern: str | None = None) -> DataFrame:
    """New columns {c}_{part}.

    Without parts: year, month, day (and hour if there is a time) of dates and timestamps; username and domain of strings
    whose column has 'email' in its name or of which any value has both @ and a dot (found by a job of its own); hour and
    month of other strings, read as timestamps. pattern: a regular expression whose first group becomes {c}_extract.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    need_columns(df.columns, columns)
    new: dict[str, Column] = {}
    for c in columns:
        kind, x = df.schema[c].dataType, quoted(c)
        if pattern is not None:
            new[f"{c}_extract"] = F.nullif(F.regexp_extract(x.cast("string"), pattern, 1), F.lit(""))
            continue
        dated = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
        if not dated and not isinstance(kind, T.StringType):
            raise LoomError(f"column '{c}' must be of datetime or string type", f"It is {kind.simpleString()}")
        own = list(parts) if parts else None
        if own is None and dated:
            own = ["year", "month", "day"] + ([] if isinstance(kind, T.DateType) else ["hour"])
        elif own is None:
            email = "email" in c.lower() or not df.where(x.contains("@") & x.contains(".")).isEmpty()
            own = ["username", "domain"] if email else ["hour", "month"]
        need_columns([*DATE_PARTS, *TEXT_PARTS], own, "part")
        for p in own:
            new[f"{c}_{p}"] = TEXT_PARTS[p](x) if p in TEXT_PARTS else DATE_PARTS[p](x if dated else F.try_to_timestamp(x))
    return df.withColumns(new)


def to_datetime(df: DataFrame, columns: str | Sequence[str], partial: str = "null") -> DataFrame:
    """String columns as timestamps, in place. Dates of a year, or year and month, alone become NULL or the start, the
    middle or the end of that span."""
    if partial not in ("null", "start", "mid", "end"):
        raise LoomError(f"'{partial}' isn't null, start, mid or end")
    columns = [columns] if isinstance(columns, str) else list(columns)
    need_columns(df.columns, columns)
    for c in columns:
        x = F.trim(quoted(c).cast("string"))
        year, month = x.rlike(r"^\d{4}$"), x.rlike(r"^\d{4}-\d{2}$")
        day = {"null": ("", ""), "start": ("-01-01", "-01"), "mid": ("-07-01", "-15"), "end": ("-12-31", "")}[partial]
        if partial == "null":
            filled = F.when(~(year | month), x)
        else:
            whole = F.concat(x, F.lit(day[1])) if partial != "end" else F.last_day(F.concat(x, F.lit("-01")).try_cast("date")).cast("string")
            filled = F.when(year, F.concat(x, F.lit(day[0]))).when(month, whole).otherwise(x)
        df = df.withColumn(c, filled.try_cast("timestamp_ntz"))
    return df


def scale(df: DataFrame, columns: str | Sequence[str], how: str = "normalize") -> DataFrame:
    """{c}_normalize: (x - min) / (max - min); {c}_standardize: (x - mean) / standard deviation. One row of totals is
    joined to all rows; NULL where the divisor is zero."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    numeric(df, columns)
    if how not in ("normalize", "standardize"):
        raise LoomError(f"no scaling '{how}'", "There are: normalize, standardize")
    center, high = (F.min, F.max) if how == "normalize" else (F.avg, F.stddev_samp)
    totals = df.agg(*[f(quoted(c)).alias(f"__{k}_{i}") for i, c in enumerate(columns) for k, f in (("a", center), ("b", high))])
    joined = df.crossJoin(F.broadcast(totals))  # one row
    for i, c in enumerate(columns):
        width = F.col(f"__b_{i}") - F.col(f"__a_{i}") if how == "normalize" else F.col(f"__b_{i}")
        joined = joined.withColumn(f"{c}_{how}", F.try_divide(quoted(c) - F.col(f"__a_{i}"), width))
    return joined.drop(*totals.columns)


def bin_column(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str] | None = None, name: str | None = None) -> DataFrame:
    """{c}_bin: the label, or the number from 0, of the interval [edge, next edge) that holds the value; NULL outside."""
    numeric(df, [column])
    labels = list(labels) if labels else None
    if labels and len(labels) != len(edges) - 1:
        raise LoomError(f"{len(edges)} edges need {len(edges) - 1} labels")
    x, out = quoted(column), None
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        inside, value = (x >= a) & (x < b), F.lit(labels[i] if labels else i)
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return df.withColumn(name or f"{column}_bin", out if out is not None else F.lit(None).cast("int"))


def harmonize(df: DataFrame, column: str, kind: str, source: str = "", target: str = "", name: str | None = None, rate: float | None = None) -> DataFrame:
    """A numeric column in another unit, as {c}_{unit} or a given name."""
    numeric(df, [column])
    return df.withColumn(name or f"{column}_{target or kind}", convert(quoted(column).cast("double"), kind, source, target, rate))


def ranked(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str] = "asc", name: str = "rank", within: Sequence[str] = ()) -> DataFrame:
    """row_number in the order of sort(), inside groups if there are any."""
    by = [by] if isinstance(by, str) else list(by)
    orders = [order] * len(by) if isinstance(order, str) else list(order)
    keys = [quoted(c).asc_nulls_first() if o == "asc" else quoted(c).desc_nulls_first() for c, o in zip(by, orders, strict=True)]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*map(quoted, within)).orderBy(*keys)))
