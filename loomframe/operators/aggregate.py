"""Aggregation functions and modes, and the grouped aggregate."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import CardinalityError, LoomError, need_columns
from loomframe.operators.columns import quoted

#: Modes that need numbers.
NUMERIC = frozenset({"sum", "mean", "average", "median", "min", "max", "std", "var", "variance"}) - {"min", "max"}
#: Modes whose result depends on the order of rows.
ORDERED = frozenset({"first", "last", "shortest", "longest", "forward_fill", "backward_fill", "concat", "list"})
MATCHES = ("trim", "anycase", "enforce_case", "fuzzy")
_MODES = frozenset({"auto", "strict", "most_common", "least_common", "count", "min", "max", "unique_count"}) | NUMERIC | ORDERED


@dataclass(frozen=True)
class Mode:
    name: str
    separator: str = "|"
    match: str | None = None


def parse_mode(spec: str | Mapping) -> Mode:
    """'concat[sep]' (with \\n, \\t, \\r), 'mode:match', 'mode', or a dict with the key mode."""
    if isinstance(spec, Mapping):
        if "mode" not in spec:
            raise LoomError("a strategy dict needs the key 'mode'")
        spec = spec["mode"]
    found = re.fullmatch(r"concat\[(.*)\]", spec, re.DOTALL)
    if found:
        separator = found[1]
        for a, b in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
            separator = separator.replace(a, b)
        return Mode("concat", separator)
    name, _, match = spec.partition(":")
    if name not in _MODES:
        need_columns(sorted(_MODES), [name], "aggregation mode")
    if match and match not in MATCHES:
        raise LoomError(f"no match modifier '{match}'", f"There are: {', '.join(MATCHES)}")
    return Mode(name, match=match or None)


def aggregated(x: Column, mode: Mode, order: Column, count_nulls: bool = False, what: str = "") -> Column:
    """The aggregate of a group. order: the order of rows. auto and strict raise when run if a group has several values
    (or rows). count counts all rows of the group if count_nulls. Modifiers: trim and anycase change the values first,
    fuzzy lets 'auto' take values at most two edits apart for one, and enforce_case keeps to case, as without any."""
    if mode.match == "trim":
        x = F.trim(x)
    elif mode.match == "anycase":
        x = F.lower(x)
    ordered = F.when(x.isNotNull(), F.struct(order))
    one_value = F.min(x).eqNullSafe(F.max(x))
    if mode.match == "fuzzy":
        values = F.collect_set(x)
        low = F.array_min(values)
        one_value = F.forall(values, lambda v: F.levenshtein(v, low) <= 2)
    conflict = F.raise_error(F.lit(f"{what}: rows of a key have different values; name an aggregation mode"))
    several = F.raise_error(F.lit(f"{what}: a key has several rows; 'strict' allows one"))
    text = F.coalesce(x.cast("string"), F.lit(""))
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("v"))))
    kinds = {
        "auto": lambda: F.when(one_value, F.min(x)).otherwise(conflict),
        "strict": lambda: F.when(F.count(F.lit(1)) <= 1, F.min(x)).otherwise(several),
        "first": lambda: F.min_by(x, order), "last": lambda: F.max_by(x, order),
        "forward_fill": lambda: F.min_by(x, ordered), "backward_fill": lambda: F.max_by(x, ordered),
        "shortest": lambda: F.min_by(x, F.when(x.isNotNull(), F.struct(F.octet_length(x.cast("string")), order))),
        "longest": lambda: F.min_by(x, F.when(x.isNotNull(), F.struct(-F.octet_length(x.cast("string")), order))),
        "most_common": lambda: F.mode(x, True),
        "sum": lambda: F.sum(x), "mean": lambda: F.avg(x), "average": lambda: F.avg(x), "median": lambda: F.median(x), "min": lambda: F.min(x), "max": lambda: F.max(x),
        "count": lambda: F.count(F.lit(1)) if count_nulls else F.count(x), "std": lambda: F.stddev_samp(x), "var": lambda: F.var_samp(x), "variance": lambda: F.var_samp(x),
        "unique_count": lambda: F.countDistinct(x),
        "concat": lambda: F.array_join(F.transform(listed, lambda s: s["v"]), mode.separator),
        "list": lambda: F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("v")))), lambda s: s["v"]),
    }
    return kinds[mode.name]()


def order_of(df: DataFrame, order_by: str | Sequence[str] | None) -> tuple[DataFrame, Column]:
    """An ordering expression; without order_by, the order in which rows are read, as far as Spark knows one."""
    if order_by is None:
        return df.withColumn("__order", F.monotonically_increasing_id()), F.col("__order")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    need_columns(df.columns, keys)
    return df, F.struct(*map(quoted, keys)) if len(keys) > 1 else quoted(keys[0])


def grouped(df: DataFrame, by: Sequence[str], outputs: Mapping[str, tuple[str, Mode]], order_by=None, count_nulls: bool = False) -> DataFrame:
    """One row per group; outputs: name to (column, mode). least_common is counted in two steps and joined."""
    need_columns(df.columns, [*by, *(c for c, _ in outputs.values())])
    for c, mode in outputs.values():
        if mode.name in NUMERIC and not isinstance(df.schema[c].dataType, T.NumericType):
            raise LoomError(f"'{mode.name}' of '{c}' needs numbers", f"The column is {df.schema[c].dataType.simpleString()}")
    ordered, order = (df, F.lit(0))
    if any(m.name in ORDERED for _, m in outputs.values()):
        ordered, order = order_of(df, order_by)
    rare = {name: c for name, (c, m) in outputs.items() if m.name == "least_common"}
    plain = [aggregated(quoted(c), m, order, count_nulls, c).alias(name) for name, (c, m) in outputs.items() if name not in rare]
    keys = list(map(quoted, by))
    out = ordered.groupBy(*keys).agg(*(plain or [F.count(F.lit(1)).alias("__rows")]))
    for name, c in rare.items():
        counts = df.where(quoted(c).isNotNull()).groupBy(*keys, quoted(c).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
        least = counts.groupBy(*keys).agg(F.min_by("__value", F.struct("__n", "__value")).alias(name)).select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)], name)
        on = F.lit(True)
        for i, k in enumerate(by):
            on = on & quoted(k).eqNullSafe(F.col(f"__k{i}"))
        out = out.join(least, on, "left").drop(*[f"__k{i}" for i in range(len(by))])
    return out.select(*keys, *[quoted(n) for n in outputs])


def aggregate(df: DataFrame, by: str | Sequence[str], strategy: Mapping, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """Group by columns. strategy: {column: mode}, {column: 'mode,mode'} or {column: [modes]} (columns {c}_{mode}), or
    {output: (column, mode)}. count counts non-null values; the sum of nothing but nulls is NULL."""
    by = [by] if isinstance(by, str) else list(by)
    outputs: dict[str, tuple[str, Mode]] = {}
    for key, spec in strategy.items():
        if isinstance(spec, tuple):
            outputs[key] = (spec[0], parse_mode(spec[1]))
            continue
        several = spec.split(",") if isinstance(spec, str) and "[" not in spec else [spec] if isinstance(spec, (str, Mapping)) else list(spec)
        for one in several:
            mode = parse_mode(one.strip() if isinstance(one, str) else one)
            outputs[key if len(several) == 1 else f"{key}_{mode.name}"] = (key, mode)
    if not outputs:
        raise LoomError("nothing to aggregate")
    return grouped(df, by, outputs, order_by)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys without nulls that several rows have, and how many (column rows)."""
    present = F.lit(True)
    for k in keys:
        present = present & quoted(k).isNotNull()
    return df.where(present).groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def repeats(df: DataFrame, keys: Sequence[str], examples: int = 5) -> DataFrame:
    """One row: rows, different keys, keys that repeat, rows that have such a key, their percentage, and the `examples`
    keys of most rows (ties: the smallest), as texts 'value,value (rows)'."""
    by = df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("n"))
    many = F.col("n") > 1
    text = F.concat_ws(",", *[F.coalesce(quoted(k).cast("string"), F.lit("null")) for k in keys])
    top = by.where(many).select("n", text.alias("key")).orderBy(F.desc("n"), "key").limit(examples)
    shown = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "key"))), lambda x: F.concat(x["key"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")"))).alias("examples"))
    of = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"), F.count_if(many).alias("repeated_keys"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("repeated_rows"))
    percent = F.coalesce(F.try_divide(F.col("repeated_rows") * 100.0, F.col("rows")), F.lit(0.0))
    return of.withColumn("percent", percent).crossJoin(F.broadcast(shown))  # one row each


def need_unique(df: DataFrame, keys: Sequence[str], side: str, why: str) -> None:
    if not repeated_keys(df, keys).isEmpty():
        raise CardinalityError(f"keys {', '.join(keys)} repeat in the {side} (1:many)", why)
