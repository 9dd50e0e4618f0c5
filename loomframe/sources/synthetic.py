"""Synthetic data. Every value is a function of seed, column and row number alone, so results don't depend on how rows are
dealt to tasks, and columns of the same kind are independent."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import LoomError, need_columns
from loomframe.operators.columns import quoted
from loomframe.operators.impute import numbered

_SCALE = 2**53
_FIRST, _LAST = "Ada Ben Cleo Dan Eva Finn Gia Hal Ivy Jon".split(), "Ash Birch Cedar Elm Fir Hazel Larch Oak Pine Rowan".split()
_STREETS, _TOWNS = "High Mill Park Lake Hill River Church Station".split(), "Ashford Brookton Clearwater Dunmore Eastvale Fairhaven Glenwood Hillcrest".split()
#: Words for people and places that mean nobody and nowhere: lists to pick from, or a number up to which to count.
PLACEHOLDERS = {"name": [_FIRST, _LAST], "city": [_TOWNS], "address": [200, _STREETS, ["Street", "Road", "Lane"]]}


def uniform(row: Column, seed: int, name: str, draw: int | Column = 0) -> Column:
    """In (0, 1)."""
    return (F.pmod(F.xxhash64(row, F.lit(seed), F.lit(name), F.lit(draw)), F.lit(_SCALE)) + 0.5) / float(_SCALE)


def gaussian(row: Column, seed: int, name: str, draw: int | Column = 0) -> Column:
    return F.sqrt(-2.0 * F.ln(uniform(row, seed, name, 2 * draw + 1000))) * F.cos(2.0 * math.pi * uniform(row, seed, name, 2 * draw + 1001))


def _pick(items: list, u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.floor(u * len(items)) + 1).cast("int"))


def _clamped(x: Column, spec: Mapping) -> Column:
    if spec.get("min") is not None:
        x = F.greatest(x, F.lit(float(spec["min"])))
    return F.least(x, F.lit(float(spec["max"]))) if spec.get("max") is not None else x


#: Tries of a rejection sampler; that all fail has a chance below the resolution of a double.
TRIES = 16


def _gamma(row: Column, seed: int, name: str, shape: float, salt: int) -> Column:
    """Gamma variate by Marsaglia and Tsang's rejection from a transformed normal; shapes below 1 by the usual power of a
    uniform."""
    d = (shape if shape >= 1 else shape + 1) - 1 / 3

    def tried(i: Column) -> Column:
        x, u = gaussian(row, seed, name, 100 * salt + i), uniform(row, seed, name, 10_000 + 100 * salt + i)
        v = F.pow(1 + x / math.sqrt(9 * d), F.lit(3.0))
        return F.when((v > 0) & (F.ln(u) < 0.5 * x * x + d - d * v + d * F.ln(v)), d * v)

    out = F.aggregate(F.array(*map(F.lit, range(TRIES))), F.lit(None).cast("double"), lambda held, i: F.when(held.isNotNull(), held).otherwise(tried(i)), lambda held: F.coalesce(held, F.lit(d)))
    return out if shape >= 1 else out * F.pow(uniform(row, seed, name, 20_000 + salt), F.lit(1 / shape))


def _by_table(masses: list[float], u: Column, first: int = 0) -> Column:
    """Inverse of a cumulated table of masses for first, first + 1 and so on."""
    total, steps = 0.0, []
    for p in masses:
        total += p
        steps.append(total)
    steps = steps[:-1]
    if len(steps) <= 64:
        return F.lit(first) + (F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s < u)) if steps else F.lit(0))
    # a constant, searched by halving
    table = F.split(F.lit(",".join(map(repr, steps))), ",").cast("array<double>")
    halves = F.array(*[F.lit(1 << i) for i in range(len(steps).bit_length() - 1, -1, -1)])
    return F.lit(first) + F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) < u, at + step).otherwise(at))


def _log_masses(log_mass, low: int, high: int) -> list[float]:
    """Masses of low to high, which add up to 1."""
    out = [math.exp(log_mass(k)) for k in range(low, high + 1)]
    return [x / math.fsum(out) for x in out]


def _counts(name: str, mean: float, variance: float, most: float, log_mass, u: Column) -> Column:
    """A count by its table, ten deviations and some around the mean: what is left out is below a double's resolution."""
    width = int(10 * math.sqrt(variance)) + 40
    if width > 1_000_000:
        raise LoomError(f"'{name}': the table of this distribution has {2 * width} rows")
    low, high = max(0, int(mean) - width), int(min(most, mean + width))
    return _by_table(_log_masses(log_mass, low, high), u, low)


def shorthand(text: str) -> dict:
    """'normal(40, 10)', 'uniform(0, 1)', 'choice:a,b', 'range:1-5', 'normal:mean=1,std=2', 'increment[5]:start=1:pattern=EMP_[001]'."""
    order = {"normal": ("mean", "std"), "lognormal": ("mean", "std"), "uniform": ("min", "max"), "exponential": ("lambda",), "poisson": ("lambda",), "binomial": ("n", "p"), "beta": ("alpha", "beta")}
    m = re.fullmatch(r"(\w+)\((.*)\)", text.strip())
    if m and m[1] in order:
        return {"distribution": m[1], **dict(zip(order[m[1]], (float(x) for x in m[2].split(",")), strict=False))}
    kind, _, rest = text.partition(":")
    if kind.startswith("increment"):
        step = re.search(r"\[(-?\d+)\]", kind)
        own = dict(p.split("=", 1) for p in rest.split(":") if "=" in p)
        return {"type": "increment", "step": int(step[1]) if step else 1, "start": int(own.get("start", 1)), "pattern": own.get("pattern", "[1]")}
    if kind == "choice":
        return {"values": [v.strip() for v in rest.split(",")]}
    if kind == "range" and (m := re.fullmatch(r"(-?[\d.]+)-(-?[\d.]+)", rest)):
        return {"distribution": "uniform", "min": float(m[1]), "max": float(m[2])}
    if kind in order:
        return {"distribution": kind, **{k: float(v) for k, v in (p.split("=") for p in rest.split(","))}}
    if kind in ("email", "phone", "uuid", *PLACEHOLDERS):
        return {"pattern": kind}
    raise LoomError(f"'{text}' is no generator")


def generator(name: str, spec: Mapping | str, row: Column, seed: int) -> Column:
    """The Column of one specification."""
    spec = shorthand(spec) if isinstance(spec, str) else dict(spec)
    u = uniform(row, seed, name)
    shape, kind, pattern = spec.get("distribution"), spec.get("type"), spec.get("pattern")
    if shape:
        if shape == "normal":
            return _clamped(spec["mean"] + spec["std"] * gaussian(row, seed, name), spec)
        if shape == "lognormal":
            return _clamped(F.exp(spec["mean"] + spec["std"] * gaussian(row, seed, name)), spec)
        if shape == "uniform":
            return spec["min"] + (spec["max"] - spec["min"]) * u
        if shape == "exponential":
            return -F.ln(u) / float(spec["lambda"])
        if shape == "poisson":
            rate = float(spec["lambda"])
            if not rate:
                return F.lit(0.0)
            return _counts(name, rate, rate, math.inf, lambda k: k * math.log(rate) - rate - math.lgamma(k + 1), u).cast("double")
        if shape == "binomial":
            n, p = int(spec["n"]), float(spec["p"])
            if p in (0.0, 1.0):
                return F.lit(int(n * p)).cast("long")
            log_mass = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
            return _counts(name, n * p, n * p * (1 - p), n, log_mass, u).cast("long")
        if shape == "beta":
            a, b = (_gamma(row, seed, name, float(spec[k]), s) for k, s in (("alpha", 3), ("beta", 4)))
            return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] / (x["a"] + x["b"])), 1)
        raise LoomError(f"no distribution '{shape}'", "There are: normal, lognormal, uniform, exponential, poisson, binomial, beta")
    if "values" in spec:
        values, weights = list(spec["values"]), spec.get("weights")
        if not weights:
            return _pick(values, u)
        if len(weights) != len(values) or min(weights) < 0 or sum(weights) <= 0:
            raise LoomError(f"'{name}': weights don't fit the values")
        return F.element_at(F.array(*map(F.lit, values)), (_by_table([w / sum(weights) for w in weights], u) + 1).cast("int"))
    if kind == "sequence":
        return F.lit(spec.get("start", 1)) + row * F.lit(spec.get("step", 1))
    if kind == "increment":
        m = re.search(r"\[(\d+)\]", pattern)
        if not m:
            raise LoomError(f"'{pattern}' has no [number]")
        number = F.lit(spec.get("start", int(m[1]))) + row * F.lit(spec.get("step", 1))
        digits = F.greatest(F.lit(len(m[1])), F.length(number.cast("string")))
        return F.concat(F.lit(pattern[: m.start()]), F.lpad(number.cast("string"), digits, F.lit("0")), F.lit(pattern[m.end() :]))
    if kind in ("date", "datetime", "time"):
        base = "1970-01-01 " if kind == "time" else ""
        low, high = (F.lit(base + spec[k]).cast("date" if kind == "date" else "timestamp_ntz") for k in ("start", "end"))
        if base + spec["start"] >= base + spec["end"]:
            raise LoomError(f"'{name}': start must be before end")
        if kind == "date":
            return F.date_add(low, F.floor(u * (F.datediff(high, low) + 1)).cast("int"))
        seconds = F.timestamp_diff("SECOND", low, high)
        moment = F.timestamp_add("SECOND", F.floor(u * (seconds + 1)).cast("int"), low)
        return moment if kind == "datetime" else F.date_format(moment, "HH:mm:ss")
    if kind == "linked_list":
        levels = [list(x) for x in spec["levels"]]
        if len({len(x) for x in levels}) != 1:
            raise LoomError(f"'{name}': levels have different lengths")
        return _pick([" ".join(map(str, x)) for x in zip(*levels, strict=True)], u)
    digits = lambda n, draw: F.lpad(F.floor(uniform(row, seed, name, draw) * 10**n).cast("string"), n, "0")
    letters = lambda n, draw, alphabet: F.concat(*[_pick(list(alphabet), uniform(row, seed, name, draw + i)) for i in range(n)])
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    if pattern == "email":
        return F.concat(letters(8, 10, low), F.lit("@" + spec.get("domain", "example.com")))
    if pattern == "phone":
        shapes = {"US": ("+1-", 3, 3, 4), "UK": ("+44-", 4, 6, 0)}
        head, *groups = shapes.get(spec.get("format", ""), ("", 3, 3, 4))
        return F.concat(F.lit(head), F.concat_ws("-", *[digits(n, 30 + i) for i, n in enumerate(groups) if n]))
    if pattern == "uuid":
        hexes = F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(row, F.lit(seed), F.lit(name), F.lit(90 + i)))), 16, "0") for i in range(2)])
        return F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.concat(F.lit("4"), F.substring(hexes, 14, 3)), F.concat(F.lit("a"), F.substring(hexes, 18, 3)), F.substring(hexes, 21, 12))
    if pattern in PLACEHOLDERS:
        words = [_pick(items, uniform(row, seed, name, 40 + i)) if isinstance(items, list) else (F.floor(uniform(row, seed, name, 40 + i) * items) + 1).cast("string") for i, items in enumerate(PLACEHOLDERS[pattern])]
        return F.concat_ws(" ", *words)
    if pattern == "regex":
        parts, draw = [], 100
        for m in re.finditer(r"\[(A-Z|a-z|0-9|A-Za-z|A-Z0-9)\](?:\{(\d+)\})?|\\d(?:\{(\d+)\})?|([^\[\\])", spec["regex"]):
            alphabet = {"A-Z": up, "a-z": low, "0-9": "0123456789", "A-Za-z": up + low, "A-Z0-9": up + "0123456789", None: "0123456789"}[m[1]]
            n = int(m[2] or m[3] or 1)
            parts.append(F.lit(m[4]) if m[4] else letters(n, draw, alphabet))
            draw += n
        return F.concat(*parts)
    raise LoomError(f"'{name}': no generator for {spec}")


def new(spark: SparkSession, n: int, strategy: Mapping[str, Mapping | str], seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n rows; strategy: column to specification."""
    if n < 0 or not strategy:
        raise LoomError("a synthetic frame needs a size and columns")
    rows = spark.range(0, n, 1, partitions or max(1, min(1000, n // 100_000)))
    return rows.select(*[generator(c, s, F.col("id"), seed).alias(c) for c, s in strategy.items()])


def augment(df: DataFrame, n: int, seed: int = 42, strategy: Mapping | None = None) -> DataFrame:
    """df and n rows like it: floats are normal with the column's mean and (at least 0.01) deviation, integers the same and
    rounded, strings those of rows drawn with replacement among all non-null ones, all else the smallest value. strategy:
    specifications that go before this.

    To draw a string, the rows are numbered in an order by hash and joined by number."""
    need_columns(df.columns, list(strategy or {}))
    floats = (T.FloatType, T.DoubleType, T.DecimalType)
    drawn = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in (strategy or {})]
    stats = [F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(drawn)]
    for i, f in enumerate(df.schema):
        x = quoted(f.name)
        if isinstance(f.dataType, T.NumericType):
            stats += [F.avg(x.cast("double")).alias(f"m{i}"), F.greatest(F.stddev_pop(x.cast("double")), F.lit(0.01)).alias(f"s{i}")]
        elif not isinstance(f.dataType, T.StringType):
            stats.append(F.min(x).alias(f"c{i}"))
    found = df.agg(*(stats or [F.lit(1).alias("one")])).first()
    rows, out = df.sparkSession.range(0, n, 1, max(1, min(1000, n // 100_000))), []
    for i, c in enumerate(drawn):
        if found[f"n{i}"]:
            values = df.where(quoted(c).isNotNull()).select(quoted(c).alias(f"v{i}"), F.xxhash64(quoted(c), F.lit(seed)).alias("__h"))
            numbers = numbered(values, ["__h", f"v{i}"], f"at{i}").drop("__h")
            at = F.floor(uniform(F.col("id"), seed, c) * found[f"n{i}"]).cast("long")
            rows = rows.withColumn(f"at{i}", at).join(numbers, f"at{i}", "left")
        else:
            rows = rows.withColumn(f"v{i}", F.lit(None).cast("string"))
    for i, f in enumerate(df.schema):
        row = F.col("id")
        if strategy and f.name in strategy:
            value = generator(f.name, strategy[f.name], row, seed)
        elif isinstance(f.dataType, T.NumericType):
            value = F.lit(found[f"m{i}"]) + F.lit(found[f"s{i}"]) * gaussian(row, seed, f.name)
            value = value if isinstance(f.dataType, floats) else F.round(value)
        elif isinstance(f.dataType, T.StringType):
            value = F.col(f"v{drawn.index(f.name)}")
        else:
            value = F.lit(found[f"c{i}"])
        out.append(value.cast(f.dataType).alias(f.name))
    return df.unionByName(rows.select(*out))
