"""Filling gaps: totals, neighbours in order, nearest neighbours, and similar texts.

Every method adds a column ({c}_infer, or {c}_infer_01 and so on where that is taken) and leaves the original as it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import pairwise
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import LoomError, need_columns
from loomframe.operators.columns import numeric, quoted

METHODS = ("auto", "mean", "median", "mode", "forward", "backward", "interpolate", "knn", "tfidf")
_OTHER_NAMES = {"ffill": "forward", "forward_fill": "forward", "bfill": "backward", "backward_fill": "backward"}


def new_name(df: DataFrame, column: str) -> str:
    names = [f"{column}_infer", *(f"{column}_infer_{i:02d}" for i in range(1, 100))]
    return next(n for n in names if n not in df.columns)


def deduce(df: DataFrame, columns: str | Sequence[str], method: str = "auto", order_by: str | None = None, within: Sequence[str] = (), name: str | None = None, against: Sequence[str] | None = None, **options) -> DataFrame:
    """method: auto (numbers: mean, strings: mode, others: forward), mean, median, mode, forward (ffill, forward_fill),
    backward (bfill, backward_fill), interpolate, knn, tfidf. order_by: what forward, backward and interpolate go along,
    inside groups `within` if given. against: the texts for tfidf, or the features for knn."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    need_columns(df.columns, [*columns, *within])
    method = _OTHER_NAMES.get(method, method)
    need_columns(list(METHODS), [method], "method")
    if name and len(columns) > 1:
        raise LoomError("a name is for one column")
    for c in columns:
        kind = df.schema[c].dataType
        own = method
        if method == "auto":
            own = "mean" if isinstance(kind, T.NumericType) else "mode" if isinstance(kind, T.StringType) else "forward"
        out = name or new_name(df, c)
        if own in ("mean", "median", "mode"):
            df = fill_total(df, c, own, out)
        elif own in ("forward", "backward", "interpolate"):
            df = fill_along(df, c, own, order_by, within, out)
        elif own == "knn":
            df = knn(df, [c], features=against, names={c: out}, order_by=order_by, **options)
        else:
            df = tfidf(df, c, against or [x for x in df.columns if x != c and isinstance(df.schema[x].dataType, T.StringType)], out, order_by=order_by, **options)
    return df


def fill_total(df: DataFrame, column: str, how: str, name: str) -> DataFrame:
    """NULL replaced by the mean, median or mode (smallest on ties) of the column; one row is joined to all."""
    if how != "mode":
        numeric(df, [column])
    x = quoted(column)
    if how == "mode":
        counts = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("__total"))
    else:
        total = df.agg((F.avg(x) if how == "mean" else F.median(x)).alias("__total"))
    joined = df.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn(name, F.coalesce(x, F.col("__total"))).drop("__total")


#: Rows of one range, and ranges at most.
RANGE_ROWS, MOST_RANGES = 500_000, 20_000
_CUT_BY_QUANTILES = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _zone(x: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most x."""
    if len(bounds) <= 32:
        return sum(((x >= F.lit(b)).cast("int") for b in bounds), F.lit(0))
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    own = F.array(*map(F.lit, bounds))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(own, at + step - 1) <= x, at + step).otherwise(at))


def zoned(df: DataFrame, order: str, rows: int | None = None) -> DataFrame:
    """df with __zone: rows dealt to ranges of a key by approximate quantiles, of a sample where the key is no number, date
    or timestamp; nulls before all. There are as many ranges as the number of rows asks for, which takes a job or two; small
    frames are one range."""
    x, n = quoted(order), df.count()
    ranges, bounds = min(MOST_RANGES, -(-n // (rows or RANGE_ROWS))), []
    if ranges > 1 and isinstance(df.schema[order].dataType, _CUT_BY_QUANTILES):
        shares = [i / ranges for i in range(1, ranges)]
        bounds = df.agg(F.percentile_approx(x, F.array(*map(F.lit, shares)), F.lit(max(1000, 10 * ranges)))).first()[0] or []
    elif ranges > 1:
        some = df.select(x.alias("x")).where(x.isNotNull()).sample(min(1.0, 40 * ranges / n), 1).limit(80 * ranges)
        found = sorted(r.x for r in some.collect())
        bounds = [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []
    return df.withColumn("__zone", F.coalesce(_zone(x, sorted(set(bounds))), F.lit(-1)))


def numbered(df: DataFrame, order: str | Sequence[str], name: str, rows: int | None = None) -> DataFrame:
    """Row numbers from 0 in an order, ranked range by range of the first key; only the sizes of ranges are summed in one
    place."""
    keys = [order] if isinstance(order, str) else list(order)
    dealt = zoned(df, keys[0], rows)
    sizes = dealt.groupBy("__zone").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__zone").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__zone", before.alias("__before")))  # one row per range
    inside = F.row_number().over(Window.partitionBy("__zone").orderBy(*[quoted(k).asc_nulls_first() for k in keys])) - 1
    return dealt.withColumn("__i", inside).join(offsets, "__zone").withColumn(name, (F.col("__before") + F.col("__i")).cast("long")).drop("__zone", "__i", "__before")


def _beside(df: DataFrame, column: str, order: str, within: Sequence[str], sides: Mapping[str, bool], rows: int | None) -> DataFrame:
    """df with struct columns: order key and value of the last non-null value up to a row (True), or of the next one from it
    on (False). Both are running windows, the second along the falling key.

    Without groups, rows are dealt to ranges of the key, once; what comes in from other ranges is at most one value for each
    of them, so that no task has to see all rows."""
    here = F.when(quoted(column).isNotNull(), F.struct(quoted(order).alias("at"), quoted(column).alias("value")))
    dealt = df if within else zoned(df, order, rows)
    parts = Window.partitionBy(*map(quoted, within)) if within else Window.partitionBy("__zone")
    upto = (Window.unboundedPreceding, Window.currentRow)
    near = {name: F.last(here, True).over(parts.orderBy(quoted(order).asc() if up else quoted(order).desc()).rowsBetween(*upto)) for name, up in sides.items()}
    if within:
        return dealt.withColumns(near)
    at = F.when(quoted(column).isNotNull(), quoted(order))
    ends = dealt.groupBy("__zone").agg(*[(F.max_by if up else F.min_by)(here, at).alias(f"__end_{name}") for name, up in sides.items()])
    # one row per range
    across = lambda up: Window.orderBy(F.col("__zone").asc() if up else F.col("__zone").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__zone", *[F.last(f"__end_{name}", True).over(across(up)).alias(f"__carried_{name}") for name, up in sides.items()])
    joined = dealt.withColumns(near).join(F.broadcast(carried), "__zone")
    return joined.withColumns({name: F.coalesce(F.col(name), F.col(f"__carried_{name}")) for name in sides}).drop("__zone", *[f"__carried_{name}" for name in sides])


def fill_along(df: DataFrame, column: str, how: str, order_by: str | None, within: Sequence[str], name: str, rows: int | None = None) -> DataFrame:
    """forward: last non-null value before; backward: next one; interpolate: linear between both, along the order key,
    NULL before the first and behind the last."""
    if not order_by:
        raise LoomError(f"'{how}' needs an order", "order_by='...'")
    need_columns(df.columns, [order_by])
    if how in ("forward", "backward"):
        return _beside(df, column, order_by, within, {"__near": how == "forward"}, rows).withColumn(name, F.col("__near.value")).drop("__near")
    numeric(df, [column])
    if not isinstance(df.schema[order_by].dataType, _CUT_BY_QUANTILES):
        raise LoomError(f"there is nothing between two values of '{order_by}'", "Order by a number, date or timestamp")
    both = _beside(df, column, order_by, within, {"__before": True, "__after": False}, rows)
    kind = df.schema[order_by].dataType
    if isinstance(kind, T.DateType):
        at = lambda c: F.unix_date(c).cast("double")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        at = lambda c: F.unix_micros(c.cast("timestamp")).cast("double")
    else:
        at = lambda c: c.cast("double")
    a, b = at(F.col("__before.at")), at(F.col("__after.at"))
    low, high = F.col("__before.value").cast("double"), F.col("__after.value").cast("double")
    blend = low + (high - low) * F.try_divide(at(quoted(order_by)) - a, b - a)
    return both.withColumn(name, F.when(quoted(column).isNotNull(), quoted(column).cast("double")).otherwise(blend)).drop("__before", "__after")


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Between all rows of a and of b, over the dimensions that both have; 0 if there is none."""
    seen_a, seen_b = ~np.isnan(a), ~np.isnan(b)
    x, y = np.where(seen_a, a, 0.0), np.where(seen_b, b, 0.0)
    if metric == "manhattan":
        return np.stack([(np.abs(row - y) * (own & seen_b)).sum(axis=1) for row, own in zip(x, seen_a, strict=True)]) if len(x) else np.zeros((0, len(y)))
    va, vb = seen_a.astype(float), seen_b.astype(float)
    xx, yy, xy = (x * x) @ vb.T, va @ (y * y).T, x @ y.T
    if metric == "euclidean":
        exact = np.stack([np.sqrt((((row - y) * (own & seen_b)) ** 2).sum(axis=1)) for row, own in zip(x, seen_a, strict=True)]) if len(x) else np.zeros((0, len(y)))
        return exact
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = 1.0 - xy / np.sqrt(xx * yy)
    return np.where(va @ vb.T == 0, 0.0, np.where((xx == 0) | (yy == 0), 1.0, cosine))


def _cells(asked: DataFrame, n_asked: int, rows: DataFrame, n_rows: int, block: int, run, schema: str) -> DataFrame:
    """Every row of one frame against every row of another, block by block: run(blocks of both) in a task for each pair of
    blocks. Both frames have a column id."""
    p, q = max(1, -(-n_asked // block)), max(1, -(-n_rows // (10 * block)))
    p = max(1, -(-p // min(5, max(1, p * q // 200))))  # with many pairs of blocks, larger ones, as each row goes to all of the other side
    deal = lambda df, own, n, other, m: df.withColumns({own: F.pmod(F.xxhash64("id"), F.lit(n)), other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))})
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # else columns that both have may be pruned on this side
    a, b = deal(asked, "p", p, "q", q), deal(rows, "q", q, "p", p)
    return a.groupBy("p", "q").cogroup(b.groupBy("p", "q")).applyInPandas(run, schema)


#: Distances that a task of knn holds at once.
_CELLS = 500_000


def _smallest(d: np.ndarray, m: int) -> np.ndarray:
    """Places of the m smallest of each row (or all, where there are fewer), in order; of equal ones the first."""
    if d.shape[1] <= m:
        return np.argsort(d, axis=1, kind="stable")
    kth = np.partition(d, m - 1, axis=1)[:, m - 1 : m]
    less, equal = d < kth, d == kth
    kept = less | equal & (np.cumsum(equal, axis=1) <= m - less.sum(axis=1, keepdims=True))
    at = np.nonzero(kept)[1].reshape(-1, m)
    return np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, axis=1), axis=1, kind="stable"), axis=1)


def _nearest(metric: str, m: int, shape: list[str], part: int = 2000):
    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or rows.empty:  # such frames have no columns
            return pd.DataFrame({c: [] for c in [*shape, "d", "r", "v"]}, dtype=float)
        rows = rows.sort_values("id")
        own, all_, out = asked[shape].to_numpy(dtype=float), rows[shape].to_numpy(dtype=float), []
        step = max(1, _CELLS // (min(part, len(rows)) + m))
        for first in range(0, len(asked), step):
            a = own[first : first + step]
            d, at = np.zeros((len(a), 0)), np.zeros((len(a), 0), dtype=np.int64)
            for start in range(0, len(rows), part):  # by rising id, so that places settle ties
                new = _distances(a, all_[start : start + part], metric)
                new[~np.isfinite(new)] = np.inf
                d = np.concatenate([d, new], axis=1)
                at = np.concatenate([at, np.broadcast_to(np.arange(start, start + new.shape[1]), new.shape)], axis=1)
                best = _smallest(d, m)
                d, at = np.take_along_axis(d, best, axis=1), np.take_along_axis(at, best, axis=1)
            i, j = np.nonzero(np.isfinite(d))
            taken = rows.iloc[at[i, j]]
            out.append(pd.DataFrame({**dict(zip(shape, a[i].T, strict=True)), "d": d[i, j], "r": taken["id"].to_numpy(), "v": taken["v"].to_numpy()}, dtype=float))
        return pd.concat(out)

    return run


def knn(df: DataFrame, columns: Sequence[str], k: int = 5, weights: str = "uniform", metric: str = "euclidean", features: Sequence[str] | str | None = None, names=None, order_by: str | None = None, block: int = 5000) -> DataFrame:
    """NULL replaced by the mean of the k nearest rows, by features (default: all other numeric columns; 'self': the
    imputed columns alone). Neighbours are ordered by distance, then by order_by, and counted before those without a
    value drop out; if none has one, the result stays NULL. weights: uniform, or distance (1 / (d + 1e-10)).

    Rows with the same features are at the same distance from any other, so each different vector of a gap is asked for once,
    and of rows with the same features the first k + 1 take part. Both meet block by block, in tasks of bounded size; each
    keeps the nearest of its block, and the best of those are merged. The work is the product of different vectors."""
    columns = list(columns)
    numeric(df, columns)
    if weights not in ("uniform", "distance") or metric not in ("euclidean", "manhattan", "cosine"):
        raise LoomError(f"no such weights or metric: {weights}, {metric}")
    if not order_by:
        raise LoomError("knn needs an order for ties, which also identifies rows", "order_by='...'")
    numeric(df, [order_by])
    if features == "self":
        features = columns
    features = list(features) if features else [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in columns and f.name != order_by]
    need_columns(df.columns, features)
    state = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(quoted(c)).alias(f"seen{i}") for i, c in enumerate(columns)]).first()
    for i, c in enumerate(columns):
        if not state[f"seen{i}"]:
            raise LoomError(f"column '{c}' has no value at all")
        if not 0 < k < state.n:
            raise LoomError(f"k must be between 1 and {state.n - 1}")
    # without features all rows are at distance 0
    own = {f"f{i}": F.nanvl(quoted(x).cast("double"), F.lit(None)) for i, x in enumerate(features)} or {"f0": F.lit(None).cast("double")}
    shape, at = list(own), quoted(order_by).cast("double")
    base = df.select(at.alias("id"), *[x.alias(f) for f, x in own.items()], *[quoted(x).cast("double").alias(f"v{i}") for i, x in enumerate(columns)])
    first = Window.partitionBy(*shape).orderBy(F.col("id").asc_nulls_last())
    for i, c in enumerate(columns):
        out, missing = (names or {}).get(c) or new_name(df, c), state.n - state[f"seen{i}"]
        if not missing:
            df = df.withColumn(out, quoted(c).cast("double"))
            continue
        gaps = base.where(F.col(f"v{i}").isNull()).select(*shape).distinct().withColumn("id", F.xxhash64(*shape))
        rows = base.select("id", *shape, F.col(f"v{i}").alias("v")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).drop("nth")
        n_gaps, n_rows = (gaps.count(), rows.count()) if missing > block or state.n > 10 * block else (missing, state.n)
        near = _cells(gaps, n_gaps, rows, n_rows, block, _nearest(metric, k + 1, shape), ", ".join(f"{x} double" for x in [*shape, "d", "r", "v"]))
        best = near.groupBy(*[F.col(f).alias(f"__{f}") for f in shape]).agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "r", "v"))), 1, k + 1).alias("__near"))
        same = reduce(and_, [x.eqNullSafe(F.col(f"__{f}")) for f, x in own.items()], quoted(c).isNull())
        others = F.slice(F.filter("__near", lambda x: ~x["r"].eqNullSafe(at)), 1, k)
        used = F.filter(others, lambda x: x["v"].isNotNull() & ~F.isnan(x["v"]))
        w = (lambda x: F.lit(1.0)) if weights == "uniform" else (lambda x: 1.0 / (x["d"] + 1e-10))
        total = lambda of: F.aggregate(used, F.lit(0.0), lambda sum_, x: sum_ + of(x))
        value = F.when(F.size(used) > 0, total(lambda x, w=w: w(x) * x["v"]) / total(w))
        df = df.join(best, same, "left").withColumn(out, F.coalesce(quoted(c).cast("double"), value)).drop("__near", *[f"__{f}" for f in shape])
    return df


# Words that don't count.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with this but they have had what when where who "
    "which why how all each every both few more most other some such no nor not only own same so than too very can just should now"
).split()
_STOPS, _BETWEEN = frozenset(STOP_WORDS), re.compile(r"[\t-\r !-/:-@\[-`{-~]+")


def terms(text: str) -> list[str]:
    """Words and pairs of neighbouring words of a lower-cased text, without stop words."""
    words = [w for w in _BETWEEN.split(text) if w and w not in _STOPS]
    return words + [f"{a} {b}" for a, b in pairwise(words)]


def _texts_with(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Terms and the numbers of texts that have them, summed as far as memory allows."""
    counts: Counter[str] = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            counts.update(set(terms(text)))
            if len(counts) > most:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["t", "n"])
                counts.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["t", "n"])


def tfidf(df: DataFrame, column: str, texts: Sequence[str], name: str, order_by: str | None = None, vocabulary: int = 1000, block: int = 2000) -> DataFrame:
    """NULL labels replaced by that of the labelled row with the most similar text: cosine of term frequency x ln(N / df)
    over the `vocabulary` most frequent terms (ties: the smaller term), fitted on labelled rows. Ties between rows go to
    the last in order_by; a text without any term has similarity 0 with all. At least three labels are needed.

    Rows without a label meet labelled ones block by block, in tasks of bounded size, of those with equal vectors the last;
    what the driver keeps is the terms. The work is the number of rows without a label x different labelled vectors."""
    need_columns(df.columns, [column, *texts])
    if not isinstance(df.schema[column].dataType, T.StringType):
        raise LoomError(f"label column '{column}' must be a string")
    if not order_by:
        raise LoomError("tfidf needs an order for ties, which also identifies rows", "order_by='...'")
    joined = F.concat_ws(" ", *[quoted(t).cast("string") for t in texts])
    rows = df.select(quoted(order_by).cast("double").alias("id"), quoted(column).alias("label"), F.lower(joined).alias("text"))
    labelled = rows.where("label IS NOT NULL")
    n = labelled.count()
    if n < 3:
        raise LoomError(f"tfidf needs 3 labelled rows, there are {n}")
    seen = labelled.select("text").mapInArrow(_texts_with, "t string, n long").groupBy("t").agg(F.sum("n").alias("df"))
    top = [(r.t, r.df) for r in seen.orderBy(F.desc("df"), "t").limit(vocabulary).collect()]
    words = df.sparkSession.sparkContext.broadcast(({t: i for i, (t, _) in enumerate(top)}, np.log(n / np.array([d for _, d in top], dtype=float)) if top else np.zeros(0)))

    def weighed(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts to the numbers and unit weights of their known terms."""
        place, idf = words.value
        for b in pieces:
            numbers, weights = [], []
            for own in map(terms, b.column(b.num_columns - 1).to_pylist()):
                at, times = np.unique(np.array([place[t] for t in own if t in place], dtype=np.int64), return_counts=True)
                w = times * idf[at] / max(1, len(own))
                size = np.linalg.norm(w)
                numbers.append(at.tolist() if size else [])
                weights.append((w / size).tolist() if size else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(numbers, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))], [*b.schema.names[:-1], "terms", "weights"])

    def matrix(rows: pd.DataFrame, kind=np.float64) -> np.ndarray:
        out, lengths = np.zeros((len(rows), len(top)), dtype=kind), rows["terms"].map(len).to_numpy(dtype=np.int64)
        if lengths.sum():
            out[np.repeat(np.arange(len(rows)), lengths), np.concatenate(rows["terms"].tolist()).astype(np.int64)] = np.concatenate(rows["weights"].tolist())
        return out

    def nearest(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Products in single precision tell which rows may be the nearest; those are compared in double precision."""
        if asked.empty or known.empty:  # such frames have no columns
            return pd.DataFrame({"__id": [], "s": [], "r": [], "guess": []})
        known = known.sort_values("id")
        x, ids, labels, out = matrix(known, np.float32), known["id"].to_numpy(), known["label"].to_numpy(), []
        error = np.float32((len(top) + 8) * 2.0**-23)  # twice what rounding can make, as vectors have length 1
        for start in range(0, len(asked), 250):
            own = asked.iloc[start : start + 250]
            rough = matrix(own, np.float32) @ x.T
            most = rough.max(axis=1, keepdims=True)
            s, at = np.zeros(len(own)), np.full(len(own), len(known) - 1)  # all at 0: the last
            i, j = np.nonzero((rough >= most - error) & (most > 0))
            exact = np.zeros(len(i))
            for first in range(0, len(i), 1000):
                part = slice(first, first + 1000)
                exact[part] = np.round((matrix(own.iloc[i[part]]) * matrix(known.iloc[j[part]])).sum(axis=1), 12)
            order = np.lexsort((j, exact, i))
            ends = order[np.flatnonzero(np.diff(i[order], append=-1))]
            s[i[ends]], at[i[ends]] = exact[ends], j[ends]
            out.append(pd.DataFrame({"__id": own["id"].to_numpy(), "s": s, "r": ids[at], "guess": labels[at]}))
        return pd.concat(out)

    vectors = rows.mapInArrow(weighed, "id double, label string, terms array<int>, weights array<double>")
    missing = rows.where("label IS NULL").count()
    known = vectors.where("label IS NOT NULL").groupBy("terms", "weights").agg(F.max_by("label", "id").alias("label"), F.max("id").alias("id"))
    best = _cells(vectors.where("label IS NULL").drop("label"), missing, known, n, block, nearest, "__id double, s double, r double, guess string")
    guesses = best.groupBy("__id").agg(F.max_by("guess", F.struct("s", "r")).alias("__guess"))
    return df.join(guesses, quoted(order_by).cast("double") == F.col("__id"), "left").withColumn(name, F.coalesce(quoted(column), F.col("__guess"))).drop("__id", "__guess")
