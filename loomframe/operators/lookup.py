"""Bringing columns from reference frames by key, and merging frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.errors import CardinalityError, LoomError, need_columns
from loomframe.operators.aggregate import Mode, grouped, need_unique, parse_mode, repeated_keys
from loomframe.operators.columns import quoted
from loomframe.operators.positions import place

JOINS = {"left": "left", "inner": "inner", "outer": "full", "right": "right"}


def stacked(references: DataFrame | Sequence[DataFrame]) -> DataFrame:
    """Reference frames one below the other; they must have the same columns."""
    frames = [references] if isinstance(references, DataFrame) else list(references)
    if not frames:
        raise LoomError("no reference frame")
    for f in frames[1:]:
        if sorted(f.columns) != sorted(frames[0].columns):
            raise LoomError("reference frames have different columns")
    return reduce(DataFrame.unionByName, frames)


def lookup(target: DataFrame, reference: DataFrame | Sequence[DataFrame], bring, against, *, strategy: Mapping | None = None, join_type: str = "lookup", position=None, order_by=None) -> DataFrame:
    """target with columns of the reference.

    bring: names, or pairs (name, new name). against: one key or several, named alike on both sides; null keys never
    match. join_type 'lookup' keeps each row of the target once: a reference whose keys repeat is aggregated by key first,
    each column by its strategy ('auto' by default: one value, or an error when run). If the keys repeat on both sides, a
    strategy must be given. left, inner, outer and right are plain joins, for unique keys on both sides only; cross pairs
    every row with every row, without keys.

    With a strategy nothing runs beforehand: the reference is grouped by key in any case, and the join reuses its partitions.
    """
    ref = stacked(reference)
    keys = [against] if isinstance(against, str) else list(against)
    pairs = [(b, b) if isinstance(b, str) else tuple(b) for b in ([bring] if isinstance(bring, str) else bring)]
    need_columns(target.columns, keys, "key")
    need_columns(ref.columns, [*keys, *(s for s, _ in pairs)])
    for s in strategy or {}:
        need_columns([x for p in pairs for x in p], [s], "strategy for column")
    for _, new in pairs:
        if new in target.columns:
            raise LoomError(f"the target has a column '{new}'", "Bring it under another name: (name, new name)")
    if join_type == "cross":
        return place(target.crossJoin(ref.select(*[quoted(s).alias(d) for s, d in pairs])), [d for _, d in pairs], position)
    select = [*map(quoted, keys), *[quoted(s).alias(d) for s, d in pairs]]
    if join_type in JOINS:
        why = "Use join_type='lookup' with a strategy"
        need_unique(ref, keys, "reference", why)
        need_unique(target, keys, "target", why)
        return place(target.join(ref.select(*select), keys, JOINS[join_type]), [d for _, d in pairs], position)
    if join_type != "lookup":
        raise LoomError(f"no join '{join_type}'", f"There are: lookup, cross, {', '.join(JOINS)}")
    if not strategy and repeated_keys(ref, keys).isEmpty():
        found = ref.select(*select)
    else:
        if not strategy and not repeated_keys(target, keys).isEmpty():
            raise CardinalityError("keys repeat in the target and the reference (many:many)", "Give a strategy for each column")
        given = {k: parse_mode(v) for k, v in (strategy or {}).items()}
        found = grouped(ref, keys, {d: (s, given.get(s) or given.get(d) or Mode("auto")) for s, d in pairs}, order_by, count_nulls=True)
    return place(target.join(found, keys, "left"), [d for _, d in pairs], position)


def lookup_all(targets: Sequence[DataFrame], *args, **kwargs) -> list[DataFrame]:
    return [lookup(t, *args, **kwargs) for t in targets]


def key_report(target: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows and different keys both sides have, how many keys repeat, what cardinality follows, and how
    many keys of either side the other lacks."""
    keys = [keys] if isinstance(keys, str) else list(keys)

    def side(df: DataFrame, name: str) -> DataFrame:
        per = df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("n"))
        return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_rows"), F.count(F.lit(1)).alias(f"{name}_keys"), F.count_if(F.col("n") > 1).alias(f"{name}_repeated"))

    def missing(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        return a.select(*map(quoted, keys)).distinct().join(b.select(*map(quoted, keys)), keys, "left_anti").agg(F.count(F.lit(1)).alias(name))

    one = [side(target, "target"), side(reference, "reference"), missing(target, reference, "missing_in_reference"), missing(reference, target, "missing_in_target")]
    joined = reduce(DataFrame.crossJoin, one)  # one row each
    many = lambda s: F.when(F.col(f"{s}_repeated") > 0, "many").otherwise("1")
    return joined.withColumn("cardinality", F.concat(many("target"), F.lit(":"), many("reference")))


def matched(df: DataFrame, other: DataFrame, keys: Sequence[str], present: bool = True) -> DataFrame:
    """Rows whose key the other frame has (semi-join), or lacks (anti-join)."""
    return df.join(other.select(*map(quoted, keys)), list(keys), "left_semi" if present else "left_anti")


def merge(frames: Sequence[DataFrame], how: str = "vertical", by: str | Sequence[str] | None = None) -> DataFrame:
    """vertical (v): rows of frames with the same columns; diagonal (d): with NULL for columns a frame lacks; horizontal
    (h): columns side by side, left-joined by key to the first frame."""
    frames = list(frames)
    if len(frames) < 2:
        raise LoomError("merging needs two frames or more")
    how = {"v": "vertical", "h": "horizontal", "d": "diagonal"}.get(how, how)
    if how == "vertical":
        return stacked(frames)
    if how == "diagonal":
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if how != "horizontal":
        raise LoomError(f"no way of merging '{how}'", "There are: vertical, horizontal, diagonal")
    if not by:
        raise LoomError("merging side by side needs a key", "by='...'")
    keys = [by] if isinstance(by, str) else list(by)
    for f in frames:
        need_columns(f.columns, keys, "key")
    for f in frames[1:]:
        need_unique(f, keys, "frame", "Aggregate it first")
    return reduce(lambda a, b: a.join(b.select(*map(quoted, keys), *[quoted(c) for c in b.columns if c not in a.columns]), keys, "left"), frames)
