"""Comparison of two snapshots, by row and by cell, with column aliases and value hierarchies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.errors import LoomError, need_columns
from loomframe.functions.registry import Reconciliation
from loomframe.operators.aggregate import repeated_keys
from loomframe.operators.columns import quoted

STATUSES = ("new", "deleted", "changed", "no_change", "duplicate")
ARROW, HIERARCHY = " → ", " (hierarchy)"


@dataclass(frozen=True)
class Options:
    """output: summary or detail. exclude: columns left out of comparison and result; carry: shown, not compared; context:
    columns of the new side beside each change of the detail. aliases: column to its other names; groups: parent value to
    its parts; values: column to a table of values and their other spellings, which count as the same. ordered: the summary
    in order of status."""

    output: str = "summary"
    exclude: tuple = ()
    carry: tuple = ()
    context: tuple = ()
    aliases: Mapping = field(default_factory=dict)
    groups: Mapping = field(default_factory=dict)
    values: Mapping = field(default_factory=dict)
    ordered: bool = False

    @staticmethod
    def of(strategy: Mapping | None, rules: Reconciliation | None = None) -> Options:
        given = dict(strategy or {})
        names = {"output", "exclude", "carry", "context", "aliases", "groups", "values", "ordered"}
        need_columns(sorted(names), list(given), "option")
        listed = lambda v: (v,) if isinstance(v, str) else tuple(v or ())
        out = Options(
            given.get("output", "summary"), listed(given.get("exclude")), listed(given.get("carry")), listed(given.get("context")),
            given.get("aliases") or (rules.aliases if rules else {}), given.get("groups") or (rules.groups if rules else {}), given.get("values") or {}, bool(given.get("ordered")),
        )
        if out.output not in ("summary", "detail"):
            raise LoomError(f"no output '{out.output}'", "There are: summary, detail")
        both = set(out.exclude) & set(out.carry)
        if both:
            raise LoomError(f"'{sorted(both)[0]}' is both excluded and carried")
        if isinstance(out.groups, str) or isinstance(out.aliases, str):
            raise LoomError("aliases and groups are tables", "Name a reconciliation instead")
        return out


def renamed(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Other names of columns, in any case, replaced by the canonical ones."""
    canonical = {v.lower(): name for name, others in aliases.items() for v in (name, *others)}
    return df.withColumnsRenamed({c: canonical[c.lower()] for c in df.columns if c.lower() in canonical and canonical[c.lower()] not in df.columns})


def respelled(df: DataFrame, values: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """Other spellings of values, in any case, replaced by the canonical one."""
    for c, table in values.items():
        need_columns(df.columns, [c])
        known = F.create_map(*[F.lit(x) for name, others in table.items() for other in dict.fromkeys(o.lower() for o in (name, *others)) for x in (other, name)])
        df = df.withColumn(c, F.coalesce(F.try_element_at(known, F.lower(quoted(c).cast("string"))), quoted(c).cast("string")))
    return df


def find_key(old: DataFrame, new: DataFrame) -> list[str]:
    """The first common column that is unique on both sides, else the first such pair. Sketches of how many values columns
    and pairs have, in one aggregation per side, leave out what can't be; what is left is tried in turn."""
    common = [c for c in old.columns if c in new.columns]

    def unique(df: DataFrame, key: tuple[str, ...]) -> bool:
        has_null = reduce(Column.__or__, [quoted(c).isNull() for c in key])
        return df.where(has_null).isEmpty() and repeated_keys(df, key).isEmpty()

    def possible(df: DataFrame, keys: list[tuple[str, ...]]) -> list[bool]:
        n = F.count(F.lit(1))
        values = [F.approx_count_distinct(F.xxhash64(*map(quoted, k))) for k in keys]
        return list(df.agg(*[(v >= 0.75 * n).alias(f"u{i}") for i, v in enumerate(values)]).first()) if keys else []

    for keys in ([(c,) for c in common], list(combinations(common, 2))):
        for key, a, b in zip(keys, possible(old, keys), possible(new, keys), strict=True):
            if a and b and unique(old, key) and unique(new, key):
                return list(key)
    raise LoomError("no column, and no pair of columns, is unique on both sides", "Name a key")


def parse_key(key: str | Sequence[str] | None) -> list[str] | None:
    if key is None:
        return None
    out = [k.strip() for k in key.split(",")] if isinstance(key, str) else list(key)
    if not all(out):
        raise LoomError("an empty key")
    return out


def _set_apart(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Different rows whose key no other different row has, and all rows of the keys that several have: one grouping by key,
    where the least and the greatest row of a key are the same or not. Null keys are no keys: their different rows stand
    apart."""
    rest = [c for c in df.columns if c not in keys]
    null = reduce(Column.__or__, [quoted(k).isNull() for k in keys])
    row = F.struct(*map(quoted, rest)) if rest else F.lit(0)
    by = df.where(~null).groupBy(*map(quoted, keys)).agg(F.min(row).alias("__least"), F.max(row).alias("__most"))
    single = F.col("__least").eqNullSafe(F.col("__most"))
    alone = by.where(single).select(*map(quoted, keys), *[F.col("__least")[c].alias(c) for c in rest]).select(*map(quoted, df.columns))
    return alone.unionByName(df.where(null).distinct()), df.join(by.where(~single).select(*map(quoted, keys)), keys, "left_semi")


def _kin(a: Column, b: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Whether one value is the parent of the other."""
    if not groups:
        return F.lit(False)
    parts = F.create_map(*[x for parent, own in groups.items() for x in (F.lit(parent.lower()), F.array(*[F.lit(p.lower()) for p in own]))])
    x, y = F.lower(a.cast("string")), F.lower(b.cast("string"))
    holds = lambda p, c: F.coalesce(F.array_contains(F.try_element_at(parts, p), c), F.lit(False))
    return holds(x, y) | holds(y, x)


def diff(old: DataFrame, new: DataFrame, key: str | Sequence[str] | None = None, strategy: Mapping | None = None, rules: Reconciliation | None = None) -> DataFrame:
    """Summary: all columns as strings and _diff_status (new, deleted, changed, no_change, duplicate); changed cells read
    'old → new', with ' (hierarchy)' if one value is the other's parent; other cells of a changed row are the new ones.
    Detail: _key, _column, _old_value, _new_value and context for each changed cell.

    Equal rows collapse; all rows of a key that different rows share are 'duplicate', and leave the comparison on their
    side. Two nulls are equal. Null keys never match. Columns of one side only are shown, not compared. One grouping by key
    finds what repeats, and the comparison joins its results.
    """
    options = Options.of(strategy, rules)
    old, new = (respelled(renamed(df, options.aliases), options.values) for df in (old, new))
    old, new = old.drop(*options.exclude), new.drop(*options.exclude)
    keys = parse_key(key) or find_key(old, new)
    need_columns(old.columns, keys, "key")
    need_columns(new.columns, keys, "key")
    columns = [*old.columns, *[c for c in new.columns if c not in old.columns]]
    compared = [c for c in old.columns if c in new.columns and c not in keys and c not in options.carry]
    (a, bad_a), (b, bad_b) = _set_apart(old, keys), _set_apart(new, keys)
    a = a.select(*[quoted(k).alias(f"a_{k}") for k in a.columns], F.lit(True).alias("in_a"))
    b = b.select(*[quoted(k).alias(f"b_{k}") for k in b.columns], F.lit(True).alias("in_b"))
    on = F.lit(True)
    for k in keys:
        on = on & (quoted(f"a_{k}") == quoted(f"b_{k}"))
    both = a.join(b, on, "full")
    differs = {c: ~quoted(f"a_{c}").eqNullSafe(quoted(f"b_{c}")) for c in compared}
    any_change = F.lit(False)
    for d in differs.values():
        any_change = any_change | d
    status = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "deleted").when(any_change, "changed").otherwise("no_change")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    mark = lambda c: F.when(_kin(quoted(f"a_{c}"), quoted(f"b_{c}"), options.groups), F.lit(HIERARCHY)).otherwise(F.lit(""))
    if options.output == "detail":
        need_columns(new.columns, list(options.context), "context column")
        cells = [
            F.struct(differs[c].alias("d"), F.lit(c).alias("_column"), quoted(f"a_{c}").cast("string").alias("_old_value"), F.concat(quoted(f"b_{c}").cast("string"), mark(c)).alias("_new_value"))
            for c in compared
        ]
        text = F.concat_ws(",", *[quoted(f"a_{k}").cast("string") for k in keys])
        cells = F.array(*cells) if cells else F.array().cast("array<struct<d:boolean,_column:string,_old_value:string,_new_value:string>>")
        rows = both.where(F.col("in_a") & F.col("in_b")).select(text.alias("_key"), F.inline(cells), *[quoted(f"b_{c}").alias(c) for c in options.context])
        return rows.where("d").drop("d")

    def cell(c: str) -> Column:
        if c in keys:
            return F.coalesce(quoted(f"b_{c}"), quoted(f"a_{c}")).cast("string")
        if c not in new.columns:
            return quoted(f"a_{c}").cast("string")
        if c not in old.columns:
            return quoted(f"b_{c}").cast("string")
        one = F.when(F.col("in_b"), quoted(f"b_{c}").cast("string")).otherwise(quoted(f"a_{c}").cast("string"))
        if c not in differs:
            return one
        return F.when(F.col("in_a") & F.col("in_b") & differs[c], F.concat(shown(quoted(f"a_{c}")), F.lit(ARROW), shown(quoted(f"b_{c}")), mark(c))).otherwise(one)

    out = both.select(*[cell(c).alias(c) for c in columns], status.alias("_diff_status"))
    for bad in (bad_a, bad_b):
        own = bad.select(*[quoted(c).cast("string").alias(c) if c in bad.columns else F.lit(None).cast("string").alias(c) for c in columns], F.lit("duplicate").alias("_diff_status"))
        out = out.unionByName(own)
    return out


def ordered(result: DataFrame) -> DataFrame:
    """A summary in the order new, deleted, changed, no_change, duplicate."""
    return result.orderBy(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("_diff_status")))
