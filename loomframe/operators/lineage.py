"""Opt-in lineage: what was done to a frame, where columns come from, and which input rows a row stands for.

The record is a plain object beside the lazy plan. Rows carry their numbers in the column `_row_id`; behind an aggregation
they carry the group's values in `_group`, and a table of groups and row numbers stands beside, so that tracing a row is a
filter or a join, however many rows a group has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.errors import LoomError, need_columns
from loomframe.functions.formulas import identifiers
from loomframe.operators import aggregate as agg
from loomframe.operators import columns as cols
from loomframe.operators import impute
from loomframe.operators.lookup import lookup

ROW_ID, GROUP = "_row_id", "_group"


@dataclass(frozen=True)
class Source:
    """kind: original, brought, calculated, aggregated."""

    kind: str
    depends_on: tuple = ()
    detail: str = ""


@dataclass(frozen=True)
class Operation:
    kind: str
    parameters: Mapping
    added: tuple
    rows_before: DataFrame
    rows_after: DataFrame


@dataclass(frozen=True)
class Traced:
    """A frame with its lineage. start() begins one; every method returns a new Traced."""

    df: DataFrame
    sources: Mapping[str, Source] = field(default_factory=dict)
    operations: tuple = ()
    origin: DataFrame | None = None
    #: Behind an aggregation: _group and _row_id.
    members: DataFrame | None = None

    @staticmethod
    def start(df: DataFrame, order_by: str | Sequence[str] | None = None) -> Traced:
        """Rows are numbered from 0 in an order, range by range of its first key, or else get numbers that are unique but
        not consecutive."""
        numbered = impute.numbered(df, order_by, ROW_ID) if order_by else df.withColumn(ROW_ID, F.monotonically_increasing_id())
        return Traced(numbered, {c: Source("original") for c in df.columns}, (), numbered)

    @property
    def plain(self) -> DataFrame:
        return self.df.drop(ROW_ID, GROUP)

    def _then(self, kind: str, df: DataFrame, sources: Mapping[str, Source], **parameters) -> Traced:
        added = tuple(c for c in df.columns if c not in self.df.columns and c not in (ROW_ID, GROUP))
        kept = {c: s for c, s in self.sources.items() if c in df.columns}
        return replace(self, df=df, sources={**kept, **sources}, operations=(*self.operations, Operation(kind, parameters, added, self.df, df)))

    def calc(self, formulas: Mapping[str, str]) -> Traced:
        return self._then("calc", cols.calc(self.df, formulas), {n: Source("calculated", tuple(identifiers(t)), t) for n, t in formulas.items()}, formulas=dict(formulas))

    def filter(self, where: str) -> Traced:
        return self._then("filter", cols.filter_rows(self.df, where), {}, where=where)

    def to(self, reference: DataFrame, bring, against, **options) -> Traced:
        keys = [against] if isinstance(against, str) else list(against)
        pairs = [(b, b) if isinstance(b, str) else tuple(b) for b in ([bring] if isinstance(bring, str) else bring)]
        return self._then("to", lookup(self.df, reference, bring, against, **options), {d: Source("brought", tuple(keys), s) for s, d in pairs}, bring=[d for _, d in pairs], against=keys)

    def aggregate(self, by: str | Sequence[str], strategy: Mapping, **options) -> Traced:
        by = [by] if isinstance(by, str) else list(by)
        outputs = {k: (v if isinstance(v, tuple) else (k, v)) for k, v in strategy.items()}
        group = F.struct(*map(cols.quoted, by)).alias(GROUP)
        members = self._linked(self.df.select(group, self.df[GROUP].alias("__before")) if self.members is not None else self.df.select(group, ROW_ID))
        result = agg.aggregate(self.df, by, outputs, **options).withColumn(GROUP, group)
        return replace(self._then("aggregate", result, {o: Source("aggregated", (c, *by), m if isinstance(m, str) else str(m)) for o, (c, m) in outputs.items()}, by=by), members=members)

    def _linked(self, groups: DataFrame) -> DataFrame:
        """Groups of groups to their row numbers."""
        if self.members is None:
            return groups
        return groups.join(self.members.withColumnRenamed(GROUP, "__before"), "__before").select(GROUP, ROW_ID)

    def row_map(self) -> DataFrame:
        """The frame's rows with the numbers of the input rows that each stands for, one row for each number."""
        if self.members is None:
            return self.df
        return self.df.join(self.members, GROUP).drop(GROUP)

    def excluded(self) -> DataFrame:
        """Input rows that no row of the frame stands for any more."""
        left = self.df.select(ROW_ID) if self.members is None else self.members.join(self.df.select(GROUP), GROUP, "left_semi").select(ROW_ID)
        return self.origin.join(left, ROW_ID, "left_anti").drop(ROW_ID)

    def trace(self, row_ids: Sequence[int]) -> DataFrame:
        """The input rows of these numbers."""
        return self.origin.where(F.col(ROW_ID).isin(*row_ids))

    def dependencies(self, column: str) -> list[str]:
        """The columns a column goes back to, itself first."""
        need_columns(list(self.sources), [column])
        out, open_ = [], [column]
        while open_:
            c = open_.pop(0)
            if c not in out:
                out.append(c)
                open_ += [d for d in self.sources.get(c, Source("original")).depends_on if d != c]
        return out

    def report(self, warn_above: float = 0.1) -> str:
        """Steps with row counts (one job each), a warning where many rows went, and where each column comes from."""
        lines = [f"Lineage: {len(self.operations)} operations"]
        for i, op in enumerate(self.operations, 1):
            before, after = op.rows_before.count(), op.rows_after.count()
            lines.append(f"{i}. {op.kind} {dict(op.parameters)}: {before} -> {after} rows" + (f", adds {', '.join(op.added)}" if op.added else ""))
            if before > after and op.kind != "aggregate":
                lines.append(f"   {before - after} rows removed" + (f" WARNING: {(before - after) / before:.1%} of all" if before - after > warn_above * before else ""))
        for c, s in self.sources.items():
            lines.append(f"{c}: {s.kind}" + (f" from {', '.join(s.depends_on)}" if s.depends_on else "") + (f" ({s.detail})" if s.detail else ""))
        return "\n".join(lines)


def cycles(graph: Mapping[str, Sequence[str]]) -> list[str]:
    """The nodes of one cycle of a dependency graph, or nothing."""
    state: dict[str, int] = {}

    def visit(n: str, path: list[str]) -> list[str]:
        if state.get(n) == 1:
            return [*path[path.index(n) :], n]
        if state.get(n) == 2:
            return []
        state[n] = 1
        for m in graph.get(n, ()):
            if found := visit(m, [*path, n]):
                return found
        state[n] = 2
        return []

    for n in graph:
        if found := visit(n, []):
            return found
    return []


def ranges(ids: DataFrame, column: str = ROW_ID) -> DataFrame:
    """Row numbers as ranges (first, last): consecutive numbers share the difference to their rank, which is taken inside
    blocks of a million numbers so that no task ranks all of them."""
    block = F.expr(f"`{column}` div 1000000")
    ranked = ids.select(column, block.alias("b")).distinct().withColumn("g", F.col(column) - F.row_number().over(Window.partitionBy("b").orderBy(column)))
    pieces = ranked.groupBy("b", "g").agg(F.min(column).alias("first"), F.max(column).alias("last"))
    # only what touches the edge of a block, two pieces of each at most, can go on in the next one
    edge = (F.col("first") == F.col("b") * 1_000_000) | (F.col("last") == F.col("b") * 1_000_000 + 999_999)
    before = F.lag("last").over(Window.orderBy("first"))
    runs = pieces.where(edge).withColumn("new", F.coalesce((F.col("first") != before + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(Window.orderBy("first")))
    joined = runs.groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")
    return pieces.where(~edge).select("first", "last").unionByName(joined)


def need_traced(x) -> Traced:
    if not isinstance(x, Traced):
        raise LoomError("lineage needs a traced frame", "Begin with Traced.start(df)")
    return x
