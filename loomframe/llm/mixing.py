"""Mixing sources to target weights.

The words of each source, its documents laid end to end, are packed into blocks of fixed length. Each output shard draws
its source counts from a multinomial distribution, by what the targets still lack; a slot of the output is mapped to a
block through a pseudorandom permutation of its source's block numbers (one per pass over the source); slots and blocks
are then joined by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import WORD, chunks, materialize, mixed, numbered_columns, tidy

#: No document is taken more often than this.
MOST = 3
WEIGHTS = (1, 2, 3)
#: Up to so many sources the plan is made on the driver; of more it is made by tasks, which draw for so many at a time.
FEW = 10_000
#: Shards where sources are many: each one's draw goes over all sources.
SHARDS_OF_MANY = 64
PLAN = "source_at int, shard int, first long, count long, blocks long"
SLOTS = "source_at int, shard int, slot long, block long"


def targets_of(sizes: list[int], weights: list[int]) -> list[float]:
    """Shares of sum(sizes) by weight; a target stops at MOST times its source's size, and the excess is shared again by
    weight until none is above."""
    left, open_, out = Fraction(sum(sizes)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > MOST * sizes[i]}
        for i in full or open_:
            out[i] = Fraction(MOST * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return [float(x) for x in out]


def draw(wanted: np.ndarray, most: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots per shard and source. Each shard's counts are multinomial, by the slots each source still lacks, so that
    what one shard draws too much or too little later ones make up. No source gets more than `most` slots."""
    total = int(round(float(wanted.sum())))
    return drawn(wanted, most, [total * (k + 1) // shards - total * k // shards for k in range(shards)], np.random.default_rng(seed))


def drawn(wanted: np.ndarray, most: np.ndarray, slots: list[int], rng: np.random.Generator) -> np.ndarray:
    """draw() for shards of so many slots each."""
    counts = np.zeros((len(slots), len(wanted)), dtype=np.int64)
    taken = np.zeros(len(wanted), dtype=np.int64)
    for k, n in enumerate(slots):
        while n > 0:
            room = most - taken
            lack = np.where(room > 0, np.maximum(wanted - taken, 0.0), 0.0)
            if lack.sum() <= 0:
                lack = np.where(room > 0, wanted, 0.0)
            if lack.sum() <= 0:
                break
            got = np.minimum(rng.multinomial(n, lack / lack.sum()), room)
            counts[k] += got
            taken += got
            n -= int(got.sum())
    return counts


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 24) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1 for any n by swap-or-not rounds; x, n and key (uint64) are parallel."""
    x = x.astype(np.int64)
    for r in range(rounds):
        with np.errstate(over="ignore"):
            k = mixed(key + np.uint64(2 * r + 1))
            other = ((k % n.astype(np.uint64)).astype(np.int64) - x) % n
            bit = mixed(k ^ np.maximum(x, other).astype(np.uint64)) & np.uint64(1)
        x = np.where(bit == 1, other, x)
    return x


def _plan(counts: np.ndarray, at: np.ndarray, blocks: np.ndarray) -> pa.Table:
    """Which slots of its source a shard takes, of counts (shards x sources)."""
    firsts = np.cumsum(counts, axis=0) - counts
    k, i = np.nonzero(counts)
    columns = [pa.array(at[i].astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(firsts[k, i]), pa.array(counts[k, i]), pa.array(blocks[i])]
    return pa.Table.from_arrays(columns, ["source_at", "shard", "first", "count", "blocks"])


def _plan_of_bucket(shared, seed: int, few: int):
    """From the rows of `few` neighbouring sources: the plan that deals them the slots which each shard gives their bucket."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("source_at")
        at, wanted, blocks = (table.column(c).to_numpy() for c in ("source_at", "wanted", "blocks"))
        bucket = int(at[0]) // few
        return _plan(drawn(wanted, MOST * blocks, shared.value[:, bucket].tolist(), np.random.default_rng([seed, bucket])), at, blocks)

    return run


def _numbered(by_source: DataFrame) -> DataFrame:
    """source_at, source, source_size: sources numbered by code point, null last, range by range."""
    ranges = materialize(by_source.orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()), "sources")
    ranges = ranges.withColumn("range", F.shiftright("id", 33))
    first, rows = 0, []
    for r in sorted(ranges.groupBy("range").count().collect()):
        rows.append((r[0], first))
        first += r[1]
    firsts = ranges.sparkSession.createDataFrame(rows, "range long, start long")
    return ranges.join(F.broadcast(firsts), "range").select((F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1)).cast("int").alias("source_at"), "source", "source_size")


def _with_targets(numbered: DataFrame, weights) -> DataFrame:
    """numbered with targets as of targets_of(). A source is full if its size is below a bound that depends on its weight
    alone; bounds only rise, so what reaches the driver has a row a round."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(w.denominator for w in exact))
    units = [int(w * scale) for w in exact]
    kind, bounds, before = F.col("source_at") % len(units), [0] * len(units), None
    while True:
        below = F.lit(False)
        for k, b in enumerate(bounds):
            below = below | ((kind == k) & (F.col("source_size") < b))
        open_ = [F.count_if((kind == k) & ~below) for k in range(len(units))]
        total, full, *counts = numbered.agg(F.sum("source_size"), F.coalesce(F.sum(F.when(below, F.col("source_size"))), F.lit(0)), *open_).first()
        share, left = sum(n * w for n, w in zip(counts, units, strict=True)), total - MOST * full
        if counts == before or not share:
            break
        # size * MOST < left * weight / share, in whole numbers
        before, bounds = counts, [-(-left * w // (MOST * share)) for w in units]
    target = (F.lit(MOST) * F.col("source_size")).cast("double")
    for k, w in enumerate(units):
        target = F.when((kind == k) & ~below, F.lit(float(Fraction(left * w, share or 1)))).otherwise(target)
    return numbered.withColumn("target", target)


def _slots(seed: int, at_once: int = 100_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, shard, first, count, blocks = (c.to_numpy() for c in b.columns)
            ends = np.cumsum(count)
            for start in range(0, int(ends[-1]) if len(ends) else 0, at_once):
                place = np.arange(start, min(int(ends[-1]), start + at_once), dtype=np.int64)
                row = np.searchsorted(ends, place, side="right")
                k, n = first[row] + place - (ends - count)[row], blocks[row]
                with np.errstate(over="ignore"):
                    key = mixed((k // n).astype(np.uint64) + mixed((np.uint64(seed) << np.uint64(32)) + source[row].astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(source[row]), pa.array(shard[row]), pa.array(k), pa.array(permuted(k % n, n, key))], ["source_at", "shard", "slot", "block"])

    return run


class Mixture:
    """A plan for a mixture of docs.

    sized: row, doc_id, size, source_at. sources: source_at, source, source_size, target, blocks. spans: the part of a
    document in a block (row, source_at, block, first word, words). slots: the output in order (shard, slot, source_at,
    block). Word counts come from the whole text, null texts and ids included (null text: no words); repeated rows are
    documents of their own; an empty table, or one without any word, gives an empty mixture. Results depend only on
    the rows and the seed. What reaches the driver has one row per source up to FEW sources, and one per FEW of them beyond.
    """

    def __init__(self, docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, block_words=64, shard_slots=16, most_shards=1024, seed=7):
        self.block_words = block_words
        self.names, self.text_at = docs.columns, docs.columns.index(text_col)
        id_, text, source = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col, source_col))
        words = F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")
        self.rows = materialize(numbered_columns(docs).select("*", F.monotonically_increasing_id().alias("row"), words.alias("size")), "rows")
        sized = self.rows.select("row", id_.alias("doc_id"), source.cast("string").alias("source"), "size")
        by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        found = by_source.limit(FEW + 1).toArrow()
        self.few = found.num_rows <= FEW
        plan, total = self._planned_here(found, weights, shard_slots, most_shards, seed) if self.few else self._planned_by_tasks(by_source, weights, shard_slots, most_shards, seed)
        self.sized = sized.join(self._small(self.sources.select("source_at", F.col("source").alias("of"))), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        parts = max(1, total // 200_000 + 1)
        self.slots = plan.repartition(parts, *(["shard"] if self.few else ["shard", "source_at"])).mapInArrow(tidy(_slots(seed)), SLOTS)

    def _planned_here(self, found: pa.Table, weights, shard_slots: int, most_shards: int, seed: int) -> tuple[DataFrame, int]:
        """The plan and its number of slots; sets sources."""
        found = sorted(zip(found.column("source").to_pylist(), found.column("source_size").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or ""))
        sizes = [n for _, n in found]
        targets = targets_of(sizes, [weights[i % len(weights)] for i in range(len(found))])
        blocks = np.array([-(-s // self.block_words) for s in sizes], dtype=np.int64)
        wanted = np.array([t * b / s if s else 0.0 for t, b, s in zip(targets, blocks, sizes, strict=True)])
        shards = max(1, min(most_shards, 200_000 // max(1, len(found)), int(wanted.sum()) // shard_slots))
        spark, at = self.rows.sparkSession, np.arange(len(found), dtype=np.int32)
        columns = [pa.array(at), pa.array([x for x, _ in found], pa.string()), pa.array(sizes, pa.int64()), pa.array(targets, pa.float64()), pa.array(blocks)]
        self.sources = spark.createDataFrame(pa.Table.from_arrays(columns, ["source_at", "source", "source_size", "target", "blocks"]))
        return spark.createDataFrame(_plan(draw(wanted, MOST * blocks, shards, seed), at, blocks)), int(wanted.sum())

    def _planned_by_tasks(self, by_source: DataFrame, weights, shard_slots: int, most_shards: int, seed: int) -> tuple[DataFrame, int]:
        """The same for any number of sources. Each shard deals its slots to buckets of FEW neighbouring sources on the
        driver and inside a bucket in a task, which makes the same multinomial distribution in two steps."""
        blocks = F.expr(f"(source_size + {self.block_words - 1}) div {self.block_words}")
        self.sources = materialize(_with_targets(_numbered(by_source), weights).withColumn("blocks", blocks), "targets")
        wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
        bucketed = self.sources.select("source_at", "blocks", wanted.alias("wanted"), F.expr(f"source_at div {FEW}").alias("bucket"))
        # decimals, as a sum of doubles depends on the order of rows
        sums = sorted(bucketed.groupBy("bucket").agg(F.sum(F.col("wanted").cast("decimal(28,6)")), F.sum("blocks")).collect())
        of_buckets, total = np.array([float(r[1]) for r in sums]), int(sum(r[1] for r in sums))
        shards = max(1, min(most_shards, SHARDS_OF_MANY, 200_000 // len(sums), total // shard_slots))
        counts = draw(of_buckets, MOST * np.array([r[2] for r in sums], dtype=np.int64), shards, seed)
        shared = self.rows.sparkSession.sparkContext.broadcast(counts)
        return bucketed.groupBy("bucket").applyInArrow(_plan_of_bucket(shared, seed, FEW), PLAN), total

    def _small(self, table: DataFrame) -> DataFrame:
        """A table with a row per source: broadcast if these are few."""
        return F.broadcast(table) if self.few else table

    @property
    def spans(self) -> DataFrame:
        """Offsets are running sums in two levels, over some buckets of each source and within each bucket, so that a
        source with most of the rows is still dealt to many tasks."""
        bucket = F.pmod(F.xxhash64("doc_id", "size"), F.lit(1009))
        by = self.sized.where("size > 0").withColumn("bucket", bucket)
        sums = by.groupBy("source_at", "bucket").agg(F.sum("size").alias("n"))
        before = F.sum("n").over(Window.partitionBy("source_at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        starts = sums.select("source_at", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
        inside = F.sum("size").over(Window.partitionBy("source_at", "bucket").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1))
        laid = by.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, ["source_at", "bucket"]).withColumn("at", F.col("start") + F.col("inside"))
        size = F.lit(self.block_words)
        block = F.explode(F.sequence(F.expr(f"at div {self.block_words}"), F.expr(f"(at + size - 1) div {self.block_words}"))).alias("block")
        cut = laid.select("row", "source_at", "at", "size", block)
        low, high = F.greatest("at", F.col("block") * size), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * size)
        return cut.select("row", "source_at", "block", (low - F.col("at")).alias("first"), (high - low).alias("words"))

    @property
    def uses(self) -> DataFrame:
        """spans with the number of slots that take the block."""
        drawn = self.slots.groupBy("source_at", "block").agg(F.count(F.lit(1)).alias("times"))
        return self.spans.join(drawn, ["source_at", "block"])

    def taken(self) -> DataFrame:
        """Per row of docs: doc_id, size, source_size, target, taken."""
        taken = self.uses.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        of = self._small(self.sources.select("source_at", "source_size", "target"))
        return (
            self.sized.join(taken, "row", "left")
            .join(of, "source_at", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        )

    def blocks(self) -> DataFrame:
        """The mixture slot by slot: shard, slot, source_at, block, row, first, words; a block has a row for each document in it."""
        return self.slots.join(self.spans, ["source_at", "block"])

    def documents(self, chars_col: str | None = "n_chars") -> DataFrame:
        """The mixture as rows with the columns of docs: for each pass over a source, every maximal run of taken words of a
        document is one row, with the text from its first to its last word; a document taken as a whole keeps its text."""
        runs = self.uses.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "words", "times"))).alias("uses"))
        columns = self.rows.columns[: len(self.names)]
        joined = self.rows.join(runs, "row").select(*columns, "size", "uses")
        chars_at = self.names.index(chars_col) if chars_col in self.names else None
        return joined.mapInArrow(tidy(_cut(self.text_at, chars_at)), self.rows.select(*columns).schema).toDF(*self.names)


def runs_of(uses: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (first word, end) of blocks taken at least once, then at least twice, and so on."""
    out = []
    for level in range(1, max((t for _, _, t in uses), default=0) + 1):
        here = [(f, f + w) for f, w, t in uses if t >= level]
        for f, e in here:
            if out and out[-1][2] == level and out[-1][1] == f:
                out[-1] = (out[-1][0], e, level)
            else:
                out.append((f, e, level))
    return [(f, e) for f, e, _ in out]


def _cut(text_at: int, chars_at: int | None):
    import re

    pattern = re.compile(r"[^ \t-\r]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, text_at):
                texts, sizes, uses = (b.column(i).to_pylist() for i in (text_at, b.num_columns - 2, b.num_columns - 1))
                rows, parts = [], []
                for i, (text, size, own) in enumerate(zip(texts, sizes, uses, strict=True)):
                    places = None
                    for f, e in runs_of([(u["first"], u["words"], u["times"]) for u in own]):
                        if f == 0 and e == size:
                            parts.append(text)
                        else:
                            places = places or [m.span() for m in pattern.finditer(text)]
                            parts.append(text[places[f][0] : places[e - 1][1]])
                        rows.append(i)
                picked = b.take(pa.array(rows, pa.int64()))
                columns = [picked.column(i) for i in range(b.num_columns - 2)]
                columns[text_at] = pa.array(parts, pa.string())
                if chars_at is not None:
                    columns[chars_at] = pa.array([len(x) for x in parts]).cast(columns[chars_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-2])

    return run


def mix(docs: DataFrame, **options) -> DataFrame:
    """See Mixture: one row per row of docs, with the words that the mixture takes of it."""
    return Mixture(docs, **options).taken()
