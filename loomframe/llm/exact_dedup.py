"""Exact deduplication with a heavy-hitter split.

A Misra-Gries pass finds the digests that may be frequent, an exact count verifies them, and the verified winners
(`counters` rows at most) are broadcast, so that copies of a frequent text are settled map-side. All other digests, each
of which holds under 1 / counters of the rows, take an ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import materialize, numbered_columns

SUMMARY = "digest binary, n long"


def _shrink(counts: Counter, k: int) -> Counter:
    """Back to k counters: the (k + 1)-th largest count is taken off all, as merging Misra-Gries summaries asks."""
    if len(counts) <= k:
        return counts
    off = sorted(counts.values(), reverse=True)[k]
    return Counter({x: n - off for x, n in counts.items() if n > off})


def _summary(k: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            if counted:
                for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    counts[x] += n
            else:
                counts.update(b.column(0).to_pylist())
            counts = _shrink(counts, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"])

    return run


def frequent(digests: DataFrame, counters: int) -> DataFrame:
    """At most `counters` candidates, among them every value of the column `digest` with over 1 / (counters + 1) of the
    rows. Summaries are merged in two levels, so that no task reads more than about sqrt(partitions) of them."""
    parts = digests.rdd.getNumPartitions()
    level = digests.select("digest").mapInArrow(_summary(counters, False), SUMMARY)
    if parts > 1:
        level = level.repartition(max(1, round(parts**0.5))).mapInArrow(_summary(counters, True), SUMMARY)
    return level.repartition(1).mapInArrow(_summary(counters, True), SUMMARY).select("digest")


def digest_of(text_col: str):
    """SHA-256 of the UTF-8 text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def _winners(table: DataFrame, counters: int) -> DataFrame:
    """digest, its best (doc_id, row) and its count, for verified frequent digests: `counters` rows at most."""
    candidates = materialize(frequent(table, counters), "frequent")
    return (
        table.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays (a null id loses to any other). Null texts count as empty, so they
    equal empty ones. Of repeated rows, id and all, exactly one is kept. An empty table gives an empty result. Other
    columns of the input are not read.
    """
    table = materialize(docs.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    winners = materialize(_winners(table, counters), "winners")
    same = Window.partitionBy("digest")
    rest = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "*", F.max(F.struct("doc_id", "row")).over(same).alias("best"), F.count(F.lit(1)).over(same).alias("n")
    )
    both = table.join(F.broadcast(winners), "digest").select("digest", "doc_id", "row", "best", "n").unionByName(rest)
    return both.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1000) -> DataFrame:
    """The rows of docs that stay, with all columns of docs, whatever their names. Copies of frequent texts go map-side.
    What is left of a group is reduced map-side, too, so that neither copies nor rows that also share the id gather in one
    task. Null texts count as empty; a null id loses to any other; an empty table gives an empty result."""
    names, at, key = docs.columns, docs.columns.index(text_col), docs.columns.index(id_col)
    docs = numbered_columns(docs)
    id_, digest = F.col(f"c{key}"), digest_of(f"c{at}").alias("digest")
    table = materialize(docs.select(id_.alias("doc_id"), digest, F.lit(0).alias("row")), "digests")
    winners = materialize(_winners(table, counters).select("digest", F.struct("best.doc_id").alias("best")), "winners")
    alive = docs.select("*", digest).join(F.broadcast(winners), "digest", "left").where(F.col("best").isNull() | F.col("best")["doc_id"].eqNullSafe(id_))
    row = F.struct(*[F.col(c) for c in docs.columns])
    kept = alive.groupBy("digest").agg(F.max_by(row, F.struct(id_)).alias("row"))
    return kept.select("row.*").toDF(*names)


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
