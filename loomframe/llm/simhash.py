"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments: of two fingerprints that differ in two bits at most, one segment
differs in one bit at most. Every segment is indexed under its variants with one bit left out; fingerprints that meet
under a variant are compared in full. The 16 variants of a segment whose bit is left out in one half agree in the other
half, so fingerprints are shuffled by halves, four rows each, and a task makes the variants and joins them. Only distinct
fingerprints take part, so groups of copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import chunks, folded_words_of, materialize, tidy
from loomframe.llm.components import components, forest

HALF, MOST_BITS = 16, 2
#: Distinct fingerprints under one variant from which pairs are found by leaving out two bits instead of by comparison.
CROWD = 4096
#: Rows of the index in one task, and fingerprints with one half in common from which they are dealt by variant.
INDEXED, HOT = 200_000, 1_000_000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """The 64-bit fingerprints of whole texts."""
    hashed = xxhash.xxh64_intdigest
    values: list[int] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = folded_words_of(text)
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            values.append(hashed(joined, 42))
            sizes[i] = 1
            continue
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: -shingle].tolist()]
        values.extend([hashed(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)])
        sizes[i] = len(starts)
    return majority(np.array(values, dtype=np.uint64), sizes)


def majority(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive runs of `sizes` hashes, the bits that over half of them have."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    octets = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(sizes), dtype=np.uint64)
    for k in range(8):
        ones = np.bincount(doc * 256 + octets[:, k], minlength=256 * len(sizes)).reshape(len(sizes), 256) @ _BITS
        for j in range(8):
            out |= (2 * ones[:, j] > sizes).astype(np.uint64) << np.uint64(8 * k + j)
    return out


def _fingerprint(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, 1, 1_000_000):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1).to_pylist(), shingle).view(np.int64))], ["doc_id", "fp"])

    return run


def _two_left_out(fp: np.ndarray, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in fp that connect all fingerprints at up to two differing bits, all of which are among `free`: each pair of
    bits in which any differ is left out in turn, and equal rests are linked."""
    varies = int(np.bitwise_or.reduce(fp ^ fp[0]))
    free = [bit for bit in free if varies >> bit & 1]
    for p, q in list(combinations(free, 2)) or [(bit, bit) for bit in free]:
        rest = fp & np.uint64(0xFFFFFFFFFFFFFFFF ^ (1 << p | 1 << q))
        order = np.argsort(rest, kind="stable")
        same = np.flatnonzero(rest[order[1:]] == rest[order[:-1]])
        yield order[same], order[same + 1]


def _joined(half: np.ndarray, only: np.ndarray, fp: np.ndarray, rep: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints whose `half` (number and value) agrees: the other half of the segment may differ in one
    bit, which is left out in turn, or in `only` where that isn't negative. Fingerprints with the same segment count as
    differing in bit 0."""
    number = half >> HALF
    shift = (HALF * (number ^ 1)).astype(np.uint64)
    rest = (fp >> shift & np.uint64(0xFFFF)).astype(np.int64)
    a, b = [rep[:0]], [rep[:0]]

    def shrink(most: int = 1_000_000) -> None:
        if sum(map(len, a)) > most:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a[:], b[:] = [x], [y]

    for slot in range(HALF):
        at = np.flatnonzero((only < 0) | (only == slot))
        key = half[at] << HALF | rest[at] & ~(1 << slot)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.append(starts, len(key)))
        asked = sizes > 1
        if slot and len(starts):  # somebody must differ in this bit
            ones = np.add.reduceat(rest[at] >> slot & 1, starts)
            asked &= (ones > 0) & (ones < sizes)
        for i, n in zip(starts[asked & (sizes > crowd)].tolist(), sizes[asked & (sizes > crowd)].tolist(), strict=True):
            own, segment = at[i : i + n], int(number[at[i]]) >> 1
            free = [HALF * (int(number[own[0]]) ^ 1) + slot, *range(32 * (1 - segment), 32 * (2 - segment))]
            for x, y in _two_left_out(fp[own], free):
                a.append(rep[own[x]])
                b.append(rep[own[y]])
                shrink()
        few = np.repeat(asked & (sizes <= crowd), sizes)
        at, key = at[few], key[few]
        gap, here = 1, np.flatnonzero(key[1:] == key[:-1])
        while len(here):
            x, y = at[here], at[here + gap]
            near = np.bitwise_count(fp[x] ^ fp[y]) <= MOST_BITS
            a.append(rep[x[near]])
            b.append(rep[y[near]])
            shrink()
            gap += 1
            here = here[here + gap < len(key)]
            here = here[key[here] == key[here + gap]]
    return forest(np.concatenate(a), np.concatenate(b))


def _near(crowd: int):
    """From (key, fp, rep) in order of key to links (a, b); whole keys are taken together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64) for _ in range(3)]

        def out(key, fp, rep) -> pa.RecordBatch:
            a, b = _joined(key >> 21, (key >> 16 & 31) - 1, fp.view(np.uint64), rep, crowd)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held)]
            if len(held[0]) > INDEXED:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                if cut:
                    yield out(*(x[:cut] for x in held))
                    held = [x[cut:].copy() for x in held]
        if len(held[0]):
            yield out(*held)

    return run


def links_of(reps: DataFrame) -> DataFrame:
    """Links a - b between representatives (fp, rep) that connect all fingerprints at up to two differing bits.

    Halves that over HOT fingerprints share are dealt by single variants; at most 4 / HOT of all fingerprints' number are
    such halves, so that their list can be broadcast. What shares a variant is resolved in one task, in time that grows
    in proportion to it."""
    value = lambda i: F.shiftrightunsigned("fp", HALF * i).bitwiseAND(F.lit(0xFFFF))
    halves = reps.select("fp", "rep", F.inline(F.array(*[F.struct(value(i).bitwiseOR(F.lit(i << HALF)).alias("half"), value(i ^ 1).alias("rest")) for i in range(4)])))
    counted = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("n").alias("most")).first()
    base = F.col("half") * F.lit(1 << 21)
    if (rows.most or 0) > HOT:
        variants = F.array(*[F.lit((slot + 1) << 16).bitwiseOR(F.col("rest").bitwiseAND(F.lit(0xFFFF ^ (1 << slot)))) for slot in range(HALF)])
        hot = counted.where(F.col("n") > HOT).select("half", F.lit(True).alias("hot"))
        halves = halves.join(F.broadcast(hot), "half", "left").select(F.explode(F.when(F.col("hot"), variants).otherwise(F.array(F.lit(0).cast("long")))).alias("variant"), "half", "fp", "rep")
        base = base + F.col("variant")
    dealt = halves.select(base.alias("key"), "fp", "rep").repartition(rows.n // INDEXED + 1, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidy(_near(CROWD)), "a long, b long")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Words are white-space separated, A-Z folded; shingles of `shingle` words, repeats included; a text of fewer words is
    one shingle; a null, empty or blank text has fingerprint zero, linked like any other. component_id is the smallest
    id reachable through links of up to two differing bits. Rows with a null id take the component of their fingerprint,
    null if only null ids have it; such fingerprints link with nothing. Repeated rows are alike.
    """
    table = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprint(shingle), "doc_id long, fp long"), "fingerprints")
    reps = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "reps")
    classes = reps.join(components(links_of(reps)), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return table.join(classes, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
