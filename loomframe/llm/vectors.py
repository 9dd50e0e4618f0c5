"""Near-duplicate vectors by NN-descent.

A neighbour graph starts from vectors that fall into the same cells of random hyperplanes, and is refined by joining
the neighbours of every node with one another. A list whose every neighbour is above the threshold is saturated and is
enlarged. Rounds go on until one finds no new link and no list is saturated; then the recall of sampled nodes is audited by
brute force, and cells of new hyperplanes and further rounds follow while it is too low. Edges above the threshold are the
links.

A node whose list saturates at its greatest size is dense, as members of large groups are. Its links are not listed but
counted, all of them, block by block against what stands around a few centres that are chosen among the dense nodes.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.errors import LoomError
from loomframe.llm.common import drop_table, materialize, mixed
from loomframe.llm.components import components, forest

_log = logging.getLogger("loomframe")

LISTS = "u long, k int, v array<long>, s array<double>, fresh array<boolean>, gained long, dense boolean"
CANDIDATES = "u long, v long, s double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows, in double precision, of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _candidates(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64)), pa.array(np.asarray(s, np.float64))], ["u", "v", "s"])


def _by_group(batches: Iterator[pa.RecordBatch], most: int):
    """Consecutive rows that agree in the first column, in pieces of at most `most` rows."""
    rest = None
    for b in batches:
        if rest is not None and rest.num_rows:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0] if b.num_rows else rest
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        stops = np.append(starts[1:], b.num_rows)
        for i, j in zip(starts[:-1].tolist(), stops[:-1].tolist(), strict=True):
            for k in range(i, j, most):
                yield b.slice(k, min(most, j - k))
        first = int(starts[-1])
        while b.num_rows - first > most:
            yield b.slice(first, most)
            first += most
        rest = b.slice(first)
    if rest is not None and rest.num_rows:
        yield rest


def _cells(v: DataFrame, tables: int, seed: int, crowd: int = 64) -> DataFrame:
    """Candidates from vectors in the same cell; full cells are cut up along one more random direction."""
    n = v.count()
    bits = max(0, int(np.ceil(np.log2(max(1.0, n / 48.0)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.diff(b.column(1).offsets.to_numpy())
            for length in np.unique(lengths):
                own = b.filter(pa.array(lengths == length))
                x = _matrix(own.column(1))
                rng = np.random.default_rng([seed, int(length)])
                for t in range(tables):
                    planes = rng.standard_normal((int(length), bits + 1))
                    y = x @ planes
                    cell = (y[:, :bits] > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), dtype=np.int64)
                    cell = mixed(cell.astype(np.uint64) + np.uint64((t * 100_003 + int(length)) << 32)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(y[:, bits]), own.column(0), own.column(1)], ["cell", "along", "u", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_group(batches, crowd):
            if b.num_rows > 1:
                ids, x = b.column(2).to_numpy(), _matrix(b.column(3))
                s = x @ x.T
                np.fill_diagonal(s, -2)
                k = min(8, len(ids) - 1)
                near = np.argpartition(-s, k - 1, axis=1)[:, :k]
                rows = np.repeat(np.arange(len(ids)), k)
                yield _candidates(ids[rows], ids[near.ravel()], s[rows, near.ravel()])

    placed = v.select("u", "vec").mapInArrow(place, f"cell long, along double, u long, vec {v.schema['vec'].dataType.simpleString()}")
    return placed.repartition("cell").sortWithinPartitions("cell", "along").mapInArrow(compare, CANDIDATES)


def _chosen(u: int, v: np.ndarray, fresh: np.ndarray, turn: int, most: int) -> np.ndarray:
    """Which entries of a list take part in a round: `most` fresh and `most` other ones, picked by hash; the fresh ones
    that wait keep their mark for a later round."""
    order = np.argsort(mixed(v.astype(np.uint64) + np.uint64(mixed(np.array([(u << 8) + turn], dtype=np.uint64))[0])), kind="stable") if len(v) > most else np.arange(len(v))
    out = np.zeros(len(v), dtype=bool)
    for kind in (True, False):
        out[order[fresh[order] == kind][:most]] = True
    return out


def _edges(turn: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, (v,) = _lists(b.column(1))
            fresh = _lists(b.column(2))[1][0].astype(bool)
            us = b.column(0).to_numpy()
            own = np.zeros(len(v), dtype=bool)
            for i, u in enumerate(us.tolist()):
                at = slice(ends[i], ends[i + 1])
                own[at] = _chosen(u, v[at], fresh[at], turn, most)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(us, np.diff(ends))[own]), pa.array(v[own]), pa.array(fresh[own])], ["c", "m", "fresh"])

    return run


def _join(threshold: float, most: int = 300_000):
    """Pairs of neighbours of a node that are nearer than what one of them has. In a dense group many nodes find the same
    pair: a task gives it out once for every `most` finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            u, v, s = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((v, u))
            u, v, s = u[order], v[order], s[order]
            first = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))
            return _candidates(u[first], v[first], s[first])

        for b in _by_group(batches, 256):
            fresh = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if b.num_rows < 2 or not fresh.any():
                continue
            ids, x, floor = b.column(1).to_numpy(), _matrix(b.column(3)), b.column(4).to_numpy()
            s = x @ x.T
            good = (fresh[:, None] | fresh[None, :]) & (s > floor[:, None]) & (ids[:, None] != ids[None, :])
            i, j = np.nonzero(good)
            held.append((ids[i], ids[j], s[i, j]))
            size += len(i)
            if size > most:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _lists(column: pa.Array, *fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and flat values of a list column (null: empty); fields: of a list of structs."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = [flat.field(i) if pa.types.is_struct(flat.type) else flat for i in fields or (0,)]
    return np.append(0, np.cumsum(lengths)), [x.to_numpy(zero_copy_only=False) for x in values]


def _merge(turn: int, most: int, start_k: int, threshold: float, most_list: int):
    """(u, k, v, s, fresh, found) to the new list, how many links it gained, and whether it is dense: full of links at
    its greatest size. Dense lists stay as they are. Lists stay in Arrow's flat arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, ks = b.column(0).to_numpy(), pc.fill_null(b.column(1), start_k).to_numpy(zero_copy_only=False)
            ends, (old_v,) = _lists(b.column(2))
            old_s, old_fresh = _lists(b.column(3))[1][0], _lists(b.column(4))[1][0].astype(bool)
            found_ends, (found_v, found_s) = _lists(b.column(5), 0, 1)
            out, size = [], 0
            for i, (u, k) in enumerate(zip(us.tolist(), ks.tolist(), strict=True)):
                own, new = slice(ends[i], ends[i + 1]), slice(found_ends[i], found_ends[i + 1])
                v, s, fresh = old_v[own], old_s[own], old_fresh[own]
                before = int((s >= threshold).sum())
                if turn >= 0 and len(v):
                    fresh = fresh & ~_chosen(u, v, fresh, turn, most)
                if new.stop > new.start and before < most_list:
                    unknown = ~np.isin(found_v[new], v)
                    v, s = np.concatenate([v, found_v[new][unknown]]), np.concatenate([s, found_s[new][unknown]])
                    fresh = np.concatenate([fresh, np.ones(int(unknown.sum()), dtype=bool)])
                    while k <= int((s >= threshold).sum()) and k < most_list:
                        k = min(4 * k, most_list)
                    best = np.lexsort((v, -s))[:k]
                    v, s, fresh = v[best], s[best], fresh[best]
                after = int((s >= threshold).sum())
                out.append((u, k, v, s, fresh, after - before, after >= most_list))
                size += len(v)
                if size > 1_000_000:
                    yield _packed(out)
                    out, size = [], 0
            if out:
                yield _packed(out)

    return run


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    u, k, v, s, fresh, gained, dense = zip(*rows, strict=True)
    ends = pa.array(np.append(0, np.cumsum([len(x) for x in v])).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (v, s, fresh)]
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(k, pa.int32()), *lists, pa.array(gained, pa.int64()), pa.array(dense, pa.bool_())], ["u", "k", "v", "s", "fresh", "gained", "dense"])


#: Nodes with so many links count as members of a large group in the audit.
LARGE = 32
#: Links from which a node is dense; dense nodes that are tried as centres at once, and that are compared at once.
MOST_LIST, CENTRES, BLOCK = 128, 1024, 2048


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and the unit rows of the vectors of each length."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        yield own, _matrix(vectors.take(pa.array(own)))


def plain_links(lists: DataFrame, threshold: float) -> DataFrame:
    """u, v, in both directions: the links between nodes that are not dense."""
    dense = lists.where("dense").select(F.col("u").alias("v"))
    near = lists.where("NOT dense").select("u", F.explode(F.filter(F.arrays_zip("v", "s"), lambda x: x["s"] >= threshold)).alias("x")).select("u", F.col("x.v").alias("v"))
    near = near.join(dense, "v", "left_anti").select("u", "v")
    return near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _recall(v: DataFrame, lists: DataFrame, threshold: float, seed: int = 0, linked: int = 200, others: int = 600) -> float:
    """The recall of links between nodes that are not dense, against all vectors, as the least of three means over sampled
    nodes, each of which counts alike however many links it has: nodes in large groups, other nodes with links, and nodes
    without (1 if they have none)."""
    found = F.size(F.filter("s", lambda x: x >= threshold))
    plain = lists.where("NOT dense")
    kept = plain.select("u", F.when(found >= LARGE, 2).when(found > 0, 1).otherwise(0).alias("stratum"), F.xxhash64("u", F.lit(seed)).alias("h"))
    picked = [r for stratum, k in ((2, linked), (1, linked), (0, others)) for r in kept.where(F.col("stratum") == stratum).orderBy("h").limit(k).collect()]
    if not picked:
        return 1.0
    spark, ids = v.sparkSession, [r.u for r in picked]
    sample = F.broadcast(spark.createDataFrame([(u,) for u in ids], "u long"))
    asked = v.join(sample, "u", "left_semi").select("u", "vec").toArrow()
    at = {u: i for i, u in enumerate(asked.column("u").to_pylist())}
    shared = spark.sparkContext.broadcast((asked.column("u").to_numpy(), [(own, x) for own, x in _by_length(asked.column("vec").combine_chunks())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queried, queries = shared.value
        total = np.zeros(len(queried), dtype=np.int64)
        for b in batches:
            ids = b.column(0).to_numpy()
            for own, x in _by_length(b.column(1)):
                for places, q in queries:
                    if q.shape[1] == x.shape[1]:
                        total[places] += ((x @ q.T >= threshold) & (ids[own][:, None] != queried[places][None, :])).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(queried), pa.array(total)], ["u", "n"])

    others_ = v.join(plain.select("u"), "u", "left_semi")
    there = {r.u: r.n for r in others_.select("u", "vec").mapInArrow(count, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")).collect()}
    # a link counts if either end lists it
    got = {r.u: r.n for r in plain_links(lists, threshold).join(sample, "u", "left_semi").groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect()}
    means = []
    for stratum in (2, 1, 0):
        shares = [min(1.0, got.get(r.u, 0) / there[r.u]) if there.get(r.u) else 1.0 for r in picked if r.stratum == stratum and r.u in at]
        means += [sum(shares) / len(shares)] if shares else []
    return min(means)


def neighbours(v: DataFrame, threshold: float = 0.95, k: int = 8, most: int = 24, tables: int = 8, wanted: float = 0.995, most_audits: int = 24, most_list: int = MOST_LIST, seed: int = 5) -> DataFrame:
    """v: u long, vec array<float>, all different and valid. The lists u, v, s, dense. An error is raised if so many audits
    have failed; there is no bound on the rounds between them, each of which finds a link at least."""
    lists, turn, planes, gained = None, 0, 0, 1
    while True:
        if lists is None or not gained:
            if lists is not None:
                recall = _recall(v, lists, threshold, planes)
                _log.info("near vectors: recall %.4f after %d rounds", recall, turn)
                if recall >= wanted:
                    return lists
                if planes >= most_audits:
                    raise LoomError(f"near vectors: a recall of {recall:.4f} after {planes} audits, {wanted} is wanted", "Raise tables or most_audits")
            found = _cells(v, tables, seed + planes)
            planes += 1
            mark = -1
        else:
            # what stands around dense nodes needs no join: their links are counted
            centres = lists.where("NOT dense")
            picked = centres.select("u", "v", "fresh").mapInArrow(_edges(turn, most), "c long, m long, fresh boolean")
            back = picked.select(F.col("m").alias("c"), F.col("c").alias("m"), "fresh").join(centres.select(F.col("u").alias("c")), "c", "left_semi")
            nth = F.row_number().over(Window.partitionBy("c", "fresh").orderBy(F.xxhash64("m", F.lit(turn))))
            back = back.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
            members = picked.unionByName(back).groupBy("c", "m").agg(F.max("fresh").alias("fresh"))
            floor = F.when(F.col("dense"), F.lit(2.0)).when(F.size("s") < F.col("k"), F.lit(-2.0)).otherwise(F.element_at("s", -1))
            known = v.join(lists.select("u", floor.alias("floor")), "u").withColumnRenamed("u", "m")
            found = members.join(known, "m").select("c", "m", "fresh", "vec", "floor").repartition("c").sortWithinPartitions("c", F.col("fresh").desc()).mapInArrow(_join(threshold), CANDIDATES)
            mark = turn
        grouped = found.groupBy("u", "v").agg(F.max("s").alias("s")).groupBy("u").agg(F.collect_list(F.struct("v", "s")).alias("found"))
        if lists is None:
            empty = [F.lit(None).cast(t).alias(c) for c, t in (("k", "int"), ("v", "array<long>"), ("s", "array<double>"), ("fresh", "array<boolean>"))]
            joined = v.select("u").join(grouped, "u", "left").select("u", *empty, "found")
        else:
            joined = lists.join(grouped, "u", "left").select("u", "k", "v", "s", "fresh", "found")
        merged = materialize(joined.mapInArrow(_merge(mark, most, k, threshold, most_list), LISTS), "lists")
        gained = merged.agg(F.sum("gained")).first()[0] or 0
        if lists is not None:
            drop_table(lists)
        lists = merged
        turn += 1


def _thinned(x: np.ndarray, threshold: float) -> np.ndarray:
    """Rows no two of which are as near as the threshold, and one of which is that near to each row left out."""
    kept = np.zeros((0, x.shape[1]))
    for row in x:
        if not (kept @ row >= threshold).any():
            kept = np.concatenate([kept, row[None, :]])
    return kept


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def _assigned(shared):
    """(u, times, vec) with the nearest centre and the angle to it; no centre for a length that has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, angle = np.full(b.num_rows, -1, dtype=np.int64), np.full(b.num_rows, np.pi)
            for own, x in _by_length(b.column(2)):
                for first, centres in shared.value:
                    if centres.shape[1] == x.shape[1]:
                        a = _angles(x, centres)
                        cell[own], angle[own] = first + a.argmin(axis=1), a.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], ["u", "times", "vec", "cell", "angle"])

    return run


def _around(shared, reach: dict[int, tuple[float, int]]):
    """(u, times, dense, vec), once for each block of the dense nodes of each centre within whose reach it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 2000):
                b = big.slice(start, 2000)
                for own, x in _by_length(b.column(3)):
                    for first, centres in shared.value:
                        if centres.shape[1] != x.shape[1]:
                            continue
                        a = _angles(x, centres)
                        for cell in range(first, first + len(centres)):
                            if cell not in reach:
                                continue
                            near = b.take(pa.array(own[a[:, cell - first] <= reach[cell][0]]))
                            for block in range(reach[cell][1] if near.num_rows else 0):
                                n = near.num_rows
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, cell)), pa.array(np.full(n, block)), pa.array(np.zeros(n, dtype=bool)), *near.columns], ["cell", "block", "asked", "u", "times", "dense", "vec"])

    return run


def _counted(threshold: float, at_once: int = 1024):
    """Rows of a cell and block, the dense nodes that are asked for first, to counts (u, n) and links (u, to). A dense node
    counts all its links, any other node its links with the dense ones; links connect what is linked, one row for a node."""

    def compare(asked: list, rows: list) -> Iterator[pa.RecordBatch]:
        ids, times, x = (np.concatenate(c) for c in zip(*asked, strict=True))
        label, totals = ids.copy(), np.zeros(len(ids), dtype=np.int64)
        for own, weight, dense, y in rows:
            s = (y @ x.T >= threshold) & (own[:, None] != ids[None, :])
            totals += weight @ s
            linked = s.any(axis=1)
            low = np.where(s, label[None, :], np.iinfo(np.int64).max).min(axis=1)
            i, j = np.nonzero(s & (label[None, :] != low[:, None]))
            if len(i):
                a, b = forest(label[j], low[i])
                yield _told(a, None, b)
                at = np.minimum(np.searchsorted(a, label), len(a) - 1)
                label = np.where(a[at] == label, b[at], label)
                at = np.minimum(np.searchsorted(a, low), len(a) - 1)
                low = np.where(a[at] == low, b[at], low)
            yield _told(own[linked], None, low[linked])
            n = s @ times
            yield _told(own[linked & ~dense], n[linked & ~dense], None)
        asked[:] = [(ids, times, x)]
        yield _told(ids, totals, None)
        yield _told(ids, None, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked = None, []
        for big in batches:
            cells, blocks = big.column(0).to_numpy(), big.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]) | (blocks[1:] != blocks[:-1])))
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), big.num_rows], strict=True):
                if key != (cells[i], blocks[i]):
                    key, asked = (cells[i], blocks[i]), []
                rows = []
                for k in range(i, j, at_once):
                    b = big.slice(k, min(at_once, j - k))
                    own = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
                    for part, into in ((b.filter(pa.array(own)), asked), (b.filter(pa.array(~own)), rows)):
                        if part.num_rows:
                            x, ids, times = _matrix(part.column(6)), part.column(3).to_numpy(), part.column(4).to_numpy()
                            into.append((ids, times, x) if into is asked else (ids, times, part.column(5).to_numpy(zero_copy_only=False).astype(bool), x))
                if rows and asked:
                    yield from compare(asked, rows)

    return run


def _told(u: np.ndarray, n: np.ndarray | None, to: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u), none if n is None else pa.array(n.astype(np.int64)), none if to is None else pa.array(to)], ["u", "n", "to"])


def dense_links(v: DataFrame, threshold: float, centres: int = CENTRES, block: int = BLOCK) -> DataFrame:
    """v: u, times, dense, vec. Rows (u, n, null) whose sum over n is, for dense nodes, the number of links and, for others,
    the number of links with dense nodes; and rows (u, null, to) that connect whatever such links connect.

    Neighbours of a node are at most as far from its centre as the node is, and the threshold's angle more. In each turn
    some of the dense nodes that no centre has been near to yet are tried as centres."""
    angle, out = float(np.arccos(threshold)), None
    left = v.where("dense").select("u", "times", "vec")
    while True:
        tried = left.orderBy(F.xxhash64("u")).limit(centres).select("vec").toArrow().column("vec").combine_chunks()
        if not len(tried):
            return out if out is not None else v.sparkSession.createDataFrame([], "u long, n long, to long")
        chosen, first = [], 0
        for _, x in _by_length(tried):
            chosen.append((first, _thinned(x, threshold)))
            first += len(chosen[-1][1])
        shared = v.sparkSession.sparkContext.broadcast(chosen)
        dealt = materialize(left.mapInArrow(_assigned(shared), f"u long, times long, vec {v.schema['vec'].dataType.simpleString()}, cell long, angle double"), "dealt")
        near = dealt.where(F.col("angle") <= 1.2 * angle)
        reach = {r.cell: (r.angle + angle + 1e-6, -(-r.n // block)) for r in near.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect()}
        blocks = F.create_map(*[x for c, (_, n) in reach.items() for x in (F.lit(c), F.lit(n))])
        asked = near.select("cell", F.pmod(F.xxhash64("u"), F.element_at(blocks, F.col("cell"))).cast("long").alias("block"), F.lit(True).alias("asked"), "u", "times", F.lit(True).alias("dense"), "vec")
        others = v.select("u", "times", "dense", "vec").mapInArrow(_around(shared, reach), asked.schema)
        told = asked.unionByName(others).repartition("cell", "block").sortWithinPartitions("cell", "block", F.col("asked").desc()).mapInArrow(_counted(threshold), "u long, n long, to long")
        told = materialize(told, "told")
        out = told if out is None else out.unionByName(told)
        left = materialize(dealt.where(F.col("angle") > 1.2 * angle).select("u", "times", "vec"), "left")
        drop_table(dealt)


def deduplicate(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, **options) -> DataFrame:
    """One row per row of the input: vec_id, n_links, component_id, kept.

    Null and zero vectors, and vectors with null or non-finite components, link with nothing; nor do vectors of
    different lengths with one another. Equal vectors are all linked; they take part once. A row with a null id has null
    as its component and isn't kept, and its vector counts as a link of others only through equal vectors with an id. An
    empty table gives an empty result.
    """
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    table = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("vec").isNotNull() & ~odd & F.exists("vec", lambda x: x != 0)
    table = materialize(table.select("vec_id", F.when(fine, F.col("vec")).alias("vec"), F.xxhash64("vec").alias("hash")), "vectors")
    v = materialize(table.where("vec IS NOT NULL").groupBy("hash", "vec").agg(F.min("vec_id").alias("u"), F.count(F.lit(1)).alias("times")).where("u IS NOT NULL"), "distinct")
    lists = neighbours(v.select("u", "vec"), threshold, **options)
    links = materialize(plain_links(lists, threshold), "links")
    marked = v.select("u", "times", "vec").join(lists.select("u", "dense"), "u").select("u", "times", "dense", "vec")
    counted = dense_links(marked, threshold)
    parts = components(links.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(counted.where("to IS NOT NULL").select(F.col("u").alias("a"), F.col("to").alias("b"))))
    listed = links.join(v.select(F.col("u").alias("v"), "times"), "v").select("u", F.col("times").alias("n"))
    beside = listed.unionByName(counted.where("n IS NOT NULL").select("u", "n")).groupBy("u").agg(F.sum("n").alias("beside"))
    known = v.join(beside, "u", "left").join(parts, F.col("u") == F.col("node"), "left").select(
        "hash", "vec", (F.coalesce("beside", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "u").alias("component_id")
    )
    alone = F.col("n_links").isNull()
    return (
        table.join(known, ["hash", "vec"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
