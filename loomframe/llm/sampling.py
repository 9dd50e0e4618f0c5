"""SentencePiece encoding and decoding by sampled segmentations, Gumbel top-k without replacement.

All segmentations of a text form a lattice. Adding a Gumbel variate to every segmentation's log probability and taking
the k greatest sums draws k of them without replacement. The search is best-first (A*) over sets of segmentations that
share a beginning: the greatest perturbed sum inside a set is drawn top down from the set's total probability, known
exactly from the backward sums of the lattice, so the set with the greatest bound always holds the next result. Taking
it splits the set into the result and one set per place where another segmentation may leave it.

A lattice splits into independent ones where no piece can reach across: before a run of white space and around line
breaks. Those units recur, so their lattices are built once and kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import chunks, mixed, mixed_one, uniforms
from loomframe.llm.lattice import MARK, SPACE, Lattice, ship, vocabulary

UNIT = re.compile(r"▁*[^▁\n]+|▁+|\n")
SAMPLES = "sample int, pieces array<int>, logp double, perturbed double, inclusion double"


def units_of(text: str) -> list[str]:
    """The units of a text in the tokenizer's own form: a space in front, spaces as the space mark. A space mark that the
    text itself holds becomes a code point that no text can hold, and is spelled in bytes."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, chr(MARK))
    if "  " in text or text[0] == " ":
        return UNIT.findall((SPACE + text).replace(" ", SPACE))
    # the same for single spaces
    return list(filter(None, (SPACE + text).replace(" ", " " + SPACE).replace("\n", " \n ").split(" ")))


class Units:
    """Arcs with their conditional probabilities for a growing set of units.

    Per state (a place inside a unit): its first arc, the likeliest first; per arc: cumulated probability given the
    state, the logs of its own and of what it leaves to the others, next state (-1: the unit ends), piece. `root` is the
    first state of each unit. From `most_arcs` on, units not met before are kept for one call only; by then all frequent
    ones are there.
    """

    def __init__(self, vocab, weights: np.ndarray, most_arcs: int = 250_000):
        self.vocab, self.weights, self.most_arcs = vocab, weights, most_arcs
        self.at: dict[str, int] = {}
        self.sizes = {"root": 0, "first": 1, "upto": 0, "log": 0, "rest": 0, "next": 0, "piece": 0}
        kinds = {"root": np.int64, "first": np.int64, "upto": np.float64, "log": np.float64, "rest": np.float64, "next": np.int32, "piece": np.int32}
        for name, kind in kinds.items():
            setattr(self, name, np.zeros(1024, dtype=kind))
        self._kept: dict[str, int] | None = None

    def _append(self, name: str, values: np.ndarray) -> None:
        old, n = getattr(self, name), self.sizes[name]
        if n + len(values) > len(old):
            new = np.zeros(max(len(old) * 3 // 2, n + len(values)), dtype=old.dtype)
            new[:n] = old[:n]
            setattr(self, name, new)
            old = new
        old[n : n + len(values)] = values
        self.sizes[name] = n + len(values)

    def numbers(self, texts: list[list[str]]) -> np.ndarray:
        """The numbers of all units of the texts, end to end. Those not met before are added."""
        if self._kept is not None:
            self.sizes = dict(self._kept)
        elif self.sizes["log"] > self.most_arcs:
            self._kept = dict(self.sizes)
        flat = list(chain.from_iterable(texts))
        got = np.fromiter(map(self.at.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        open_ = np.flatnonzero(got < 0)
        if len(open_):
            missing = [flat[i] for i in open_.tolist()]
            first, at = len(self.at), dict.fromkeys(missing)
            new = list(at)
            at = dict(zip(new, range(first, first + len(new)), strict=True))
            self._add(new)
            if self._kept is None:
                self.at |= at
            got[open_] = list(map(at.__getitem__, missing))
        return got

    def _add(self, new: list[str]) -> None:
        lattice = Lattice(new, self.vocab, self.weights)
        beta = lattice.backward()
        start, end, piece = (np.concatenate([a[i] for a in lattice.arcs]) for i in range(3))
        p = np.exp(np.concatenate(lattice.weights) + beta[end] - beta[start])
        by = np.argsort(start + 0.9 * (1.0 - np.minimum(p, 1.0)), kind="stable")
        start, end, piece, p = start[by], end[by], piece[by], p[by]
        inner = lattice.lengths[lattice.rank_of] > lattice.step
        state = np.cumsum(inner) - 1 + (self.sizes["first"] - 1)
        firsts = np.flatnonzero(np.append(True, start[1:] != start[:-1]))
        total = np.cumsum(p)
        before = (total - p)[firsts]
        lasts = np.append(firsts[1:], len(start)) - 1
        counts = lasts - firsts + 1
        share = np.repeat(total[lasts] - before, counts)
        upto = (total - np.repeat(before, counts)) / share
        upto[lasts] = 1.0
        base = self.sizes["log"]
        self._append("root", state[lattice.rank])
        self.sizes["first"] -= 1
        self._append("first", np.append(firsts, len(start)) + base)
        self._append("upto", upto)
        own = np.minimum(p / share, 1.0)
        with np.errstate(divide="ignore"):
            self._append("log", np.log(own))
            self._append("rest", np.where(own >= 1.0 - 1e-15, -np.inf, np.log1p(-own)))
        self._append("next", np.where(inner[end], state[end], -1))
        self._append("piece", piece.astype(np.int32))

    def walk(self, state: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw arcs from every state to the end of its unit. Returns the arcs, those of one start together and in order,
        and how many each start has. key: the source of randomness of each start."""
        who, arcs, starts = np.arange(len(state)), [], []
        n = np.zeros(len(state), dtype=np.int64)
        turn = 0
        state, key = state.copy(), key.copy()
        live = np.flatnonzero(state >= 0)
        who, state, key = who[live], state[live], key[live]
        while len(who):
            arc = self.first[state]
            u = uniforms(key + np.uint64(turn))
            far = np.flatnonzero(u > self.upto[arc])
            while len(far):
                arc[far] += 1
                far = far[u[far] > self.upto[arc[far]]]
            arcs.append(arc)
            starts.append(who)
            n[who] += 1
            state = self.next[arc]
            live = state >= 0
            who, state, key = who[live], state[live], key[live]
            turn += 1
        out = np.zeros(int(n.sum()), dtype=np.int64)
        offset = np.cumsum(n) - n
        for step, (who, arc) in enumerate(zip(starts, arcs, strict=True)):
            out[offset[who] + step] = arc
        return out, n


def truncated(location: np.ndarray, most: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variates around location, given that they are at most `most`."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return location - np.log(np.exp(np.minimum(location - most, 700.0)) - np.log(u))


class _Search:
    """The search over one text. `path` holds the arcs of one result, `unit` the unit of each arc."""

    def __init__(self, units: Units, numbers: np.ndarray, key: np.uint64):
        self.units, self.numbers, self.key = units, numbers, key
        # sets of segmentations that leave a result at a place: its path, the place, the arcs ruled out, log mass before it
        self.sets: list[tuple] = []
        self.results: list[tuple[np.ndarray, float, float]] = []

    def counters(self, salt: int, n: int) -> np.ndarray:
        """Numbers of the text's own for n draws."""
        return np.uint64(mixed_one(int(self.key) + salt)) + np.arange(n, dtype=np.uint64)

    def leave(self) -> tuple[int, int, float] | None:
        """The set with the greatest bound: number of the result it leaves, place, bound."""
        best = None
        for i, (bounds, *_) in enumerate(self.sets):
            if len(bounds):
                at = int(bounds.argmax())
                if bounds[at] > -np.inf and (best is None or bounds[at] > best[2]):
                    best = (i, at, float(bounds[at]))
        return best

    def turn(self, which: int, at: int, bound: float, nth: int) -> tuple[np.ndarray, int]:
        """Draw the arc by which the next result leaves; the set keeps what other arcs there are. Returns the arcs so far
        and the last one's unit."""
        bounds, path, unit, before, ruled = self.sets[which]
        out = ruled.setdefault(at, [int(path[at])])
        state_arcs = self._siblings(int(path[at]))
        open_ = [a for a in state_arcs if a not in out]
        p = np.exp(self.units.log[open_])
        u = uniforms(self.counters(4 * nth + 2, 2))
        arc = open_[min(len(open_) - 1, int(np.searchsorted(np.cumsum(p) / p.sum(), u[0])))]
        out.append(arc)
        left = [a for a in open_ if a != arc]
        mass = float(np.exp(self.units.log[left]).sum()) if left else 0.0
        bounds[at] = float(truncated(np.array([before[at] + np.log(mass)]), bound, u[1:])[0]) if mass > 0 else -np.inf
        return np.append(path[:at], arc), int(unit[at])

    def _siblings(self, arc: int) -> list[int]:
        state = int(np.searchsorted(self.units.first[: self.units.sizes["first"]], arc, side="right")) - 1
        return list(range(int(self.units.first[state]), int(self.units.first[state + 1])))


def places(ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each element's place in its part, for parts of these lengths that end there."""
    return (np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype(np.uint64)


def accept(units: Units, found: list[tuple[_Search, np.ndarray, np.ndarray, int, float]], nth: int) -> None:
    """New results, of one text each: its search, path, unit, the place from which on sets leave it, bound."""
    lengths = np.array([len(path) for _, path, *_ in found])
    ends = np.cumsum(lengths)
    paths = np.concatenate([path for _, path, *_ in found])
    log, rest = units.log[paths], units.rest[paths]
    before = np.empty(len(paths))
    spans = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
    for (i, j), (_, _, _, fixed, _) in zip(spans, found, strict=True):
        np.cumsum(log[i:j], out=before[i:j])
        rest[i : i + fixed] = -np.inf
    before -= log
    rest += before
    at = np.flatnonzero(rest > -np.inf)
    first = np.array([mixed_one(int(s.key) + 4 * nth + 1) for s, *_ in found], dtype=np.uint64)
    with np.errstate(over="ignore"):
        counters = (np.repeat(first, lengths) + places(ends, lengths))[at]
    bounds = np.full(len(paths), -np.inf)
    bounds[at] = truncated(rest[at], np.repeat([bound for *_, bound in found], lengths)[at], uniforms(counters))
    for (i, j), (s, path, unit, _, bound) in zip(spans, found, strict=True):
        s.results.append((path, float(log[i:j].sum()), bound))
        s.sets.append([bounds[i:j], path, unit, before[i:j], {}])


def sample(units: Units, texts: list[list[str]], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to k different segmentations, the greatest perturbed log probability first: piece numbers (below 0: a
    character in bytes), log probability, perturbed log probability, and the probability that the segmentation is among
    the first k, given the bound of what is left (1 if nothing is)."""
    numbers = units.numbers(texts)
    ends = np.cumsum([len(t) for t in texts])
    searches = [_Search(units, own, key) for own, key in zip(np.split(numbers, ends[:-1]) if len(texts) else [], keys, strict=True)]
    none = np.zeros(0, dtype=np.int64)
    tops = -np.log(-np.log(uniforms(np.array([mixed_one(int(s.key)) for s in searches], dtype=np.uint64))))
    heads = [(none, none, -1, 0, top) for top in tops.tolist()]
    for nth in range(k):
        # where each text's next result goes on by free choice: inside the unit it has left, then at the units after it
        states, seeds, spans = [], [], []  # seeds: of the first draw
        for s, head in zip(searches, heads, strict=True):
            if head is None:
                spans.append(0)
                continue
            path, _, unit, _, _ = head
            first = units.next[path[-1]] if len(path) else -1
            own = np.append(first, units.root[s.numbers[unit + 1 :]])
            states.append(own)
            seeds.append(mixed_one(int(s.key) + 4 * nth + 3) + len(s.numbers) + 1 - len(own) & 0xFFFFFFFFFFFFFFFF)
            spans.append(len(own))
        if not states:
            break
        lengths = np.array([n for n in spans if n])
        with np.errstate(over="ignore"):
            counters = np.repeat(np.array(seeds, dtype=np.uint64), lengths) + places(np.cumsum(lengths), lengths)
        arcs, counts = units.walk(np.concatenate(states), mixed(counters) << np.uint64(12))  # a draw takes many steps
        upto, at, done, found = np.cumsum(counts), 0, 0, []
        for s, head, n in zip(searches, heads, spans, strict=True):
            if head is None:
                continue
            path, where, unit, fixed, bound = head
            stop = int(upto[at + n - 1])
            tail = arcs[done:stop]
            tail_unit = np.repeat(np.arange(unit, unit + n), counts[at : at + n])
            found.append((s, np.concatenate([path, tail]), np.concatenate([where, tail_unit]), fixed, bound))
            at, done = at + n, stop
        accept(units, found, nth)
        for i, (s, head) in enumerate(zip(searches, heads, strict=True)):
            heads[i] = None
            best = s.leave() if head is not None and nth + 1 < k else None
            if best is not None:
                which, place, bound = best
                unit_before = s.sets[which][2][:place]
                path, unit = s.turn(which, place, bound, nth)
                heads[i] = (path, np.append(unit_before, unit), unit, place + 1, bound)
    out = []
    for s in searches:
        best = s.leave()
        threshold = best[2] if best else -np.inf
        own = []
        for path, logp, perturbed in s.results:
            inclusion = 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(700.0, logp - threshold))))
            own.append((units.piece[path], logp, perturbed, inclusion))
        out.append(own)
    return out


def spell(vocab, pieces: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of texts that end at `ends`, with characters below 0 spelled in byte pieces, and where they end then."""
    odd = np.flatnonzero(pieces < 0)
    if not len(odd):
        return pieces, ends
    kinds, which = np.unique(-1 - pieces[odd], return_inverse=True)
    spelled = [vocab.spelled(c) for c in kinds.tolist()]
    lengths = np.array([len(s) for s in spelled])[which]
    times = np.ones(len(pieces), dtype=np.int64)
    times[odd] = lengths
    after = np.append(0, np.cumsum(times))
    out = np.repeat(pieces, times)
    table = np.array([s + [0] * (4 - len(s)) for s in spelled], dtype=out.dtype)
    for k in range(4):
        own = np.flatnonzero(lengths > k)
        out[after[odd[own]] + k] = table[which[own], k]
    return out, after[ends]


def decode(vocab, ids: pa.Array, ends: np.ndarray) -> list[str]:
    """The texts of piece ids that lie between `ends`, with the space that encoding puts in front taken off."""
    if not len(ids):
        return [""] * (len(ends) - 1)
    joined = vocab.utf8.take(ids)
    at = np.frombuffer(joined.buffers()[1], dtype=np.int32)[ends].tolist()
    data = memoryview(joined.buffers()[2])
    return [str(data[i:j], "utf-8", "surrogatepass")[1:] for i, j in zip(at[:-1], at[1:], strict=True)]


@lru_cache(1)
def _units(names: tuple[str, ...], controls: frozenset[int], weights: bytes) -> Units:
    """Kept by a worker from task to task; its size is bounded, and results don't depend on what it holds."""
    return Units(vocabulary(names, controls), np.frombuffer(weights))


def _encode(shipped, k: int, seed: int, most_bytes: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, controls, weights = shipped.value
        vocab, units = vocabulary(names, controls), _units(names, controls, weights.tobytes())
        with np.errstate(over="ignore"):
            salt = mixed(np.array([seed], dtype=np.uint64))
        for big in batches:
            for b in chunks(big, 1, most_bytes):
                texts = [t or "" for t in b.column(1).to_pylist()]
                keys = mixed(b.column(0).to_numpy().view(np.uint64) ^ salt)
                rows, nth, ids, ends, logp, perturbed, inclusion = [], [], [], [0], [], [], []
                for i, own in enumerate(sample(units, [units_of(t) for t in texts], keys, k)):
                    for j, (pieces, lp, g, q) in enumerate(own):
                        ids.append(pieces)
                        ends.append(ends[-1] + len(pieces))
                        rows.append(i)
                        nth.append(j)
                        logp.append(lp)
                        perturbed.append(g)
                        inclusion.append(q)
                flat, ends = spell(vocab, np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, dtype=np.int32), np.array(ends))
                picked = b.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns[1:], pa.array(nth, pa.int32()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)), *(pa.array(x, pa.float64()) for x in (logp, perturbed, inclusion))],
                    names=[*b.schema.names[1:], "sample", "pieces", "logp", "perturbed", "inclusion"],
                )

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.xxhash64(F.col(id_col).cast("long")), F.lit(0)).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))


def encode(docs: DataFrame, model_path: str, k: int = 2, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, keep_text: bool = False) -> DataFrame:
    """Up to k sampled segmentations of each text: doc_id, (text,) sample (0 for the greatest perturbed log probability),
    pieces (ids), logp, perturbed, inclusion.

    Files of merges hold ranks and no unigram scores. Of such a file a piece weighs 1 / (rank + 20), normalised: these are
    not probabilities that the vocabulary was made with, and logp and inclusion are by them.

    Randomness comes from the seed and the row's id alone (a null id counts as 0, repeated rows are sampled alike), so
    results don't depend on partitions. A null or empty text has one segmentation, of no pieces; a text with fewer than k
    has fewer rows. An empty table gives an empty result. Other columns of the input are not read.
    """
    encoded, keep = _encode(ship(docs.sparkSession, model_path), k, seed), keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in encoded(batches):
            yield b if keep else b.drop_columns(["text"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, ("text string, " if keep else "") + f"doc_id long, {SAMPLES}")


def _verify(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, controls, _ = shipped.value
        vocab = vocabulary(names, controls)
        for big in batches:
            for b in chunks(big, 0, 1_000_000):
                pieces, ends = b.column(3).values, b.column(3).offsets.to_numpy()
                flat = pieces.to_numpy().astype("<i4", copy=False)
                decoded = decode(vocab, pieces, ends)
                hashed = [hashlib.sha256(flat[i:j].tobytes()).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                texts = [t or "" for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(hashed), pa.array([x == t for x, t in zip(decoded, texts, strict=True)]), b.column(2), *b.columns[4:]],
                    names=["doc_id", "n_pieces", "pieces_sha256", "exact", "sample", *b.schema.names[4:]],
                )

    return run


def round_trip(docs: DataFrame, model_path: str, k: int = 2, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """Encode and decode again: per document and sample, doc_id, n_pieces, pieces_sha256 (of 32-bit little-endian ids),
    exact (the decoded text is the original), sample, logp, perturbed, inclusion. Both steps run in one worker, so that
    neither texts nor pieces go back and forth."""
    shipped = ship(docs.sparkSession, model_path)
    encoded, verified = _encode(shipped, k, seed), _verify(shipped)
    return _keyed(docs, id_col, text_col).mapInArrow(lambda batches: verified(encoded(batches)), "doc_id long, n_pieces long, pieces_sha256 string, exact boolean, sample int, logp double, perturbed double, inclusion double")
