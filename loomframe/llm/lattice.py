"""Lattices of subword pieces over many short strings at once.

A Vocabulary is a trie over the pieces of an existing tokenizer. A Lattice holds, for a batch of strings, every way to
cut them into pieces, as arcs grouped by their length in characters. Strings are laid out by position first and by
string second (longest strings first), so that one array operation advances all strings by one place, and sums over
segmentations run in log space.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SPACE = "▁"
#: Stands for a space mark that a text itself holds: a surrogate, so no character of any text.
MARK = 0xD800
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTE = re.compile(r"<0x([0-9A-F]{2})>$")


class Vocabulary:
    """pieces: strings by id. Byte pieces (<0x00> to <0xFF>) stand for characters that are no piece themselves; control
    pieces never match."""

    def __init__(self, pieces: list[str], controls: frozenset[int]):
        self.pieces = pieces
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        self.bytes_by_id: dict[int, int] = {}
        self.longest = 1
        children: list[dict[str, int]] = [{}]
        ids = [-1]
        for i, piece in enumerate(pieces):
            byte = _BYTE.match(piece)
            if byte:
                self.byte_ids[int(byte[1], 16)] = i
                self.bytes_by_id[i] = int(byte[1], 16)
            elif i not in controls and piece:
                node = 0
                for c in piece:
                    if c not in children[node]:
                        children[node][c] = len(children)
                        children.append({})
                        ids.append(-1)
                    node = children[node][c]
                ids[node] = i
                self.longest = max(self.longest, len(piece))
        #: What each piece stands for in UTF-8; a byte piece is one byte of it.
        self.utf8 = pa.array([bytes([self.bytes_by_id[i]]) if i in self.bytes_by_id else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(pieces)], pa.binary())
        self.piece_at = np.array(ids, dtype=np.int32)
        self.first = np.full(0x110000, -1, dtype=np.int32)
        for c, node in children[0].items():
            self.first[ord(c)] = node
        edges = [(node << 21 | ord(c), child) for node, own in enumerate(children) if node for c, child in own.items()]
        self._bits = max(10, (4 * len(edges)).bit_length())
        self._keys = np.full(1 << self._bits, _EMPTY, dtype=np.uint64)
        self._children = np.full(1 << self._bits, -1, dtype=np.int32)
        mask = (1 << self._bits) - 1
        for key, child in edges:
            slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self._bits)
            while self._keys[slot] != _EMPTY:
                slot = (slot + 1) & mask
            self._keys[slot], self._children[slot] = key, child

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes one character further down, -1 where there is none."""
        key = (node.astype(np.uint64) << np.uint64(21)) | char.astype(np.uint64)
        with np.errstate(over="ignore"):
            slot = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)
        there = self._keys[slot]
        out = np.where(there == key, self._children[slot], -1)
        open_ = np.flatnonzero((there != key) & (there != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self._bits) - 1)
            there = self._keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self._children[slot[open_[hit]]]
            open_ = open_[~hit & (there != _EMPTY)]
        return out

    def spelled(self, char: int) -> list[int]:
        """The byte pieces of a character."""
        return self.byte_ids[list((SPACE if char == MARK else chr(char)).encode("utf-8", "surrogatepass"))].tolist()

    def byte_weights(self, chars: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Summed weights of the byte pieces of characters."""
        kinds, at = np.unique(chars, return_inverse=True)
        sums = np.array([weights[self.spelled(int(c))].sum() for c in kinds])
        return sums[at] if len(kinds) else np.zeros(0)


@lru_cache(2)
def vocabulary(pieces: tuple[str, ...], controls: frozenset[int]) -> Vocabulary:
    return Vocabulary(list(pieces), controls)


def read_model(path: str) -> tuple[tuple[str, ...], frozenset[int], np.ndarray]:
    """Pieces, ids of control pieces, scores of a SentencePiece model file. Read on the driver only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    controls = frozenset(i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    return tuple(model.id_to_piece(i) for i in range(n)), controls, np.array([model.get_score(i) for i in range(n)])


def zipf_weights(scores: np.ndarray, controls: frozenset[int]) -> np.ndarray:
    """Log weights from merge scores (minus the rank of the merge; byte pieces have none and rank last): 1 / (rank + 20),
    normalised."""
    rank = np.where(scores < 0, -scores, 0.0)
    usual = rank < 1e8
    rank[~usual] = rank[usual].max(initial=1.0)
    rank[scores == 0] = rank.max(initial=1.0)
    weights = 1.0 / (rank + 20.0)
    weights[list(controls)] = 0.0
    with np.errstate(divide="ignore"):
        return np.log(weights / weights.sum())


def ship(spark: SparkSession, path: str):
    """A broadcast of the vocabulary: its size is that of the tokenizer, whatever the data."""
    pieces, controls, scores = read_model(path)
    return spark.sparkContext.broadcast((pieces, controls, zipf_weights(scores, controls)))


class Lattice:
    """Lattice over units (strings of at least one character).

    order: unit numbers by falling length; rank: a unit's place in it. A node (s, rank) stands between the characters
    s - 1 and s of a unit and has the number offset[s] + rank. arcs[k]: (from, to, piece) of the arcs of k + 1
    characters, by rising `from`; a piece below 0 is the character -1 - piece in bytes. weights: per arc.
    """

    def __init__(self, units: list[str], vocab: Vocabulary, weights: np.ndarray):
        self.vocab = vocab
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        most = int(self.lengths[0]) if len(units) else 0
        self.rank = np.empty(len(units), dtype=np.int64)
        self.rank[self.order] = np.arange(len(units))
        # units with at least s characters
        self.having = np.searchsorted(-self.lengths, -np.arange(most + 2), side="right")
        self.offset = np.concatenate([[0], np.cumsum(self.having[: most + 1])])
        self.nodes = int(self.offset[most + 1]) if len(units) else 0
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begin = (np.cumsum(lengths) - lengths)[self.order]
        self.char = np.zeros(self.nodes, dtype=np.uint32)
        step = np.zeros(self.nodes, dtype=np.int32)
        for s in range(most):
            n = self.having[s + 1]
            self.char[self.offset[s] : self.offset[s] + n] = flat[begin[:n] + s]
            step[self.offset[s] : self.offset[s + 1]] = s
        if most:
            step[self.offset[most] :] = most
        self.step = step
        rank_of = np.arange(self.nodes, dtype=np.int64) - self.offset[step] if self.nodes else np.zeros(0, dtype=np.int64)
        self.rank_of = rank_of
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.weights: list[np.ndarray] = []
        left = self.lengths[rank_of] - step if self.nodes else np.zeros(0, dtype=np.int64)
        #: the node one character further
        after = self.offset[step + 1] + rank_of if self.nodes else rank_of
        at = here = np.flatnonzero(left > 0)
        left = left[at]
        node = vocab.first[self.char[at]]
        single = np.zeros(self.nodes, dtype=bool)
        for k in range(vocab.longest):
            if k:
                inside = np.flatnonzero((node >= 0) & (left > k))
                at, node, left, here = at[inside], node[inside], left[inside], after[here[inside]]
                node = vocab.step(node, self.char[here])
            if not (node >= 0).any():
                break
            hit = np.flatnonzero((node >= 0) & (vocab.piece_at[node] >= 0))
            start, piece = at[hit], vocab.piece_at[node[hit]].astype(np.int64)
            end, w = after[here[hit]], weights[piece]
            if not k:
                single[start] = True
                rest = at[~single[at]]
                if len(rest):
                    chars = self.char[rest].astype(np.int64)
                    start, piece, w = np.concatenate([start, rest]), np.concatenate([piece, -1 - chars]), np.concatenate([w, vocab.byte_weights(chars, weights)])
                    by = np.argsort(start, kind="stable")
                    start, piece, w = start[by], piece[by], w[by]
                    end = after[start]
            self.arcs.append((start, end, piece))
            self.weights.append(w)
        if not self.arcs and self.nodes:  # no character is a piece
            rest = np.flatnonzero(self.lengths[rank_of] > step)
            chars = self.char[rest].astype(np.int64)
            self.arcs.append((rest, self.offset[step[rest] + 1] + rank_of[rest], -1 - chars))
            self.weights.append(vocab.byte_weights(chars, weights))
        self.bounds = [np.searchsorted(a[0], self.offset).tolist() for a in self.arcs]
        self.most = most

    def weigh(self, weights: np.ndarray) -> None:
        """Give the arcs other weights."""
        for (_, _, piece), w in zip(self.arcs, self.weights, strict=True):
            known = piece >= 0
            w[known] = weights[piece[known]]
            w[~known] = self.vocab.byte_weights(-1 - piece[~known], weights)

    def forward(self) -> np.ndarray:
        """Log of the summed weights of all ways from the start of a unit to a node."""
        out = np.full(self.nodes, -np.inf)
        if self.nodes:
            out[: self.having[0]] = 0.0
        for s in range(self.most):
            for (start, end, _), w, b in zip(self.arcs, self.weights, self.bounds, strict=True):
                if b[s] < b[s + 1]:
                    own = slice(b[s], b[s + 1])
                    out[end[own]] = np.logaddexp(out[end[own]], out[start[own]] + w[own])
        return out

    def backward(self) -> np.ndarray:
        """Log of the summed weights of all ways from a node to the end of its unit."""
        out = np.full(self.nodes, -np.inf)
        if self.nodes:
            out[self.lengths[self.rank_of] == self.step] = 0.0
        for s in range(self.most - 1, -1, -1):
            for (start, end, _), w, b in zip(self.arcs, self.weights, self.bounds, strict=True):
                if b[s] < b[s + 1]:
                    own = slice(b[s], b[s + 1])
                    out[start[own]] = np.logaddexp(out[start[own]], w[own] + out[end[own]])
        return out

    def totals(self, forward: np.ndarray) -> np.ndarray:
        """Per unit, in the order given: the log of the summed weights of its segmentations."""
        ends = self.offset[self.lengths] + np.arange(len(self.lengths)) if len(self.lengths) else np.zeros(0, dtype=np.int64)
        return forward[ends][self.rank]

    def expected(self, times: np.ndarray, pieces: int) -> np.ndarray:
        """Expected number of uses of each piece when unit i occurs times[i] times."""
        alpha, beta = self.forward(), self.backward()
        total, times = beta[: len(self.lengths)], times[self.order].astype(np.float64)
        out = np.zeros(pieces)
        for (start, end, piece), w in zip(self.arcs, self.weights, strict=True):
            unit = self.rank_of[start]
            n = np.exp(alpha[start] + w + beta[end] - total[unit]) * times[unit]
            known = piece >= 0
            out += np.bincount(piece[known], weights=n[known], minlength=pieces)
            chars, at = np.unique(-1 - piece[~known], return_inverse=True)
            for c, m in zip(chars.tolist(), np.bincount(at, weights=n[~known], minlength=len(chars)), strict=True):
                np.add.at(out, self.vocab.spelled(c), m)
        return out
