"""Language-model scores by subword lattice likelihood.

Every word is scored by the summed probability of all its segmentations into the pieces of an existing vocabulary, by
log-space forward recursion; a text's probability is the product over its words and one end. The scores of the pieces are
the vocabulary's own, adapted to the training texts by some steps of expectation maximisation over all segmentations. Of a
file of merges, which has ranks and no probabilities, the own score of a piece is the logarithm of 1 / (rank + 20),
normalised.

Beside that stand the same sums under the vocabulary's own scores alone, those of a lattice in which a word seen in
training has one more arc, the word as a whole, weighed by its count less an absolute discount, and a word frequency model
with additive smoothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import chunks, folded_words_of, id_remainder, materialize
from loomframe.llm.lattice import SPACE, Lattice, ship, vocabulary

LOG10 = float(np.log(10.0))
#: Stands for the end of a text in the table of words; no word is empty.
END = b""
SCORES = ("logp", "plain", "joint")


def _count(most: int = 300_000, most_bytes: int = 50_000_000):
    """(learn, text) to (word, n, seen): occurrences in training texts, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, other = Counter(), Counter()
        read = 0

        def flush() -> pa.RecordBatch:
            words = [*learned, *(w for w in other if w not in learned)]
            n = np.fromiter(map(learned.get, words, repeat(0)), dtype=np.int64, count=len(words))
            seen = n + np.fromiter(map(other.get, words, repeat(0)), dtype=np.int64, count=len(words))
            learned.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n), pa.array(seen)], ["word", "n", "seen"])

        for batch in batches:
            for b in chunks(batch, 1):
                for learn, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    into = learned if learn else other
                    into.update(folded_words_of(text))
                    into[END] += 1
                    read += len(text or "")
                    if len(learned) + len(other) > most or (read > most_bytes and len(learned) + len(other) > most // 10):
                        yield flush()
                        read = 0
        yield flush()

    return run


def _groups(words: list[bytes], most: int = 200_000):
    """Ranges of the list with about `most` bytes each."""
    start = total = 0
    for i, w in enumerate(words):
        total += len(w)
        if total > most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(words):
        yield start, len(words)


def _units(words: list[bytes]) -> list[str]:
    return [SPACE + w.decode("utf-8", "surrogatepass") for w in words]


class LatticeModel:
    """weights: log probability of each piece; tokens, kinds, discount: N, V and D of the words learned from, which give a
    word w of count c, where it has an arc of its own, max(c - D, 0) / N + D * V / N * (sum over its segmentations)."""

    def __init__(self, shipped, weights: np.ndarray, tokens: int, kinds: int, discount: float):
        self.shipped, self.weights, self.tokens, self.kinds, self.discount = shipped, weights, tokens, kinds, discount

    @staticmethod
    def fit(words: DataFrame, model_path: str, rounds: int = 3, extra: float = 0.05) -> LatticeModel:
        """From the table of words (word, n): `rounds` steps of expectation maximisation over all words of the training
        texts, each counting as often as it occurs. What reaches the driver has one number per piece."""
        spark = words.sparkSession
        shipped = ship(spark, model_path)
        pieces, controls, weights = shipped.value
        usable = np.ones(len(pieces), dtype=bool)
        usable[list(controls)] = False
        learned = words.where("n > 0")
        size = learned.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
        discount = min(0.95, max(0.1, size.once / (size.once + 2 * size.twice))) if size.once else 0.5
        for _ in range(rounds if size.n else 0):
            now = spark.sparkContext.broadcast(weights)

            def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
                names, no_match, _ = shipped.value
                out = np.zeros(len(names))
                for b in batches:
                    listed = b.column(0).to_pylist()
                    times = b.column(1).to_numpy() * np.array([w != END for w in listed], dtype=np.int64)
                    for i, j in _groups(listed):
                        own = [k for k in range(i, j) if times[k]]
                        if own:
                            out += Lattice(_units([listed[k] for k in own]), vocabulary(names, no_match), now.value).expected(times[own], len(names))
                used = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(out[used])], ["piece", "n"])

            uses = np.where(usable, extra, 0.0)
            for r in learned.select("word", "n").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
                uses[r.piece] += r.n
            with np.errstate(divide="ignore"):
                weights = np.log(uses / uses.sum())
        return LatticeModel(shipped, weights, int(size.n), int(size.v), discount)

    def joined(self, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Log probabilities of words from their counts and the summed log weights of their segmentations."""
        if not self.tokens:
            return totals
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(counts - self.discount, 0.0) / self.tokens), np.log(self.discount * self.kinds / self.tokens) + totals)

    def end(self, count: int) -> float:
        """Log probability of the end of a text."""
        return float(np.log((count - self.discount if count else 0.1) / max(1, self.tokens)))

    def scored(self, words: DataFrame) -> DataFrame:
        """words (word, n, seen) with log10 of the word's probability: by all segmentations (logp), by all under the
        vocabulary's own scores (plain), and with an arc for words seen in training (joint). The end has 0."""
        shipped, now = self.shipped, words.sparkSession.sparkContext.broadcast(self.weights)
        rest = (self.tokens, self.kinds, self.discount)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, no_match, own_scores = shipped.value
            vocab, own_model = vocabulary(names, no_match), LatticeModel(None, now.value, *rest)
            for b in batches:
                listed, n = b.column(0).to_pylist(), b.column(1).to_numpy()
                out = np.zeros((3, len(listed)))
                for i, j in _groups(listed):
                    own = [k for k in range(i, j) if listed[k] != END]
                    if own:
                        lattice = Lattice(_units([listed[k] for k in own]), vocab, now.value)
                        out[0, own] = lattice.totals(lattice.forward())
                        out[2, own] = own_model.joined(n[own], out[0, own])
                        lattice.weigh(own_scores)
                        out[1, own] = lattice.totals(lattice.forward())
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x / LOG10) for x in out)], names=[*b.schema.names, *SCORES])

        return words.mapInArrow(run, "word binary, n long, seen long, logp double, plain double, joint double")


def _look_up(usual):
    """(row, doc_id, held_out, text) to what the usual words of each text add up to, and its other words with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = usual.value
        find = {w: i for i, w in enumerate(words)}.get
        for big in batches:
            for b in chunks(big, 3, 2_000_000):
                n_words, sums, rare, times, ends = [], np.zeros((b.num_rows, len(NUMBERS))), [], [], [0]
                for i, text in enumerate(b.column(3).to_pylist()):
                    own = folded_words_of(text)
                    at = np.fromiter(map(find, own, repeat(-1)), dtype=np.int64, count=len(own))
                    n_words.append(len(own))
                    sums[i] = numbers[:, at[at >= 0]].sum(axis=1)
                    others = Counter([own[i] for i in np.flatnonzero(at < 0).tolist()])
                    rare += others
                    times += others.values()
                    ends.append(len(rare))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((rare, pa.binary()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array(n_words, pa.int64()), *(pa.array(x) for x in sums.T.copy()), *lists],
                    ["row", "doc_id", "held_out", "n_words", *NUMBERS, "words", "times"],
                )

    return run


#: What is added up over the words of a text.
NUMBERS = ("base", "known", *SCORES)
LOOKED_UP = f"row long, doc_id long, held_out boolean, n_words long, {', '.join(f'{x} double' for x in NUMBERS)}, words array<binary>, times array<long>"


def score(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", most_usual: int = 100_000, most_bytes: int = 8_000_000, rounds: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (all segmentations,
    scores adapted to the training texts), vocabulary_score (all segmentations, the vocabulary's own scores) and word_score
    (a word seen in training is an arc of its own).

    Learned from the rows whose id's crc32 leaves a remainder other than 0 by 10; a null id is neither learned from nor
    held out. Null and empty texts hold the end alone. Repeated rows count each time. An empty table gives an empty
    result. Words that occur often (most_usual of them and most_bytes at most, chosen by a histogram of frequencies) are
    broadcast with their counts and scores; all others, each of them below that frequency, are joined.
    """
    spark = docs.sparkSession
    remainder = id_remainder(id_col, 10)
    text = F.col(text_col).cast("string").alias("text")
    counted = docs.select(F.coalesce(remainder != 0, F.lit(False)).alias("learn"), text).mapInArrow(_count(), "word binary, n long, seen long")
    words = materialize(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "words")
    model = LatticeModel.fit(words, model_path, rounds)
    words = materialize(model.scored(words).withColumns({"base": F.log10(F.col("n") + 0.1), "known": (F.col("n") > 0).cast("double")}), "scored")
    level = F.floor(F.log2("seen") * 8)
    cut, total, size = None, 0, 0
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("word")).alias("size")).collect(), key=lambda r: -r.level):
        total, size = total + r.k, size + r["size"]
        if total > most_usual or size > most_bytes:
            break
        cut = r.level
    often = words.where(level >= cut if cut is not None else F.lit(False)).toArrow()
    usual = spark.sparkContext.broadcast((often.column("word").to_pylist(), np.stack([often.column(c).to_numpy() for c in NUMBERS])))
    few = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), text)
    rows = materialize(few.mapInArrow(_look_up(usual), LOOKED_UP), "looked_up")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    joined = rare.join(words.where(level < cut) if cut is not None else words, "word").groupBy("row").agg(*[F.sum(F.col("k") * F.col(c)).alias(f"more_{c}") for c in NUMBERS])
    end = words.where(F.col("word") == F.lit(END)).select("n").first()
    ends = end.n if end else 0
    plus = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0)) for c in NUMBERS}
    own_end = model.end(ends) / LOG10
    return (
        rows.drop("words", "times")
        .join(joined, "row", "left")
        .select(
            "doc_id",
            "held_out",
            (F.col("n_words") + 1).alias("n_tokens"),
            (F.round(plus["known"]) + int(ends > 0)).cast("long").alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (plus["base"] + float(np.log10(ends + 0.1)) - (F.col("n_words") + 1) * float(np.log10(model.tokens + 0.1 * (model.kinds + 1)))).alias("base_score"),
            *[(plus[c] + own_end).alias(name) for c, name in zip(SCORES, ("score", "vocabulary_score", "word_score"), strict=True)],
        )
    )
