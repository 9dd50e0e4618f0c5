"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The three vectors of a letter trigram are permuted (rotated) by their
place and bound (multiplied) into one; a document is the bundle (sum) of its trigrams, a language the bundle of its
documents, and a document gets the language whose prototype has the greatest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.errors import LoomError
from loomframe.llm.common import chunks, id_remainder, mixed, tidy

DIMENSIONS = 512
UNKNOWN = "und"
#: Letters of a text of which half the cosine is asked that long texts need.
HALF_ASKED = 50
#: Cells of the table of counts, texts x different trigrams, that is held at once.
CELLS = 1_000_000


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Code point to symbol: a letter's own code point, folded to lower case; 0 for anything else."""
    table = np.zeros(0x110000, dtype=np.int32)
    letters = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]
    table[letters] = [ord(chr(i).lower()[0]) for i in letters]
    return table


def letter_vectors(symbols: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 1) -> np.ndarray:
    """A random vector of +1 and -1 for each symbol, made from the symbol and the seed alone."""
    words = dimensions // 64
    counters = (symbols.astype(np.uint64)[:, None] + (np.uint64(seed) << np.uint64(32))) * np.uint64(words) + np.arange(words, dtype=np.uint64)
    bits = np.unpackbits(mixed(mixed(counters)).astype("<u8").view(np.uint8).reshape(len(symbols), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols that occur, sorted, and for each letter its document and the trigram around it, in base len(symbols) of
    their places; runs of other characters count as one symbol."""
    points = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbol = symbol_table()[points]
    keep = symbol > 0
    keep[1:] |= symbol[:-1] > 0
    keep[0] = True
    doc = np.repeat(np.arange(len(texts) + 1, dtype=np.int32), [*(len(t) + 1 for t in texts), 1])[keep]
    symbol = symbol[keep]
    known = np.flatnonzero(np.bincount(symbol))
    place = np.zeros(int(known[-1]) + 1, dtype=np.int64)
    place[known] = np.arange(len(known))
    symbol = place[symbol]
    at = np.flatnonzero(symbol[1:-1]) + 1
    return known, doc[at], (symbol[at - 1] * len(known) + symbol[at]) * len(known) + symbol[at + 1]


def different(grams: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams, sorted, and the place of each trigram among them."""
    if symbols**3 > 1_000_000:
        return np.unique(grams, return_inverse=True)
    used = np.flatnonzero(np.bincount(grams, minlength=1))
    place = np.zeros(symbols**3, dtype=np.int64)
    place[used] = np.arange(len(used))
    return used, place[grams]


def bound(grams: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The vectors of trigrams: its letters' vectors, rotated by 2, 1 and 0 places, multiplied."""
    base, n = letter_vectors(symbols), len(symbols)
    out = np.roll(base, 2, axis=1)[grams // (n * n)]
    out *= np.roll(base, 1, axis=1)[grams // n % n]
    out *= base[grams % n]
    return out


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of letters and vector of each text. Sums are of whole numbers, exact in any order."""
    symbols, doc, gram = trigrams(texts)
    used, gram = different(gram, len(symbols))
    letters, out = np.bincount(doc, minlength=len(texts)), np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    ends = np.append(0, np.cumsum(letters))
    for first in range(0, len(used), 8192):
        vectors = bound(used[first : first + 8192], symbols)
        rows = CELLS // len(vectors)
        for start in range(0, len(texts), rows):
            stop = min(len(texts), start + rows)
            own = slice(ends[start], ends[stop])
            here = (gram[own] >= first) & (gram[own] < first + len(vectors))
            cells = (doc[own][here] - start).astype(np.int64) * len(vectors) + gram[own][here] - first
            out[start:stop] += np.bincount(cells, minlength=(stop - start) * len(vectors)).reshape(stop - start, -1).astype(np.float32) @ vectors
    return letters, out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def flush():
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(np.rint(total).astype(np.int64))], ["lang", "dimension", "value"])
        sums.clear()

    for big in batches:
        for b in chunks(big, 0, 500_000):
            order: dict[str, list[str]] = {}
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                order.setdefault(lang, []).append(t)
            for lang, own in order.items():
                symbols, _, gram = trigrams(own)
                used, gram = different(gram, len(symbols))
                n, total = np.bincount(gram, minlength=len(used)).astype(np.float64), np.zeros(DIMENSIONS)
                for k in range(0, len(used), 8192):
                    total += n[k : k + 8192] @ bound(used[k : k + 8192], symbols)
                sums[lang] = sums[lang] + total if lang in sums else total
            if len(sums) > 1000:
                yield from flush()
    yield from flush()


class LanguageModel:
    """Prototypes: one row per language, sorted by name so that ties go to the first."""

    def __init__(self, langs: list[str], prototypes: np.ndarray):
        self.langs, self.prototypes = langs, prototypes
        norms = np.linalg.norm(prototypes, axis=1, keepdims=True) if langs else np.ones((0, 1))
        self.unit = (prototypes / np.where(norms > 0, norms, 1)).astype(np.float32)

    @staticmethod
    def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", most_langs: int = 4000) -> LanguageModel:
        """From all rows with a text and a language. What reaches the driver is one vector per language; a column of more
        than most_langs values is no language, and an error."""
        known = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
        sums = known.mapInArrow(tidy(_profile), "lang string, dimension int, value long").groupBy("lang", "dimension").agg(F.sum("value").alias("value"))
        found = sums.limit(most_langs * DIMENSIONS + 1).toArrow()
        if found.num_rows > most_langs * DIMENSIONS:
            raise LoomError(f"'{lang_col}' has more than {most_langs} values")
        langs, at = np.unique(np.array(found.column("lang").to_pylist(), dtype=object), return_inverse=True)
        out = np.zeros((len(langs), DIMENSIONS))
        out[at, found.column("dimension").to_numpy()] = found.column("value").to_numpy()
        return LanguageModel(langs.tolist(), out)

    def predict(self, texts: list[str], least: float = 0.0) -> tuple[list[str], np.ndarray]:
        """The language of each text and its cosine. least: a text whose best cosine is below what least_cosine() asks of
        so many letters is in no language."""
        letters, vectors = bundles(texts)
        norms = np.linalg.norm(vectors, axis=1)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosines = (vectors @ self.unit.T) / np.where(norms > 0, norms, 1)[:, None]
        best = cosines.argmax(axis=1)
        like = (letters > 0) & (cosines.max(axis=1) >= least_cosine(letters, least) if least else True)
        names = [self.langs[k] if n else UNKNOWN for k, n in zip(best, like, strict=True)]
        return names, np.where(letters > 0, np.clip(cosines.max(axis=1), 0.0, 1.0), 0.0).astype(np.float64)


def least_cosine(letters: np.ndarray, least: float) -> np.ndarray:
    """The cosine asked for: `least` of long texts, less of short ones, whose few trigrams resemble no prototype much."""
    return least * letters / (letters + HALF_ASKED)


def annotate(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """docs with the columns lang_pred and lang_score behind its own.

    Whole texts count. A null text, or one without any letter, is `und` with score 0; so is every text when nothing was
    learned. With `least`, texts that resemble no learned language are `und` too, with their score. Other columns, whatever they are called, pass through; a column lang_pred or lang_score is replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score")).schema
    shared, at = docs.sparkSession.sparkContext.broadcast((model.langs, model.prototypes)), kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for big in batches:
            for b in chunks(big, at, 500_000):
                names, scores = own.predict([t or "" for t in b.column(at).to_pylist()], least)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*b.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(tidy(run), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows whose id's crc32 leaves a remainder other than 0 by 5, and predict all rows: doc_id, held_out,
    lang_pred, score. A row with a null id is neither learned from nor held out."""
    remainder = id_remainder(id_col, 5)
    model = LanguageModel.fit(docs.where(remainder != 0), text_col, lang_col)
    few = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return annotate(few, model, "text").select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
