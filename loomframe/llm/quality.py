"""Quality classifier of supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams are hashed to rows of a table of learned vectors; the mean of a
document's vectors goes through a linear layer and a softmax. Both are trained by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import chunks, id_remainder, mixed

BUCKETS, DIMENSIONS = 1 << 17, 10
#: n of the character n-grams.
NGRAMS = (1, 3, 4)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The document and the bucket of every feature of the texts.

    A pair of equal neighbours is one feature whatever the word, so that repetition can be learned."""
    points = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts) + 1, dtype=np.int32), [*(len(t) + 1 for t in texts), 1])
    space = (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0)
    code = mixed(np.arange(256, dtype=np.uint64) + np.uint64(77))[points & 255] ^ (points.astype(np.uint64) >> np.uint64(8)) * np.uint64(0x9E3779B97F4A7C15)
    code[space] = np.uint64(0x1234567)
    docs, hashes = [], []
    with np.errstate(over="ignore"):
        starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
        if len(starts):
            place = np.arange(len(points), dtype=np.int64)
            begin = np.zeros(len(points), dtype=np.int64)
            begin[starts] = starts
            within = place - np.maximum.accumulate(begin)
            weights = mixed(np.arange(64, dtype=np.uint64) + np.uint64(1001)) | np.uint64(1)
            terms = np.where(space, np.uint64(0), code * weights[within & 63])
            word = np.add.reduceat(terms, starts)
            pair = np.where(word[1:] == word[:-1], np.uint64(99), word[1:] * np.uint64(0xD6E8FEB86659FD93) + word[:-1])
            same = doc[starts[1:]] == doc[starts[:-1]]
            docs += [doc[starts], doc[starts[1:]][same]]
            hashes += [word, pair[same]]
        for n in NGRAMS:
            gram = np.full(len(points) - n + 1, n, dtype=np.uint64)
            inside = np.ones(len(gram), dtype=bool)
            for k in range(n):
                gram = gram * np.uint64(0x100000001B3) + code[k : len(points) - n + 1 + k]
                if 0 < k < n - 1 or n == 1:  # a gram may begin or end with white space only
                    inside &= ~space[k : len(points) - n + 1 + k]
            at = np.flatnonzero(inside)
            docs.append(doc[at + n // 2])
            hashes.append(gram[at])
        bucket = (np.concatenate(hashes) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 17)).astype(np.int32)
    return np.concatenate(docs), bucket


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for b in chunks(big, 1, 200_000):
            doc, bucket = features([t or "" for t in b.column(1).to_pylist()])
            keys, n = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            ends = np.searchsorted(keys // BUCKETS, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % BUCKETS, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, b.column(2)], ["key", "buckets", "counts", "label"])


class QualityModel:
    """slope: per bucket, what its vector adds to the log odds of label 1 when it is all of a document."""

    def __init__(self, slope: np.ndarray, bias: float):
        self.slope, self.bias = slope, bias

    @staticmethod
    def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 1.0, seed: int = 3) -> QualityModel:
        """examples: buckets, their counts, label. Plain stochastic gradient descent, the rate falling to zero."""
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        output, bias = np.zeros((2, DIMENSIONS), dtype=np.float32), np.zeros(2, dtype=np.float32)
        steps, done = max(1, epochs * len(examples)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(examples)):
                buckets, share, label = examples[i]
                hidden = share @ vectors[buckets]
                logits = output @ hidden + bias
                p = np.exp(logits - logits.max())
                error = p / p.sum()
                error[label] -= 1.0
                step = np.float32(rate * (1 - done / steps))
                back = error @ output
                output -= step * np.outer(error, hidden)
                bias -= np.float32(0.1) * step * error
                vectors[buckets] -= (step * 20 * share)[:, None] * back
                done += 1
        return QualityModel((vectors @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0]))

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 1500) -> QualityModel:
        """From whole texts of at most per_label rows of each label, those with the smallest hashes of their ids, whose
        id's crc32 leaves a remainder other than 2 by 4. Ids with both labels, null ids and null labels are left out; of rows
        that share an id, the greatest text counts."""
        known = (
            labels.where((id_remainder(id_col, 4) != 2) & F.col(label_col).isin(0, 1))
            .groupBy(F.col(id_col).alias("__id"))
            .agg(F.min(label_col).cast("int").alias("__label"), F.max(label_col).cast("int").alias("__most"))
            .where("__label = __most")
        )
        hashed = known.select("__id", "__label", F.xxhash64("__id").alias("__hash"))
        chosen = [r for value in (0, 1) for r in hashed.where(F.col("__label") == value).orderBy("__hash").limit(per_label).collect()]
        if not chosen:
            return QualityModel(np.zeros(BUCKETS), 0.0)
        sample = docs.sparkSession.createDataFrame([(r["__id"], r["__label"]) for r in chosen], hashed.select("__id", "__label").schema)
        asked = docs.join(F.broadcast(sample), F.col(id_col) == F.col("__id"))
        texts = asked.groupBy(F.col("__id").cast("long").alias("key")).agg(F.max(F.col(text_col).cast("string")).alias("text"), F.max("__label").alias("label"))
        rows = texts.mapInArrow(_counted, "key long, buckets array<int>, counts array<int>, label int").toArrow().sort_by("key")
        examples = []
        for b in rows.to_batches():
            for i in range(b.num_rows):
                n = b.column(2)[i].values.to_numpy().astype(np.float32)
                examples.append((b.column(1)[i].values.to_numpy(), n / max(1.0, n.sum()), b.column(3)[i].as_py()))
        return QualityModel.train(examples)

    def predict(self, texts: list[str]) -> np.ndarray:
        doc, bucket = features(texts)
        total = np.bincount(doc, weights=self.slope[bucket], minlength=len(texts))
        logit = total / np.maximum(1, np.bincount(doc, minlength=len(texts))) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def annotate(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs with a column quality_score behind its own, 0 to 1, higher: label 1 is likelier. Whole texts count; a null
    text is scored as an empty one, by the bias alone. Other columns pass through; a column quality_score is replaced."""
    kept = [c for c in docs.columns if c != "quality_score"]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared, at = docs.sparkSession.sparkContext.broadcast((model.slope, model.bias)), kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(*shared.value)
        for big in batches:
            for b in chunks(big, at, 200_000):
                scores = own.predict([t or "" for t in b.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], names=[*b.schema.names, "quality_score"])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("quality_score")).schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Learn from labels and score all of docs: doc_id, held_out, score, predicted. A null id is never held out. Without
    any label every score is 0.5. Repeated rows are scored alike; an empty table gives an empty result."""
    model = QualityModel.fit(docs, labels)
    few = docs.select("doc_id", F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return annotate(few, model).select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
