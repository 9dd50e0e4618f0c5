"""Repeated passages: removal of word windows that occurred earlier, by suffix automata over reference shards.

A shard is what stands around one anchor. Every window of `window` words has as its anchor the leftmost smallest hash of
`gram` consecutive words in it, so equal windows have equal anchors, and neighbouring windows mostly share one. Anchors
that different texts, or one text twice, have in common are found by an ordinary aggregation; only the passages around
those go on.

The shards of the most frequent anchors, a bounded number, are put into one automaton that is broadcast: of each the
passages in the first document that has it. Documents stream their passages with these anchors through it, map-side, for
their matching statistics; a window whose match is as long as itself has occurred in that first document. All other
passages are dealt by anchor and meet in one task in document order: the automaton of a shard takes in each different
passage, after the passage was streamed through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import chunks, drop_table, materialize, mixed, words_of

#: A null id counts as smaller than any other.
NULL_ID = -(2**63)
SURVEY = "d long, x long, is_null boolean, n_words int, sha binary, sha8 long, anchors array<long>, twice array<boolean>"
PASSAGES = "key long, d long, sha8 long, start int, n int, words binary"
#: Kinds of suspect anchors: dealt by anchor, dealt by single windows, and of a broadcast shard (with either of these).
PLAIN, HOT, BROADCAST = 0, 1, 2
EMPTY = hashlib.sha256(b"").hexdigest()


class SuffixAutomaton:
    """Of a growing sequence of symbols; None separates passages and never matches."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, symbol) -> None:
        if symbol is None:
            self.last = 0
            return
        held = self.next[self.last].get(symbol)
        if held is not None and self.length[held] == self.length[self.last] + 1:
            self.last = held
            return
        if held is not None:
            self.last = self._split(self.last, held, symbol)
            return
        new, p = self._state({}, 0, self.length[self.last] + 1), self.last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
        self.last = new

    def _state(self, arcs: dict, link: int, length: int) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        """A state for the shorter strings of q, to which the arcs from p and its suffixes turn."""
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def statistics(self, symbols) -> Iterator[int]:
        """Per place, the length of the longest suffix up to there that the sequence holds."""
        state = length = 0
        for x in symbols:
            while state and x not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if x in self.next[state]:
                state = self.next[state][x]
                length += 1
            yield length


def anchors_of(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per run of windows that share an anchor: the anchor's hash, the first window's start, the number of windows."""
    if len(words) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashed = np.array(list(map(xxhash.xxh64_intdigest, words)), dtype=np.uint64)
    n = len(words) - gram + 1
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n]
    total = mixed(total)
    place = sliding_window_view(total, window - gram + 1).argmin(axis=1) + np.arange(len(words) - window + 1)
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return total[place[starts]].view(np.int64), starts, np.diff(np.append(starts, len(place)))


def _place(d: int, start: int) -> int:
    """A key that spreads the words of documents over tasks."""
    return ((d + start + 2**63) & (2**64 - 1)) - 2**63


def _sha8(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


def _survey(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, 3, 2_000_000):
                n, shas, anchors, twice, ends = [], [], [], [], [0]
                for text in b.column(3).to_pylist():
                    words = words_of(text)
                    n.append(len(words))
                    shas.append(hashlib.sha256(b" ".join(words)).digest())
                    found, times = np.unique(anchors_of(words, window, gram)[0], return_counts=True)
                    anchors.append(found)
                    twice.append(times > 1)
                    ends.append(ends[-1] + len(found))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (anchors, twice)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int32()), pa.array(shas, pa.binary()), pa.array(map(_sha8, shas), pa.int64()), *lists], ["d", "x", "is_null", "n_words", "sha", "sha8", "anchors", "twice"])

    return run


def _references(window: int, gram: int, most: int = 64):
    """(text, anchors) to the different passages around these anchors, the first `most` of each; the others are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, 0, 2_000_000):
                found: dict[tuple, None] = {}
                for text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    words, left = words_of(text), dict.fromkeys(wanted, most)
                    for anchor, start, n in zip(*(x.tolist() for x in anchors_of(words, window, gram)), strict=True):
                        if left.get(anchor):
                            left[anchor] -= 1
                            found[b" ".join(words[start : start + n + window - 1])] = None
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], ["words"])

    return run


def _spans(shard: SuffixAutomaton, words: list[bytes], window: int) -> list[tuple[int, int]]:
    """Maximal ranges of windows, by start, that the shard holds."""
    out: list[tuple[int, int]] = []
    for i, length in enumerate(shard.statistics(words)):
        if length >= window:
            if out and out[-1][1] == i - window + 1:
                out[-1] = (out[-1][0], i - window + 2)
            else:
                out.append((i - window + 1, i - window + 2))
    return out


def automaton_of(passages: list[bytes]) -> SuffixAutomaton:
    shard = SuffixAutomaton()
    for passage in passages:
        for word in (*passage.split(b" "), None):
            shard.extend(word)
    return shard


def _passages(window: int, gram: int, shared):
    """(d, sha8, text, anchors, kinds, own) to the passages around suspect anchors. own: whether the document is the first
    with the anchor, and so the reference of a broadcast shard.

    Windows that the broadcast automaton knows from an earlier document go on without words, dealt by place, as no shard
    has to see them. A hot anchor's passages are cut into single windows, each under a key of its own, so that no key
    gathers what merely borders on a frequent passage. Of equal passages of a chunk only the earliest goes on; the others
    have occurred earlier, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value
        for big in batches:
            for b in chunks(big, 2, 2_000_000):
                rows: dict[tuple, tuple] = {}
                again: list[tuple] = []

                def add(key: int, words: bytes, at: tuple) -> None:
                    held = rows.get((key, words))
                    if held is None or at < held:
                        rows[key, words] = at
                        if held is not None:
                            again.append((_place(held[0], held[2]), *held))  # noqa: B023
                    elif at != held:  # else a repeated row
                        again.append((_place(at[0], at[2]), *at))  # noqa: B023

                def deal(anchor: int, hot: bool, words: list[bytes], d: int, sha8: int, start: int, n: int) -> None:
                    if not hot:
                        return add(anchor, b" ".join(words[start : start + n + window - 1]), (d, sha8, start, n))
                    for s in range(start, start + n):
                        passage = b" ".join(words[s : s + window])
                        add(xxhash.xxh64_intdigest(passage) - 2**63, passage, (d, sha8, s, 1))

                for d, sha8, text, suspect, kinds, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    words = words_of(text)
                    kind_of = dict(zip(suspect, zip(kinds, own, strict=True), strict=True))
                    for anchor, start, n in zip(*(x.tolist() for x in anchors_of(words, window, gram)), strict=True):
                        if anchor not in kind_of:
                            continue
                        kind, reference = kind_of[anchor]
                        at = start
                        if kind & BROADCAST and not reference:
                            for first, stop in _spans(shard, words[start : start + n + window - 1], window):
                                again.append((_place(d, start + first), d, sha8, start + first, stop - first))
                                if start + first > at:
                                    deal(anchor, bool(kind & HOT), words, d, sha8, at, start + first - at)
                                at = start + stop
                        if start + n > at:
                            deal(anchor, bool(kind & HOT), words, d, sha8, at, start + n - at)
                out = [(key, *at, words) for (key, words), at in rows.items()] + [(*x, None) for x in again]
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["key", "d", "sha8", "start", "n", "words"])

    return run


def _occurred(window: int):
    """From passages in order of (key, document, start) to spans of words whose windows have occurred earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, shard = None, {}, None
        for b in batches:
            out = []
            for k, d, sha8, start, n, passage in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if passage is None or (k == key and passage in seen):
                    if passage is None or seen[passage] != (d, sha8, start):  # else a repeated row
                        out.append((d, sha8, start, start + n + window - 1))
                    continue
                if k != key:
                    key, seen, shard = k, {passage: (d, sha8, start)}, None
                    continue
                if shard is None:
                    shard = automaton_of(list(seen))
                words = passage.split(b" ")
                out += [(d, sha8, start + first, start + stop + window - 1) for first, stop in _spans(shard, words, window)]
                for word in (*words, None):
                    shard.extend(word)
                seen[passage] = (d, sha8, start)
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["d", "sha8", "start", "stop"])

    return run


def _cut(with_text: bool):
    """(d, sha8, text, spans) to what is removed and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, 2, 2_000_000):
                removed, left = [], []
                for text, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    words = words_of(text)
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, [s["start"] for s in spans], 1)
                    np.add.at(edge, [s["stop"] for s in spans], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    left.append(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]))
                shas = pa.array([hashlib.sha256(x).hexdigest() for x in left])
                texts = pa.array([x.decode("utf-8", "surrogatepass") if with_text else None for x in left], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), shas, texts], ["d", "sha8", "removed", "left_sha256", "left_text"])

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 8, hot: int = 3000, frequent: int = 64, shards: int = 256, keep_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, with keep_text, kept_text.

    Removed is each word covered by a window of `window` words that also starts earlier: in a document with a smaller id,
    or earlier in the same one. Windows are judged on the input. Documents with the same words are one to the search; all
    but the one with the smallest id lose every window they have. A null text has no words; a null id counts as smaller
    than any other; rows that share an id are ordered by a hash of their words, and repeated rows are one document. An
    empty table gives an empty result. kept_text: what is left, joined by single spaces; null where nothing changed but
    white space.

    The anchors of most texts, `shards` of them at most, each in more than `frequent` texts, are broadcast.
    """
    spark = docs.sparkSession
    d, text = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("d"), F.col(text_col).cast("string").alias("text")
    # rows with a null id share d: the hash of the text deals them to different tasks
    keyed = docs.select(d, F.xxhash64(F.col(text_col).cast("string")).alias("x"), F.col(id_col).isNull().alias("is_null"), text)
    survey = materialize(keyed.mapInArrow(_survey(window, gram), SURVEY), "survey")
    thin = survey.select("d", "x", "is_null", "n_words", "sha", "sha8")
    firsts = materialize(survey.groupBy("sha").agg(F.min(F.struct("d", "x")).alias("first")).select("sha", "first.*"), "firsts")
    each = survey.select("d", "x", "sha8", F.explode(F.arrays_zip("anchors", "twice")).alias("a")).select("d", "x", "sha8", F.col("a.anchors").alias("anchor"), F.col("a.twice").alias("twice"))
    shared = (
        each.groupBy("anchor")
        .agg(F.min("sha8").alias("low"), F.max("sha8").alias("high"), F.bool_or("twice").alias("twice"), F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "sha8")).alias("first"))
        .where("low <> high OR twice")
        .select("anchor", "n", "first")
    )
    shared = materialize(shared, "shared")
    # one row for each broadcast shard
    usual = shared.where(F.col("n") > frequent).orderBy(F.desc("n"), "anchor").limit(shards).select("anchor", F.lit(BROADCAST).alias("kind"))
    kind = F.coalesce("kind", F.lit(PLAIN)) + (F.col("n") > hot).cast("int")
    shared = materialize(shared.join(F.broadcast(usual), "anchor", "left").select("anchor", kind.alias("kind"), "first"), "shared")
    suspects = each.join(shared, "anchor").select("d", "x", "sha8", F.struct("anchor", "kind", (F.struct("d", "sha8") == F.col("first")).alias("own")).alias("a"))
    suspects = suspects.groupBy("d", "x").agg(F.first("sha8").alias("sha8"), F.collect_set("a").alias("a")).join(firsts.select("d", "x"), ["d", "x"], "left_semi")
    suspects = materialize(suspects.select("d", "x", "sha8", F.col("a.anchor").alias("anchors"), F.col("a.kind").alias("kinds"), F.col("a.own").alias("own")), "suspects")
    picked = materialize(keyed.select("d", "x", "text").join(suspects, ["d", "x"]).select("d", "sha8", "text", "anchors", "kinds", "own"), "picked")
    asked = F.transform(F.filter(F.arrays_zip("anchors", "kinds", "own"), lambda a: a["own"] & (a["kinds"] >= BROADCAST)), lambda a: a["anchors"])
    references = picked.select("text", asked.alias("anchors")).where(F.size("anchors") > 0).distinct().mapInArrow(_references(window, gram), "words binary")
    # each passage has under two windows' words
    known = [r.words for r in references.distinct().orderBy("words").limit(4 * shards).collect()]
    passages = picked.mapInArrow(_passages(window, gram, spark.sparkContext.broadcast(automaton_of(known))), PASSAGES)
    spans = passages.repartition("key").sortWithinPartitions("key", "d", "sha8", "start").mapInArrow(_occurred(window), "d long, sha8 long, start int, stop int")
    spans = materialize(spans.groupBy("d", "sha8").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    cut = picked.select("d", "sha8", "text").join(spans, ["d", "sha8"]).mapInArrow(_cut(keep_text), "d long, sha8 long, removed long, left_sha256 string, left_text string")
    cut = materialize(cut.groupBy("d", "sha8").agg(*[F.first(c).alias(c) for c in ("removed", "left_sha256", *(["left_text"] if keep_text else []))]), "cut")  # repeated rows
    for table in (suspects, shared, picked, spans):
        drop_table(table)
    out = thin.join(firsts.select("sha", F.col("d").alias("first")), "sha").join(cut, ["d", "sha8"], "left")
    copied = (F.col("d") != F.col("first")) & (F.col("n_words") >= window)
    columns = [
        F.when(~F.col("is_null"), F.col("d")).alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(EMPTY)).otherwise(F.coalesce("left_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.when(copied, F.lit("")).otherwise(F.col("left_text")).alias("kept_text")] if keep_text else []))


def digests(docs: DataFrame, **options) -> DataFrame:
    """deduplicate() without the texts: doc_id, n_words, n_removed, kept_sha256."""
    return deduplicate(docs, keep_text=False, **options)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS x FROM starts
), ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS nth FROM windows
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM ranked WHERE nth > 1
), places AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS left_text, count(*) AS n FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(left_text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
