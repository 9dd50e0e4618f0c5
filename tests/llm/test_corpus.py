"""The corpus operators on small tables: against brute force, and on nulls, empty and very long texts, ties, repeated rows,
empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomframe.llm import chat, common, components, exact_dedup, language, lattice, mixing, near, quality, queries, sampling, scoring, simhash, substrings, vectors
from tests.oracle import assert_same, tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, keep_id long, row long, word string, cell int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def documents(spark, *texts, ids=None):
    """Rows with columns whose names operators use inside."""
    ids = ids or range(len(texts))
    rows = [(i, t, "en" if i is None or i % 2 else "fr", None if i is not None and i % 3 == 0 else f"s{(i or 0) % 3}", len(t or ""), "d", 5, 6, "w", 7) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank and long texts, repeated rows, a null id."""
    texts = [None, "", " \t\n", "a b c", "a b c", "A b c", LONG, LONG + " end", "!!! 123", "a b c", "é x", "a b c"]
    return documents(spark, *texts, ids=[0, 1, 2, 3, 4, 5, 6, 7, 8, 4, 10, None]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def corpus(spark):
    """Near copies, shared passages and copies."""
    rng = np.random.default_rng(4)
    words = [f"v{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 90))) for _ in range(120)]
    shared = " ".join(rng.choice(words, 45))
    for i in range(0, 60, 3):
        texts[i] = texts[i] + " " + shared + " " + texts[i + 1]
    for i in range(90, 110):
        own = texts[i - 60].split()
        own[len(own) // 2] = "changed"
        texts[i] = " ".join(own)
    texts[110:115] = [texts[3]] * 5
    texts[115] = "loop " * 50
    return documents(spark, *texts).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- exact


def brute_exact(docs):
    groups = defaultdict(list)
    for r in docs:
        groups[r.text or ""].append(r.doc_id)
    return sorted(((r.doc_id, max((i for i in groups[r.text or ""] if i is not None), default=None), len(groups[r.text or ""]), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs), key=str)


@pytest.mark.parametrize("counters", [1, 3, 1000])
def test_exact(odd, none, counters):
    out = exact_dedup.annotate(odd, counters=counters)
    assert rows(out.select("doc_id", "keep_id", "group_size", "text_sha256")) == brute_exact(odd.collect())
    kept = [r.text_sha256 for r in out.where("kept").collect()]
    assert len(kept) == len(set(kept)) == len({r.text or "" for r in odd.collect()})
    assert exact_dedup.annotate(none, counters=counters).count() == 0


def test_exact_keeps_rows(odd, none):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == 8
    assert {r.doc_id for r in kept.collect()} == {1, 2, 4, 5, 6, 7, 8, 10}
    assert exact_dedup.deduplicate(none).count() == 0


def test_misra_gries_holds_every_frequent_value(spark):
    values = [1] * 60 + [2] * 40 + list(range(10, 110))
    df = spark.createDataFrame([(int(x).to_bytes(2, "big"),) for x in np.random.default_rng(0).permutation(values)], "digest binary").repartition(7)
    found = {int.from_bytes(r.digest, "big") for r in exact_dedup.frequent(df, 5).collect()}
    assert {1, 2} <= found and len(found) <= 5


# ---- SimHash


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def test_simhash(corpus, none):
    docs = sorted(corpus.collect(), key=lambda r: r.doc_id)
    prints = [brute_fingerprint(r.text) for r in docs]
    wanted = brute_components(len(docs), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.annotate(corpus).collect()}
    assert got == {r.doc_id: (f"{p:016x}", docs[c].doc_id) for r, p, c in zip(docs, prints, wanted, strict=True)}
    assert simhash.annotate(none).count() == 0


def test_simhash_odd_rows(odd):
    got = rows(simhash.annotate(odd))
    assert len(got) == 12
    by = {r[0]: r for r in got}
    assert by[0][1:] == by[1][1:] == by[2][1:] == ("0" * 16, 0)
    assert by[3][2] == by[4][2] == by[5][2] == by[None][2] == 3


@pytest.mark.parametrize(("crowd", "hot"), [(4, 10**6), (4096, 10**6), (4096, 20), (4, 20)])
def test_simhash_crowds(spark, monkeypatch, crowd, hot):
    rng = np.random.default_rng(1)
    prints = set()
    for base in rng.integers(0, 2**62, 3):
        for _ in range(150):
            x = int(base)
            for j in rng.integers(0, 10, 5):
                x ^= 1 << int(6 * j)
            prints.add(x)
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "HOT", hot)
    links = simhash.links_of(spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long"))
    got = {r.node: r.component for r in components.components(links).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == brute_components(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)


def brute_near(docs, shingle=5, percent=80):
    """The smallest id of each group, and the number of links between different sets."""
    sets = []
    for r in docs:
        words = (r.text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))})
    near_by = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    found = brute_components(len(docs), near_by)
    return {min(docs[i].doc_id for i in range(len(docs)) if found[i] == c) for c in set(found)}, sum(near_by(a, b) and sets[a] != sets[b] for a in range(len(docs)) for b in range(a))


@pytest.mark.parametrize("sampled", [1, 16])
def test_near_copies_of_the_pipeline(spark, monkeypatch, sampled):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    line = rng.choice(vocabulary, 12).tolist()
    texts = []
    for i in range(60):
        own = rng.choice(vocabulary, rng.integers(3, 160)).tolist() + (line if i % 3 == 0 else [])
        texts.append(own)
        for _ in range(i % 4):
            copy = list(own)
            for at in rng.integers(0, len(copy), max(1, len(copy) // 60)):
                copy[at] = "changed"
            texts.append(copy)
    monkeypatch.setattr(near, "SAMPLED", sampled)
    docs = documents(spark, *map(" ".join, texts))
    wanted, links = brute_near(sorted(docs.collect(), key=lambda r: r.doc_id))
    assert links > 30
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == wanted


@pytest.mark.parametrize("block", [100_000, 1_000_000])
def test_near_copies_in_a_large_group(spark, monkeypatch, block):
    """The tables in between grow with the members of a group, not with its pairs, where most members are near to none."""
    rng = np.random.default_rng(5)
    own = [f"w{i}" for i in range(1200)]
    texts = [own]
    for i in range(120):
        copy = list(own)
        for at in rng.choice(1200, 10 if i % 6 == 0 else 30, replace=False):
            copy[at] = f"c{i}"
        texts.append(copy)
    docs = documents(spark, *map(" ".join, texts))
    wanted, links = brute_near(sorted(docs.collect(), key=lambda r: r.doc_id))
    counts = {}

    def counted(df, name):
        out = common.materialize(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near, "materialize", counted)
    monkeypatch.setattr(near, "SAMPLED", 1 << 40)  # no shingle is known to be common, so that prefixes are short
    monkeypatch.setattr(near, "BLOCK", block, raising=False)
    assert {r.doc_id for r in near.deduplicate(docs).collect()} == wanted
    assert links >= 20 and 90 <= len(wanted) <= 110
    # the index has 20 rows of a set at most, and each may have one pair besides
    assert max(counts.values()) <= 2 * 20 * len(texts), counts


@pytest.mark.parametrize("percent, pairs", [(50, 3), (80, 50), (80, 200_000), (100, 50)])
def test_links_of_components(monkeypatch, percent, pairs):
    monkeypatch.setattr(near, "PAIRS", pairs)
    rng = np.random.default_rng(percent + pairs)
    for _ in range(40):
        bases = [rng.integers(0, 1_000_000, rng.integers(1, 60)) for _ in range(3)]
        sets = [set(rng.permutation(bases[rng.integers(3)])[rng.integers(0, 8) :].tolist()) | set(rng.integers(0, 40, rng.integers(1, 6)).tolist()) for _ in range(rng.integers(1, 40))]
        component = rng.integers(0, rng.integers(1, len(sets) + 1), len(sets)) * 1000
        near_by = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
        found = near.linked(component, np.concatenate([np.array(sorted(s)) for s in sets]), np.array([len(s) for s in sets]), percent)
        assert all(near_by(a, b) for a, b in found)
        joined = {tuple(sorted(x)) for x in found}
        wanted = brute_components(len(sets), lambda a, b: component[a] == component[b] or near_by(a, b))
        assert brute_components(len(sets), lambda a, b: component[a] == component[b] or (min(a, b), max(a, b)) in joined) == wanted
        assert len(found) == len(set(component.tolist())) - len(set(wanted))


def test_near_copies_with_repeated_ids(spark):
    import corpus_pipeline

    docs = documents(spark, "a b c d e f g", "p q r s t u v", "A b c d e f g", "x", ids=[1, 1, 2, None])
    assert rows(corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text")) == rows(docs.where("doc_id = 1 OR doc_id IS NULL").select("doc_id", "text"))


def test_near_copies_of_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r.doc_id for r in near.deduplicate(docs).collect()} == brute_near(docs.select("doc_id", "text").orderBy("doc_id").collect())[0]


def test_workers_take_little_memory(spark, monkeypatch):
    """Small batches while a table is written, nothing kept after a task, and one Python step in a task."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    wide = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    got = [r.bytes for r in common.materialize(wide.mapInArrow(sizes, "bytes long"), "sizes").collect()]
    assert sum(got) >= 20_000_000 and max(got) < 8_000_000 and spark.conf.get(key) == before
    released = []
    monkeypatch.setattr(common, "release", lambda: released.append(1))
    assert list(common.tidy(lambda batches: (b for b in batches))(iter([1, 2]))) == [1, 2] and released
    plans = []
    monkeypatch.setattr(near, "components", lambda links: plans.append(links._jdf.queryExecution().executedPlan().toString()) or components.components(links))
    reps = spark.createDataFrame([(1, 7), (2, 6), (3, 1 << 40 | 0xFFF)], "set long, fp long")
    assert {tuple(sorted(r)) for r in near._by_fingerprint(reps).collect()} == {(1, 2)}
    assert len(plans) == 1 and "Python" not in plans[0] and "InArrow" not in plans[0]


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    linked = set(pairs) | {(b, a) for a, b in pairs}
    wanted = brute_components(461, lambda a, b: (a, b) in linked)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert all(got.get(i, i) == wanted[i] for i in range(461))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- passages


def brute_passages(docs, window=20):
    seen, gone = set(), {}
    for i, words in sorted(docs.items()):
        own = np.zeros(len(words), dtype=bool)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                own[s : s + window] = True
            seen.add(w)
        gone[i] = own
    return {i: (len(w), int(gone[i].sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone[i], strict=True) if not g).encode()).hexdigest()) for i, w in docs.items()}


@pytest.mark.parametrize("hot", [2, 400])
def test_passages(corpus, none, hot):
    docs = {r.doc_id: WORD.findall(r.text or "") for r in corpus.collect()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(corpus, hot=hot).collect()}
    assert got == brute_passages(docs) and sum(g[1] for g in got.values()) > 500
    assert substrings.digests(none).count() == 0


def test_passages_through_the_broadcast_automaton(spark, corpus, monkeypatch):
    docs = {r.doc_id: WORD.findall(r.text or "") for r in corpus.collect()}
    for frequent, shards in ((1, 256), (3, 5), (10**6, 256)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(corpus, frequent=frequent, shards=shards).collect()}
        assert got == brute_passages(docs)
    # a passage that 30 documents share, inside words of their own: all spans but the first document's come from it
    rng = np.random.default_rng(16)
    line = [f"p{i}" for i in range(30)]
    texts = {i: [f"a{i}x{k}" for k in range(25)] + line + [f"b{i}x{k}" for k in range(25)] for i in rng.permutation(30).tolist()}
    known = [b" ".join(w.encode() for w in line[s : s + n + 19]) for a, s, n in zip(*(x.tolist() for x in substrings.anchors_of([w.encode() for w in line], 20, 8)), strict=True)]
    import pyarrow as pa

    shared = type("Shared", (), {"value": substrings.automaton_of(known)})
    anchors = [a for a in substrings.anchors_of([w.encode() for w in line], 20, 8)[0].tolist()]
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array([7] * 30, pa.int64()), pa.array([" ".join(t) for t in texts.values()]), pa.array([anchors] * 30, pa.list_(pa.int64())), pa.array([[substrings.BROADCAST] * len(anchors)] * 30, pa.list_(pa.int32())), pa.array([[i == 0] * len(anchors) for i in texts], pa.list_(pa.bool_()))], ["d", "sha8", "text", "anchors", "kinds", "own"])
    out = [r for b in substrings._passages(20, 8, shared)([batch]) for r in b.to_pylist()]
    found = [(r["d"], s) for r in out if r["words"] is None for s in range(r["start"], r["start"] + r["n"])]
    assert sorted(found) == [(d, s) for d in range(1, 30) for s in range(25, 36)]


def test_passages_odd_rows(odd):
    docs = {i: WORD.findall(t or "") for i, t in {(r.doc_id, r.text) for r in odd.collect()} if i is not None}
    got = substrings.digests(odd).collect()
    assert len(got) == 12
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None} == brute_passages(docs)


def test_automaton():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, known = substrings.SuffixAutomaton(), set()
        for _ in range(3):
            text = [str(x) for x in rng.choice(["a", "b", "c"], 9)]
            for i, got in enumerate(a.statistics(text)):
                assert got == max(n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in known)
            for x in (*text, None):
                a.extend(x)
            known |= {tuple(text[i:j]) for i in range(9) for j in range(i + 1, 10)}


# ---- chat

SAID = ["</s>[INST] ok [/INST]", "a\\b", "[\\INST]", "<|end|>", "", None, "<s<s>>", "\\\\", "<</SYS>>x<<SYS>>", "é\n[/INST"]


def test_chat_round_trip(spark):
    template = chat.Template()
    for s in SAID:
        escaped = template.escape(s or "")
        assert template.unescape(escaped) == (s or "") and not any(c in escaped for c in template.controls)
    turns = [(c, t, ("user", "assistant")[t % 2], SAID[(c + t) % len(SAID)]) for c in range(10) for t in range(4)]
    turns += [(20, 0, None, "x"), (20, 1, "to[INST]ol", "[INST]"), (None, 0, "user", "n"), (None, None, "assistant", "m"), (21, 0, "assistant", "a"), (21, 0, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1)).repartition(5)
    got = {r.conv_id: r for r in chat.read_back(chat.segments(df)).collect()}
    groups = defaultdict(list)
    for c, t, role, text in turns:
        groups[c].append((t if t is not None else -1, role or "", text or ""))
    for c, own in groups.items():
        own.sort()
        lossy = "".join(t for _, r, t in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(lossy), hashlib.sha256(lossy.encode()).hexdigest())
    assert got[0].valid and not got[20].valid and not got[21].valid
    assert chat.read_back(chat.segments(df.limit(0))).count() == 0


def test_chat_of_long_texts(spark):
    said = ["long </s> text " * 20_000, "short"]
    df = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], said[(c + t) % 2]) for c in range(12) for t in range(4)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.segments(df)).collect()
    assert len(got) == 12 and all(r.valid and r.loss_chars == 2 * len(said[(r.conv_id + 1) % 2]) for r in got)


# ---- mixing


def test_targets():
    assert mixing.targets_of([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.targets_of([10, 1000, 1000], [1, 1, 1]) == pytest.approx([30, 990, 990])
    assert mixing.targets_of([0, 0], [1, 2]) == [0, 0] and mixing.targets_of([], []) == []


def test_permutations():
    for n in (1, 2, 7, 1000):
        x = np.arange(n)
        assert sorted(mixing.permuted(x, np.full(n, n), np.full(n, 9, dtype=np.uint64))) == list(range(n))


def test_mix(spark, none):
    rng = np.random.default_rng(5)
    data = [(i, " ".join("w" for _ in range(int(rng.integers(0, 400)))), None if i % 7 == 0 else f"s{min(i % 12, 4)}", 1) for i in range(700)] + [(9000, None, "s1", 1), (9001, " \n", "s1", 1), (None, "x y z", "s0", 1), (None, "x y z", "s0", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int").repartition(4)
    out = mixing.mix(df)
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(9)).where("doc_id IS NOT NULL").collect()}
    got = out.collect()
    assert len(got) == len(data) and {(r.doc_id, r.taken) for r in got if r.doc_id is not None} == again
    size = Counter()
    for _, t, s, _ in data:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    wanted = dict(zip([size[s] for s in order], mixing.targets_of([size[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    taken = Counter()
    for r in got:
        assert r.taken <= 3 * r.size and r.target == pytest.approx(wanted[r.source_size])
        taken[r.source_size] += r.taken
    assert all(abs(taken[s] - t) <= max(200, 0.03 * t) for s, t in wanted.items())
    assert mixing.mix(none.select("doc_id", "text", "source")).count() == 0


def test_draws():
    wanted, most = np.array([30.0, 100.0, 0.0, 270.4]), np.array([40, 300, 0, 600])
    sums = []
    for seed in range(60):
        counts = mixing.draw(wanted, most, 20, seed)
        assert counts.sum(axis=1).tolist() == [400 * (k + 1) // 20 - 400 * k // 20 for k in range(20)] and (counts.sum(axis=0) <= most).all()
        sums.append(counts.sum(axis=0))
    assert np.abs(np.mean(sums, axis=0) - wanted).max() < 3 and np.abs(np.array(sums) - wanted).max() < 25
    # each shard is drawn at random: counts scatter as a multinomial's do
    first = np.array([mixing.draw(np.array([50.0, 50.0]), np.array([500, 500]), 1, s)[0, 0] for s in range(400)])
    assert abs(first.var() - 25) < 8


@pytest.mark.parametrize("weights", [(1, 2, 3), (0.5, 1)])
def test_many_sources_are_planned_by_tasks(spark, monkeypatch, weights):
    rng = np.random.default_rng(8)
    data = [(i, " ".join("w" for _ in range(int(rng.integers(0, 30 + 2 * (i % 97) ** 2)))), None if i % 97 == 0 else f"s{i % 97}é") for i in range(1500)] + [(9000, None, "z"), (9001, " ", "z")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    here = mixing.Mixture(df, weights=weights)
    of = {r.source: (r.source_at, r.source_size, r.target, r.blocks) for r in here.sources.collect()}
    monkeypatch.setattr(mixing, "FEW", 10)
    monkeypatch.setattr(mixing, "targets_of", None)
    plan = mixing.Mixture(df, weights=weights)
    assert {r.source: (r.source_at, r.source_size, r.target, r.blocks) for r in plan.sources.collect()} == of
    taken, seen = Counter(), Counter()
    for r in plan.slots.collect():
        seen[r.source_at, r.slot] += 1
        taken[r.source_at] += 1
    assert max(seen.values()) == 1 and max(taken.values()) > 20
    wanted = {at: target * blocks / max(1, size) for at, size, target, blocks in of.values()}
    assert all(n <= 3 * blocks and abs(n - wanted[at]) <= 4 + 0.2 * wanted[at] for at, _, _, blocks in of.values() for n in [taken[at]])
    assert abs(sum(taken.values()) - sum(wanted.values())) <= 1
    rows = mixing.Mixture(df, weights=weights).taken().collect()
    assert len(rows) == len(data) and all(r.taken <= 3 * r.size for r in rows)
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixing.Mixture(df.repartition(7), weights=weights).taken().collect()}
    assert {r.source_at for r in plan.sources.where("source IS NULL").collect()} == {len(of) - 1}


def test_taken_is_what_the_slots_take(corpus):
    plan = mixing.Mixture(corpus, block_words=16)
    size = {r.row: r.size for r in plan.sized.collect()}
    spans, of = defaultdict(list), defaultdict(list)
    for r in plan.spans.collect():
        spans[r.source_at, r.block].append((r.row, r.words))
        of[r.row].append((r.first, r.words))
    for row, own in of.items():  # the spans of a document are its words, once
        assert sorted(own)[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(sorted(own), sorted(own)[1:])) and sum(n for _, n in own) == size[row]
    blocks = {r.source_at: r.blocks for r in plan.sources.collect()}
    full = [sum(n for _, n in own) for own in spans.values()]
    assert max(full) == 16 and sum(n < 16 for n in full) <= len(blocks) and len(spans) == sum(blocks.values())
    taken, drawn = Counter(), defaultdict(list)
    for r in plan.slots.collect():
        drawn[r.source_at].append((r.slot, r.block))
        for row, n in spans[r.source_at, r.block]:
            taken[row] += n
    for source, own in drawn.items():  # a pass over the source takes each block once
        own.sort()
        assert [s for s, _ in own] == list(range(len(own)))
        for start in range(0, len(own), blocks[source]):
            part = [b for _, b in own[start : start + blocks[source]]]
            assert len(set(part)) == len(part) and set(part) <= set(range(blocks[source]))
    ids = {r.row: r.doc_id for r in plan.sized.collect()}
    assert {ids[row]: n for row, n in taken.items()} == {r.doc_id: r.taken for r in plan.taken().collect() if r.taken}


def test_mixture_documents(corpus):
    plan = mixing.Mixture(corpus, block_words=16)
    out = plan.documents()
    assert out.columns == corpus.columns
    taken = {r.doc_id: r.taken for r in plan.taken().collect()}
    text = {r.doc_id: r.text for r in corpus.collect()}
    words = Counter()
    for r in out.collect():
        assert r.text in text[r.doc_id] and r.n_chars == len(r.text)
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {k: v for k, v in taken.items() if v} == dict(words)
    assert mixing.runs_of([(0, 4, 2), (4, 4, 1), (12, 3, 1)]) == [(0, 8), (12, 15), (0, 4)]


# ---- vectors


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    near = [base[i % 5] + rng.normal(size=16) * 0.02 for i in range(80)]
    own = [list(map(float, np.float32(x))) for x in [*base, *near, base[7], base[7], 3 * base[8]]]
    data = [(i, x, 0) for i, x in enumerate(own)] + [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] + [1.0] * 15, 0), (503, [float("inf")] + [1.0] * 15, 0), (504, [1.0, 2.0], 0), (505, [2.0, 4.0], 0), (506, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, u int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.deduplicate(df).collect()}
    x = np.array(own, dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.95
    roots = brute_components(len(x), lambda a, b: s[a, b])
    assert {i: got[i] for i in range(len(x))} == {i: (int(s[i].sum()) - 1, roots[i], roots[i] == i) for i in range(len(x))}
    assert all(got[i] == (0, i, True) for i in (500, 501, 502, 503, 506)) and got[504] == (1, 504, True) and got[505] == (1, 504, False)
    assert vectors.deduplicate(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def skewed(spark):
    """A group of 120 near vectors, 30 pairs and 60 others."""
    rng = np.random.default_rng(12)
    near_by = lambda x: x + rng.standard_normal(x.shape) * 0.01
    pairs = rng.standard_normal((30, 32))
    x = np.concatenate([near_by(np.tile(rng.standard_normal(32), (120, 1))), pairs, near_by(pairs), rng.standard_normal((60, 32))])
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "u long, vec array<double>").cache()


def test_audit_sees_small_groups_beside_a_large_one(spark, skewed):
    large = [(u, 512, [w for w in range(120) if w != u], [1.0] * 119, [False] * 119, 0, False) for u in range(120)]
    small = {u: u + 30 if u < 150 else u - 30 for u in range(120, 180)}
    lists = lambda lost: spark.createDataFrame(large + [(u, 8, [] if u in lost or w in lost else [w], [] if u in lost or w in lost else [1.0], [], 0, False) for u, w in small.items()] + [(u, 8, [], [], [], 0, False) for u in range(180, 240)], vectors.LISTS)
    assert vectors._recall(skewed, lists(()), 0.95) == 1.0
    # 10 pairs lost of 30 are 20 links of 14,340
    assert vectors._recall(skewed, lists(range(120, 130)), 0.95) < 0.9


def test_audit_runs_after_any_number_of_rounds(spark, skewed, monkeypatch):
    asked = []
    monkeypatch.setattr(vectors, "_recall", lambda *args, **_: asked.append(1) or (1.0 if len(asked) == 3 else 0.0))
    lists = vectors.neighbours(skewed, most=4, k=2)
    assert vectors.plain_links(lists, 0.95).count() == 120 * 119 + 60 and len(asked) == 3
    monkeypatch.setattr(vectors, "_recall", lambda *_, **__: 0.0)
    with pytest.raises(vectors.LoomError, match="recall"):
        vectors.neighbours(skewed, most_audits=2)


@pytest.mark.parametrize("centres", [4, 1024])
def test_dense_groups_are_counted(spark, centres):
    """Groups of 700 and 150 near vectors, with a fringe that only some members are near to, pairs, copies and others."""
    rng = np.random.default_rng(13)
    around = lambda x, n, by: x + rng.standard_normal((n, 24)) * by
    a, b = rng.standard_normal((2, 24))
    pairs = rng.standard_normal((30, 24))
    x = np.concatenate([around(a, 700, 0.16), around(a, 60, 0.3), around(b, 150, 0.05), pairs, pairs + rng.standard_normal((30, 24)) * 0.02, rng.standard_normal((100, 24))])
    x = np.concatenate([x, x[:40], x[760:770]]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, row.tolist()) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(5)
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.deduplicate(df, most_list=20).collect()}
    order = np.argsort(ids)
    roots = brute_components(len(x), lambda p, q: near[order[p], order[q]])
    assert {i: got[i] for i in range(len(x))} == {i: (int(near[order[i]].sum()) - 1, roots[i]) for i in range(len(x))}
    lists = vectors.neighbours(df.groupBy("embedding").agg(F.min("vec_id").alias("u")).select("u", F.col("embedding").alias("vec")), most_list=20)
    assert lists.where("dense").count() > 500
    told = vectors.dense_links(lists.select("u", "dense").join(df.select(F.col("vec_id").alias("u"), F.lit(1).cast("long").alias("times"), F.col("embedding").alias("vec")), "u").select("u", "times", "dense", "vec"), 0.95, centres=centres, block=100)
    once = {i for i, in lists.select("u").collect()}
    counted = {r.u: r.n for r in told.where("n IS NOT NULL").groupBy("u").agg(F.sum("n").alias("n")).collect()}
    some = [i for i in once if i in counted and counted[i] > 20]
    at = np.array([order[i] for i in sorted(once)])
    assert all(counted[r.u] == int(near[order[r.u]][at].sum()) - 1 for r in lists.where("dense").select("u").collect()) and len(some) > 500


def test_vectors_with_null_and_repeated_ids(spark):
    x, y = [1.0, 0.0, 0.1], [1.0, 0.0, 0.12]
    df = spark.createDataFrame([(1, x), (1, x), (2, y), (None, x), (None, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(vectors.deduplicate(df).collect(), key=str)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id) == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False)]
    assert sorted(((r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None), key=str) == [(0, None, False), (3, 1, False)]


# ---- language and quality


def test_language(spark, odd, none):
    words = {"xx": ["bana", "nana", "gana"], "yy": ["tirik", "krit", "rikti"]}
    rng = np.random.default_rng(7)
    data = [(i, " ".join(rng.choice(words[k], 30)), k) for i in range(60) for k in [("xx", "yy")[i % 2]]] + [(100, None, "xx"), (101, "123 !!", "yy"), (102, "bana gana", None), (None, "krit", "yy")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert all(got[i].lang_pred == ("xx", "yy")[i % 2] and got[i].held_out == (crc32(str(i).encode()) % 5 == 0) for i in range(60))
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].lang_pred == "xx" and got[None].lang_pred == "yy" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert len(language.identify(odd).collect()) == 12 and language.identify(none).count() == 0
    unlearned = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}


def test_hypervectors_are_what_they_say():
    texts = ["abc abd", "ÀB1c", "", "x"]
    letters, got = language.bundles(texts)
    for text, n, v in zip(texts, letters, got, strict=True):
        assert n == sum(c.isalpha() for c in text) and np.array_equal(v, brute_bundle(text))
    own = language.letter_vectors(np.arange(3000))
    assert set(np.unique(own)) == {-1.0, 1.0} and len(np.unique(own, axis=0)) == 3000


def brute_bundle(text):
    vector = lambda c: language.letter_vectors(np.array([ord(c) if c else 0]))[0]
    run = [""]
    for c in (c.lower()[0] if c.isalpha() else "" for c in text):
        if c or run[-1]:
            run.append(c)
    run.append("")
    out = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(run, run[1:], run[2:]):
        if b:
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


def test_language_by_brute_force(spark):
    rng = np.random.default_rng(14)
    letters = {"xx": "abcdefg", "yy": "efghijk", "zz": "абвгде"}
    data = [(i, " ".join("".join(rng.choice(list(letters[k]), 4)) for _ in range(int(rng.integers(1, 12)))), k if i % 6 else None) for i in range(80) for k in [("xx", "yy", "zz")[i % 3]]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    sums = defaultdict(lambda: np.zeros(language.DIMENSIONS))
    for i, t, k in data:
        if k and crc32(str(i).encode()) % 5:
            sums[k] += brute_bundle(t)
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for r in language.identify(df).collect():
        own = {k: cosine(brute_bundle(data[r.doc_id][1]), v) for k, v in sums.items()}
        assert r.score == pytest.approx(max(0, max(own.values())), abs=1e-5) and own[r.lang_pred] == pytest.approx(max(own.values()), abs=1e-5)


def test_text_in_no_learned_language(spark):
    rng = np.random.default_rng(15)
    known = [" ".join(rng.choice(["bana", "nana", "gana", "lama", "soma"], int(rng.integers(2, 60)))) for _ in range(60)]
    other = [" ".join("".join(rng.choice(list("qwxzkvjy"), 5)) for _ in range(40)) for _ in range(20)]
    df = spark.createDataFrame([*((i, t, "xx") for i, t in enumerate(known)), *((100 + i, t, None) for i, t in enumerate(other))], "doc_id long, text string, lang string")
    import corpus_pipeline

    assert {r.doc_id for r in corpus_pipeline.language_id(spark, df, "").collect()} == set(range(60))


def test_many_short_texts_take_little_memory():
    import subprocess
    import sys

    code = "import numpy as np, resource; from loomframe.llm import language; r = np.random.default_rng(0); t = [''.join(r.choice(list('abcdefghijklmnopqrstuvwxyz'), 100)) for _ in range(10_000)]; before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; language.bundles(t); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)"
    assert float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 300


def test_quality(spark, odd, none):
    rng = np.random.default_rng(8)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40))
    bad = lambda: " ".join(w + "***" for w in good().split())
    data = [(i, good() if i % 2 else bad()) for i in range(200)]
    docs = spark.createDataFrame([*data, (900, None), (901, ""), (None, "abc")], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [i for i in range(200) if crc32(str(i).encode()) % 4 == 2]
    assert len(got) == 203 and all(got[i].held_out for i in held) and sum(got[i].predicted == i % 2 for i in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    empty = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in empty} == {0.5}
    assert quality.classify(none, labels).count() == 0 and quality.classify(odd, labels).count() == 12


def brute_features(text):
    m64 = 2**64 - 1
    points = [0, *map(ord, text), 0]
    blank = [c in (0, 32) or 9 <= c <= 13 for c in points]
    code = [0x1234567 if b else common.mixed_one((c & 255) + 77) ^ ((c >> 8) * 0x9E3779B97F4A7C15 & m64) for c, b in zip(points, blank, strict=True)]
    found, words, start = [], [], None
    for i, b in enumerate(blank):
        if not b and start is None:
            start = i
        if b and start is not None:
            words.append(sum(code[j] * (common.mixed_one(1001 + (j - start & 63)) | 1) for j in range(start, i)) & m64)
            start = None
    found += words + [99 if a == b else (b * 0xD6E8FEB86659FD93 + a) & m64 for a, b in zip(words, words[1:])]
    for n in (1, 3, 4):
        for i in range(len(points) - n + 1):
            if not any(blank[i + k] for k in range(n) if n == 1 or 0 < k < n - 1):
                h = n
                for c in code[i : i + n]:
                    h = (h * 0x100000001B3 + c) & m64
                found.append(h)
    return Counter((h * 0x9E3779B97F4A7C15 & m64) >> 47 for h in found)


def test_quality_by_brute_force():
    texts = ["ab cd cd", "", "x", "é\U0001f600 a  b\tc", "ab", "zz zz zz q"]
    doc, bucket = quality.features(texts)
    assert [Counter(bucket[doc == i].tolist()) for i in range(len(texts))] == [brute_features(t) for t in texts]
    # the same descent with dense arrays
    examples, dense = [], []
    for i, t in enumerate(texts):
        n = brute_features(t)
        keys = np.array(sorted(n), dtype=np.int64)
        share = np.array([n[k] for k in keys.tolist()], dtype=np.float32) / max(1, sum(n.values()))
        examples.append((keys, share, i % 2))
        dense.append((dict(zip(keys.tolist(), share.tolist(), strict=True)), i % 2))
    rng = np.random.default_rng(3)
    v = rng.uniform(-1 / quality.DIMENSIONS, 1 / quality.DIMENSIONS, (quality.BUCKETS, quality.DIMENSIONS))
    w, b = np.zeros((2, quality.DIMENSIONS)), np.zeros(2)
    for step, i in enumerate([i for _ in range(6) for i in rng.permutation(len(dense))]):
        shares, label = dense[i]
        hidden = sum((x * v[k] for k, x in shares.items()), np.zeros(quality.DIMENSIONS))
        scores = np.exp(w @ hidden + b)
        off = scores / scores.sum() - np.eye(2)[label]
        rate, back = 1 - step / (6 * len(dense)), off @ w
        w, b = w - rate * np.outer(off, hidden), b - 0.1 * rate * off
        for k, x in shares.items():
            v[k] -= rate * 20 * x * back
    model = quality.QualityModel.train(examples)
    for t, p in zip(texts, model.predict(texts), strict=True):
        n = brute_features(t)
        hidden = sum((c * v[k] for k, c in n.items()), np.zeros(quality.DIMENSIONS)) / max(1, sum(n.values()))
        odds = np.exp(w @ hidden + b)
        assert p == pytest.approx(odds[1] / odds.sum(), abs=1e-4)


# ---- pieces


@pytest.fixture(scope="module")
def vocab():
    pieces, controls, scores = lattice.read_model(queries.PIECES)
    return lattice.vocabulary(pieces, controls), lattice.zipf_weights(scores, controls), controls


def segmentations(vocab, controls, unit):
    ids = {p: i for i, p in enumerate(vocab.pieces) if i not in controls and not p.startswith("<0x")}

    def go(i):
        if i == len(unit):
            yield ()
        for j in range(i + 1, len(unit) + 1):
            if unit[i:j] in ids:
                yield from ((ids[unit[i:j]], *rest) for rest in go(j))
        if i < len(unit) and unit[i] not in ids:
            yield from ((*vocab.spelled(ord(unit[i])), *rest) for rest in go(i + 1))

    return list(go(0))


def test_lattice(vocab):
    v, w, controls = vocab
    units = ["▁the", "▁oring", "▁é\U0001f600x", "▁", "▁▁▁ab", "a\nb", "▁theor"]
    found = lattice.Lattice(units, v, w)
    every = [segmentations(v, controls, u) for u in units]
    totals = [np.logaddexp.reduce([w[list(s)].sum() for s in own]) for own in every]
    assert np.allclose(found.totals(found.forward()), totals)
    assert np.allclose(found.backward()[: len(units)][found.rank], totals)
    uses = np.zeros(len(v.pieces))
    for own, total in zip(every, totals, strict=True):
        for s in own:
            np.add.at(uses, list(s), math.exp(w[list(s)].sum() - total))
    assert np.allclose(found.expected(np.ones(len(units)), len(v.pieces)), uses)


def test_sampling_is_gumbel_top_k(vocab):
    v, w, controls = vocab
    text = "or to"
    units = sampling.units_of(text)
    every = [a + b for a in segmentations(v, controls, units[0]) for b in segmentations(v, controls, units[1])]
    flat = w * 0.15
    flat[list(controls)] = -np.inf
    p = np.array([math.exp(flat[list(s)].sum()) for s in every])
    p /= p.sum()
    chance = dict(zip(every, p, strict=True))
    held = sampling.Units(v, flat)
    keys = np.random.default_rng(9).integers(0, 2**63, 4000).astype(np.uint64)
    first, second = Counter(), Counter()
    for own in sampling.sample(held, [units] * len(keys), keys, 2):
        a, b = (tuple(x[0].tolist()) for x in own)
        assert a != b and own[0][2] >= own[1][2] and own[0][1] == pytest.approx(math.log(chance[a]))
        first[a] += 1
        second[b] += 1
    for s in every:
        then = sum(chance[o] * chance[s] / (1 - chance[o]) for o in every if o != s)
        assert first[s] / len(keys) == pytest.approx(chance[s], abs=0.04) and second[s] / len(keys) == pytest.approx(then, abs=0.04)
    whole = sampling.sample(held, [units], keys[:1], len(every) + 5)[0]
    assert {tuple(x[0].tolist()) for x in whole} == set(every) and all(x[3] == 1.0 for x in whole)


def test_inclusion_weighs_samples_rightly(vocab):
    """Sums over a sample, each member divided by its inclusion, are right on average: here, the sum of all chances."""
    v, w, controls = vocab
    units = sampling.units_of("or to")
    flat = w * 0.15
    flat[list(controls)] = -np.inf
    every = [a + b for a in segmentations(v, controls, units[0]) for b in segmentations(v, controls, units[1])]
    total = np.logaddexp.reduce([flat[list(s)].sum() for s in every])
    keys = np.random.default_rng(10).integers(0, 2**63, 3000).astype(np.uint64)
    for k in (2, 4):
        sums = [sum(math.exp(logp) / inclusion for _, logp, _, inclusion in own) for own in sampling.sample(sampling.Units(v, flat), [units] * len(keys), keys, k)]
        assert np.mean(sums) == pytest.approx(1.0, abs=0.05)
    longer = [flat[list(s)].sum() - total for s in every if len(s) > 3]
    pieces = {tuple(s) for s in every if len(s) > 3}
    sums = [sum(math.exp(logp) / q for x, logp, _, q in own if tuple(x.tolist()) in pieces) for own in sampling.sample(sampling.Units(v, flat), [units] * len(keys), keys, 4)]
    assert np.mean(sums) == pytest.approx(float(np.exp(longer).sum()), rel=0.1)


def test_long_texts_without_spaces(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(30_000)) + "é\u2581\U0001f600" * 300
    docs = documents(spark, text, text * 2, ids=[1, 2])
    assert all(r.exact for r in sampling.round_trip(docs, queries.PIECES).collect())
    one, two = (r for r in sorted(scoring.score(docs, queries.PIECES).collect()))
    assert one.n_tokens == two.n_tokens == 2 and 0 > one.score > two.score > -math.inf


def test_round_trip(odd, none):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    got = sampling.round_trip(odd, queries.PIECES, 3).collect()
    assert all(r.exact and 0 < r.inclusion <= 1 for r in got if texts[r.doc_id])
    assert Counter(r.doc_id for r in got)[0] == 1 and Counter(r.doc_id for r in got)[4] == 6
    key = lambda df: sorted((r.doc_id or -1, r.sample, r.pieces_sha256) for r in df.collect())
    assert key(sampling.round_trip(odd, queries.PIECES, 3)) == key(sampling.round_trip(odd.repartition(7), queries.PIECES, 3))
    assert sampling.round_trip(none, queries.PIECES).count() == 0
    assert sampling.encode(none, queries.PIECES).columns == ["doc_id", "sample", "pieces", "logp", "perturbed", "inclusion"]


def test_texts_are_spelled_and_decoded_by_batches(vocab):
    pieces = vocab[0] if isinstance(vocab, tuple) else vocab
    plain = next(i for i, p in enumerate(pieces.pieces) if p == lattice.SPACE)
    word = next(i for i, p in enumerate(pieces.pieces) if p == lattice.SPACE + "the")
    rows, want = [[plain, -1 - ord("é"), -1 - ord("é")], [], [word, -1 - lattice.MARK, word], [plain, -1 - 0x1F600]], ["éé", "", "the▁ the", "\U0001f600"]
    flat, ends = np.array([x for r in rows for x in r], dtype=np.int32), np.append(0, np.cumsum([len(r) for r in rows]))
    ids, after = sampling.spell(pieces, flat, ends)
    assert [ids[i:j].tolist() for i, j in zip(after[:-1], after[1:])] == [[y for x in r for y in (pieces.spelled(-1 - x) if x < 0 else [x])] for r in rows]
    assert sampling.decode(pieces, pa.array(ids), after) == want
    same, unmoved = sampling.spell(pieces, flat[:1], np.array([0, 1]))
    assert same.tolist() == [plain] and unmoved.tolist() == [0, 1]
    assert sampling.decode(pieces, pa.array([], pa.int32()), np.array([0, 0, 0])) == ["", ""]


def test_units_that_pass_are_forgotten(vocab):
    v, w, _ = vocab
    small, large = sampling.Units(v, w, most_arcs=50), sampling.Units(v, w)
    texts = [sampling.units_of(f"some words here {i} and others {i * 7}") for i in range(12)]
    keys = np.arange(12, dtype=np.uint64)
    for i in range(12):
        a, b = (sampling.sample(u, [texts[i]], keys[i : i + 1], 2)[0] for u in (small, large))
        assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b]


@pytest.mark.parametrize("usual", [0, 5, 100_000])
def test_scores(spark, corpus, vocab, usual):
    """Against sums over all segmentations, one by one, with weights fitted by such sums."""
    v, weights, controls = vocab
    rounds = 1
    few = corpus.where("doc_id % 4 = 0 AND doc_id <> 115").withColumn("text", F.substring("text", 1, 40))
    got = {r.doc_id: r for r in scoring.score(few, queries.PIECES, most_usual=usual, rounds=rounds).collect()}
    docs = {r.doc_id: (r.text or "").encode().lower().split() for r in few.collect()}
    learn = {i for i in docs if crc32(str(i).encode()) % 10}
    counts = Counter(w for i in learn for w in docs[i])
    ways = {w: segmentations(v, controls, "▁" + w.decode()) for own in docs.values() for w in own}
    uses = np.full(len(v.pieces), 0.05)
    uses[list(controls)] = 0
    for w, n in counts.items():
        logs = [weights[list(s)].sum() for s in ways[w]]
        for s, p in zip(ways[w], np.exp(logs - np.logaddexp.reduce(logs)), strict=True):
            np.add.at(uses, list(s), n * p)
    with np.errstate(divide="ignore"):
        fitted = np.log(uses / uses.sum())
    total = lambda w, by: np.logaddexp.reduce([by[list(s)].sum() for s in ways[w]])
    words, counts[b""] = dict(counts), len(learn)
    size, kinds = sum(counts.values()), len(counts)
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    off = min(0.95, max(0.1, once / (once + 2 * twice)))
    end = math.log((len(learn) - off) / size)
    for i, own in docs.items():
        tokens = [*own, b""]
        r = got[i]
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (size + 0.1 * (kinds + 1))) for w in tokens))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(counts[w] > 0 for w in tokens), size, i not in learn)
        assert r.score * math.log(10) == pytest.approx(sum(total(w, fitted) for w in own) + end)
        assert r.vocabulary_score * math.log(10) == pytest.approx(sum(total(w, weights) for w in own) + end)
        joint = sum(math.log(max(words.get(w, 0) - off, 0) / size + off * kinds / size * math.exp(total(w, fitted))) for w in own)
        assert r.word_score * math.log(10) == pytest.approx(joint + end)


def test_scores_odd_rows(odd, none):
    got = scoring.score(odd, queries.PIECES).collect()
    assert len(got) == 12 and {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert scoring.score(none, queries.PIECES).count() == 0


# ---- queries and the pipeline


@pytest.fixture(scope="module")
def duck():
    return tables("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    assert_same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), duck, queries.ORACLE_SQL[name])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, before, "/root/testdata/sf0.001"), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.text in texts[r.doc_id] for r in docs.collect())
            before = docs
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == docs.count()


def test_names_that_operators_use(spark):
    names = ["doc_id", "text", "source", "row", "set", "size", "fp", "prefix", "counts", "digest", "best", "uses", "component", "node", "c1"]
    docs = spark.createDataFrame([(i, t, f"s{i % 2}", *range(12)) for i, t in enumerate(["a b c d e f g", "a b c d e f g", "A b c d e f g", "x y", None])], ", ".join(f"{n} {'string' if n in ('text', 'source') else 'long'}" for n in names))
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == names and rows(kept.select("doc_id", "c1", "digest")) == [(i, 11, 6) for i in (1, 2, 3, 4)]
    kept = near.deduplicate(docs)
    assert kept.columns == names and rows(kept.select("doc_id", "set", "node")) == [(i, 1, 10) for i in (0, 3, 4)]
    mixed_ = mixing.Mixture(docs, block_words=4).documents()
    assert mixed_.columns == names and {r.row for r in mixed_.collect()} == {0}
    assert mixing.mix(docs).count() == 5


def test_stages_on_odd_rows(spark, odd, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, "/nowhere")
            rows = out.collect()
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
            assert rows if docs is odd else not rows
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, odd, "").collect()}
    assert kept == {3, 4, 5, 6, 7, 10, None}
