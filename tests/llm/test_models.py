"""Language-model scoring and toxicity."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parimutuel.llm import common, ctw, toxicity

SF = "/root/testdata/sf0.01"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


def brute_base(texts):
    counts = Counter()
    for doc, t in texts:
        if not held(doc):
            counts.update(low(t).split())
            counts[None] += 1
    total, types = sum(counts.values()), len(counts)
    out = []
    for doc, t in texts:
        words = [*low(t).split(), None]
        out.append((doc, held(doc), len(words), sum(counts[w] > 0 for w in words), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in words)))
    return out


class Tree:
    """Context-tree weighting by its definition: one tree a bit prefix, contexts as strings."""

    def __init__(self, texts, depth):
        self.depth = depth
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            t = b"\xff" * depth + t + b"\xff"
            for i in range(depth, len(t)):
                for prefix, bit in self.bits(t[i]):
                    for d in range(depth + 1):
                        self.counts[t[i - d : i], prefix][bit] += 1
                        if d:
                            self.children[t[i - d + 1 : i], prefix].add(t[i - d : i])

    @staticmethod
    def bits(byte):
        return [((1 << k) | byte >> (8 - k), byte >> (7 - k) & 1) for k in range(8)]

    @staticmethod
    def own(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    def coded(self, node, prefix):
        own = self.own(self.counts[node, prefix])
        if len(node) == self.depth:
            return own
        inner = sum(self.coded(c, prefix) for c in self.children[node, prefix])
        return np.logaddexp(own, inner) - math.log(2)

    def predict(self, context, prefix, bit):
        """From the deepest node up to the root; counts of nought where training saw no node."""
        p = 0.5
        for d in range(self.depth, -1, -1):
            node = context[len(context) - d :]
            if (node, prefix) in self.counts:
                n = self.counts[node, prefix]
                share = 1 if d == self.depth else math.exp(self.own(n) - math.log(2) - self.coded(node, prefix))
                p = share * (n[bit] + 0.5) / (sum(n) + 1) + (1 - share) * p
        return p

    def score(self, t):
        t = b"\xff" * self.depth + t + b"\xff"
        return sum(math.log10(self.predict(t[i - self.depth : i], prefix, bit)) for i in range(self.depth, len(t)) for prefix, bit in self.bits(t[i]))


@pytest.fixture(scope="module")
def small():
    r = random.Random(1)
    return [(i, None if i == 3 else " ".join(r.choice(["the", "cat", "Sat", "on", "é", "mat"]) for _ in range(r.randint(0, 12)))) for i in range(24)] + [(None, "the cat"), (5, "the"), (5, "the")]


@pytest.mark.parametrize("depth", [0, 2, 5])
def test_scores_are_the_definition(documents, small, depth):
    tree = Tree([low(t) for d, t in small if not held(d)], depth)
    got = [r[:7] for r in ctw.language_scores(documents(small), depth=depth).collect()]
    key = lambda r: tuple((x is None, x) for x in r[:1]) + tuple(r[1:4])
    want = sorted(((*b, tree.score(low(t))) for b, (_, t) in zip(brute_base(small), small)), key=key)
    for g, w in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6)


def test_scores_of_whole_texts_are_the_definition(spark):
    """Far more nodes than in the small case, some texts known to training and some not."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 7 < 3")
    texts = [(r.doc_id, low(r.text)) for r in docs.collect()]
    tree = Tree([t for d, t in texts if not held(d)], 5)
    assert len(tree.counts) > 100_000
    coded = cache(tree.coded)
    tree.coded = coded
    got = {r.doc_id: r for r in ctw.language_scores(docs).collect()}
    for d, t in texts:
        if len(t) < 3000:
            assert got[d].score == pytest.approx(tree.score(t), rel=1e-6)
            assert got[d].bits_per_byte == pytest.approx(-tree.score(t) * math.log2(10) / (len(t) + 1), rel=1e-6)


@pytest.mark.parametrize("part,block", [(1 << 20, 16 << 20), (40, 100)])
def test_predictions_of_parts_and_blocks(documents, small, monkeypatch, part, block):
    """Pieces, blocks and copies in several tasks change nothing."""
    monkeypatch.setattr(ctw, "PART", part)
    monkeypatch.setattr(ctw, "BLOCK", block)
    tree = Tree([low(t) for d, t in small if not held(d)] * 2, 4)
    docs = documents(small).union(documents(small)).repartition(3)
    got = {r.name: r.score for r in ctw.predicted(docs, 4, split=2).collect()}
    assert set(got) == {ctw.text_name(low(t)) for _, t in small}
    for _, t in small:
        assert got[ctw.text_name(low(t))] == pytest.approx(tree.score(low(t)), rel=1e-6)


def test_predictions_add_up_to_one(spark, documents, small, tmp_path):
    docs = documents(small).where("doc_id IS NOT NULL")
    with common.Tables(spark) as tables:
        counts = ctw.counted_runs(tables.store(ctw.blocks(docs, 3)), 3).groupBy("run").agg(F.sum("n").alias("n"))
        r = np.random.default_rng(0)
        every = [(context << 8 | byte, 0) for context in (0x656874, 0xFFFFFF, 0x00A9C3, int(r.integers(0, 2**24))) for byte in range(256)]
        counts = tables.store(counts.union(spark.createDataFrame(every, "run long, n long")).groupBy("run").agg(F.sum("n").alias("n")))
        logs = ctw.logarithms(counts, ctw.outside(tables.store(ctw.deep_nodes(counts, 3, 2)), 2, tables), 3, 2)
        got = {x.run: x.log for x in logs.collect()}
    for context in {run >> 8 for run, _ in every}:
        assert sum(10 ** got[context << 8 | byte] for byte in range(256)) == pytest.approx(1, abs=1e-9)


def test_runs_travel_in_buckets(documents, monkeypatch):
    """What several blocks hold is stored packed: no table has a row for each run of each block."""
    stored, store = [], common.Tables.store
    monkeypatch.setattr(common.Tables, "store", lambda self, df: (out := store(self, df), stored.append(out.count()))[0])
    r = random.Random(4)
    pairs = [(i, " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(300))) for i in range(8)]
    docs = documents(pairs * 24).repartition(8)  # nearly every text in every block
    distinct = {p[i : i + 6] for _, t in pairs for p in [b"\xff" * 5 + low(t) + b"\xff"] for i in range(len(p) - 5)}
    ctw.predicted(docs, 5)
    assert len(distinct) in stored and max(stored) < 6 * len(distinct)


def test_runs_in_parts(monkeypatch):
    texts = [b"abc", b"", b"x" * 50, b"\xc3\xa9"]
    padded = [b"\xff" * 5 + t + b"\xff" for t in texts]
    want = [(int.from_bytes(p[i : i + 5][::-1] + p[i + 5 : i + 6], "big"), k) for k, p in enumerate(padded) for i in range(len(p) - 5)]
    for part in (1 << 20, 7):
        monkeypatch.setattr(ctw, "PART", part)
        cut = [(k, p) for k, t in enumerate(texts) for p in ctw.pieces(t, 5)]
        assert [(int(g), cut[int(k)][0]) for a, b in ctw.runs([p for _, p in cut], 5) for g, k in zip(a, b)] == want


def test_keys_stay_whole():
    keys = [0, 0, 1, 1, 1, 2, 5, 5, 5, 5, 5, 6]
    for size in (1, 2, 5, 12):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size])], names=["k"]) for i in range(0, len(keys), size)]
        got = [t["k"].to_pylist() for t in ctw.whole_keys(iter(batches), 0, least=2)]
        assert sum(got, []) == keys and all(a[-1] != b[0] for a, b in zip(got, got[1:]))


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 100.5, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11)


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(ctw, "PART", 3)
    text = b"one two  three\n\nfour five one " * 20
    assert ctw.word_counts(text) == Counter(text.split())


def test_rare_words_are_joined(documents, small, monkeypatch):
    monkeypatch.setattr(ctw, "COMMON", 2)
    got = ctw.language_scores(documents(small), depth=1).collect()
    want = brute_base(small)
    assert sum(r.n_known for r in got) == sum(w[3] for w in want)
    assert sum(r.base_score for r in got) == pytest.approx(sum(w[5] for w in want), rel=1e-9)


def test_scores_of_odd_tables(documents, odd):
    got = ctw.language_scores(odd, depth=2)
    rows = got.collect()
    assert len(rows) == odd.count() and all(r.score < 0 and r.n_tokens >= 1 for r in rows)
    assert ctw.language_scores(odd.limit(0), depth=2).count() == 0
    only = documents([(next(i for i in range(99) if held(i)), "a b")])
    r = ctw.language_scores(only, depth=2).first()
    assert r.held_out and (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score == pytest.approx(8 * 4 * math.log10(0.5), rel=1e-6)


# --- toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = docs.join(labels, "doc_id").orderBy("doc_id").collect()
    train, test = [r for r in rows if r.doc_id % 3], [r for r in rows if r.doc_id % 3 == 0]
    of = lambda rs: np.array([[1 - r.quality, r.toxic] for r in rs], np.float32)
    chain = toxicity.train([r.text for r in train], of(train), ("low_quality", "toxic"))
    z, y = chain.logits([r.text for r in test]), of(test)
    quality, toxic = ((z[:, k] > chain.thresholds[k]) == y[:, k] for k in (0, 1))
    assert quality.mean() > 0.88 and toxic.mean() > 0.9
    assert ((z[:, 1] > chain.thresholds[1]) & (y[:, 1] == 0)).sum() <= 3


def test_planted_words(documents, spark):
    r = random.Random(0)
    clean = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    bad = ["zzvile", "qqnasty", "xxawful"]
    pairs, labels = [], []
    for i in range(400):
        words = r.choices(clean, k=r.randint(20, 200))
        toxic = i % 4 == 0
        for _ in range(toxic * max(2, len(words) // 20)):
            words[r.randrange(len(words))] = r.choice(bad)
        pairs.append((i, " ".join(words)))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    docs = documents(pairs)
    chain = toxicity.trained(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x.toxic for x in toxicity.toxicity(docs, chain).collect()}
    assert sum(got[i] == (i % 4 == 0) for i in range(300, 400)) >= 97
    kept = toxicity.accepted(docs, chain)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, t in got.items() if not t}


def test_chain_feeds_earlier_categories():
    r = np.random.default_rng(0)
    texts = [("alphaone " if a else "plainword ") * 3 + f"n{i}" for i, a in enumerate(r.random(200) < 0.5)]
    y = np.array([[t.startswith("alpha")] * 2 for t in texts], np.float32)
    chain = toxicity.train(texts, y, ("first", "second"))
    assert len(chain.models[1].weights) == len(chain.models[0].weights) + 1 and chain.models[1].weights[-1] > 0


def test_rates_do_not_depend_on_neighbours():
    r = random.Random(2)
    texts = ["", "one", "two three " * 40, "ÉTÉ été", "x" * 5000] + [" ".join(r.choices(["ab", "cd", "efgh"], k=30)) for _ in range(5)]
    chosen = np.arange(1 << toxicity.HASH_BITS)[::7]
    alone = np.concatenate([toxicity.rates([t], chosen) for t in texts])
    assert np.array_equal(toxicity.rates(texts, chosen), alone)


def test_rates_in_parts(monkeypatch):
    texts = ["one two three four five six seven", "", "eight nine ten"]
    chosen = np.arange(1 << toxicity.HASH_BITS)
    want = toxicity.rates(texts, chosen)
    monkeypatch.setattr(toxicity, "PART", 5)
    assert np.array_equal(toxicity.rates(texts, chosen), want)


def test_toxicity_of_odd_tables(spark, odd, labelled):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, None), (6, None, 1), (None, 1, 1), (7, 0, 1), (7, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), labels.where("toxic = 0")):
        chain = toxicity.trained(odd, given)
        got = toxicity.toxicity(odd, chain)
        assert got.count() == odd.count() and got.where("p_toxic IS NULL").count() == 0
        kept = toxicity.accepted(odd, chain)
        assert kept.columns == odd.columns
        if given is not labels:
            assert kept.count() == odd.count()
    assert toxicity.toxicity(odd.limit(0), chain).count() == 0 and toxicity.accepted(odd.limit(0), chain).count() == 0
    assert toxicity.sample(*labelled, 20).count() == 20
    assert toxicity.toxicity(odd, chain).select(F.max("p_toxic")).first()[0] <= 1


def test_training_sample_never_varies(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (None, "x"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for parts in (1, 3):
        got = toxicity.sample(docs.repartition(parts), labels, 10).collect()
        assert [(r.doc_id, r.text, r.is_toxic) for r in got] == [(1, "a", 0), (2, None, 1)]


def test_scoring_memory_is_bounded():
    chain = toxicity.Chain(("toxic",), np.arange(1200), (toxicity.Linear(np.zeros(1204, np.float32), 0.0),), (0.0,))
    chain.logits(["warm up"])
    for texts in (["some short text"] * 20_000, ["of" + "long" * 500_000]):
        tracemalloc.start()
        assert len(chain.logits(texts)) == len(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6, peak
