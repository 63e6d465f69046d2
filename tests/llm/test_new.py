"""Language identification, conversation tries and vector codes against brute force and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parimutuel.llm import codes, kernels, prefix_trie
from parimutuel.llm import queries as Q

from .conftest import CLASHES, LONG

# --- language identification

WORDS = {"en": "the of and that with from this which were", "de": "der und die nicht mit eine auch wird über", "fr": "le des et que pour une dans être où"}


def sentences(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_kernel_is_the_presence_kernel():
    texts = ["The cat, the hat!", "le chat 12 et le chien", "", "...", "ÉÉ é", "a"]

    def brute(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        line = f" {' '.join(words)} " if words else ""
        return {line[i : i + n] for n in range(1, 5) for i in range(len(line) - n + 1)}

    marks = Q.kernels.Landmarks([texts[0], texts[1]])
    sets = [brute(t) for t in texts]
    want = [[len(s & m) / math.sqrt(len(s) * len(m)) if s else 0 for m in sets[:2]] for s in sets]
    assert np.allclose(marks.kernel(texts), want)


def test_languages_of_unseen_texts(spark, documents):
    pairs = [(i, sentences(list(WORDS)[i % 3], 12, i)) for i in range(200)]
    docs = documents(pairs).withColumn("lang", F.element_at(F.array(*map(F.lit, WORDS)), (F.col("doc_id") % 3 + 1).cast("int")))
    got = {r.doc_id: r for r in kernels.languages(docs).collect()}
    assert len(got) == 200
    for i, _ in pairs:
        assert got[i].held_out == held(i) and got[i].lang_pred == list(WORDS)[i % 3] and 0.5 < got[i].score <= 1


def test_only_training_text_and_language_count(spark, documents):
    pairs = [(i, sentences("en" if i % 2 else "de", 8, i)) for i in range(60)]
    docs = documents(pairs).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    other = docs.withColumns({"lang": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")), "source": F.lit("else")})
    rows = lambda d: sorted(map(tuple, kernels.languages(d).collect()))
    assert rows(docs) == rows(other) == rows(docs.repartition(7))


def test_scores_do_not_depend_on_neighbours():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 6):
        model = kernels.Model([*map(str, range(n))], [], r.normal(size=(129, n)))
        kernel = r.random((300, 128))
        whole = model.scores(kernel)
        for size in (1, 3, 7, 50):
            assert np.array_equal(whole, np.concatenate([model.scores(kernel[a : a + size]) for a in range(0, 300, size)]))


def test_languages_of_odd_rows(spark, odd, documents):
    got = kernels.languages(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (1, 2, 3, 10):
            assert (r.lang_pred, r.score) == ("und", 0)
        if r.doc_id in (4, 5, 6, 7, 8, 9):
            assert r.lang_pred == "en"
    assert kernels.languages(odd.where("false")).collect() == []
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in kernels.languages(unlabelled).collect()} == {"und"}


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.QUERIES["op11_language_id"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


# --- conversation tries


def brute_trie(rows, borrow):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if borrow else 0
        built[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children, out = defaultdict(list), []
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        value = (len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0
        parts = [below(c) for c in children[p]]
        return max(1, sum(leaves for leaves, _ in parts)), value + sum(v for _, v in parts)

    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 60), 77, 81, 100, -3, -20, -21]:
        for t in range(r.choice([1, 2, 3, 5])):
            rows.append((c, r.choice([t, t, None, 1]), r.choice(["user", "assistant", None]), r.choice(["a b", "a b", "c", None, "", "é  x\n"])))
    rows += [(5, 9, "user", "again")] * 3 + [(None, 1, "user", "nobody")] * 2
    rows += [(40, t, "user", f"t{t // 2} w") for t in range(10, 90)] + [(41, t, "user", f"t{t // 2} w") for t in range(10, 90)]
    return rows


TRIE = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits,borrow", [(64, True), (64, False), (2, True), (0, False)])
def test_trie(spark, bits, borrow):
    """Few bits make fingerprints collide all the time; turns are dealt over partitions that no conversation fits."""
    rows = some_conversations(bits)
    conversations = spark.createDataFrame(rows, TRIE).select("*", *(F.lit(7).alias(c) for c in {*CLASHES, "k", "depth", "fp", "path", "part"}))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.prefix_trie(conversations, prefix_trie.by_block(F.col("conv_id")) if borrow else None, bits).drop("fingerprint").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got), key=str) == brute_trie(rows, borrow)


def test_trie_of_odd_tables(spark):
    empty = spark.createDataFrame([], TRIE)
    assert prefix_trie.prefix_trie(empty).collect() == []
    # 1 borrows nothing that is there and loses what it has: only the root is left.
    one = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    got = prefix_trie.prefix_trie(spark.createDataFrame([(one, None, None, None)], TRIE), prefix_trie.by_block(F.col("conv_id"))).collect()
    assert [tuple(r)[:8] for r in got] == [(one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())]
    long = spark.createDataFrame([(c, t, "user", LONG) for c in (0, 1) for t in range(2)], TRIE)
    assert {(r.depth, r.n_convs, r.saved_tokens) for r in prefix_trie.prefix_trie(long).collect()} == {(0, 2, 120_000), (1, 2, 120_000), (2, 2, 60_000)}


def test_ends_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = [(c, 0, "user", "same") for c in range(50)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TRIE)).where("depth = 1").collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(map(str, range(50))).encode()).hexdigest()]


# --- vector codes

VECTORS = "vec_id long, embedding array<double>, label int"


def brute_codes(rows, dims):
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    cut = lambda v: [math.floor(256 * x) for x in v] + [0] * (dims - len(v))
    good = sorted(((r[0] is None, r[0] or 0, cut(r[1]), r[2]) for r in good), key=lambda r: r[:3])
    w = dims // 16
    books = [[r[2][p * w : (p + 1) * w] for r in good[:64]] for p in range(16)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))

    for _ in range(2):
        for p, book in enumerate(books):
            held = defaultdict(list)
            for r in good:
                v = r[2][p * w : (p + 1) * w]
                held[near(v, book)[1]].append(v)
            for i, vs in held.items():
                book[i] = [sum(c) // len(vs) for c in zip(*vs)]
    out, of = [], defaultdict(int)
    for null, vec_id, v, label in good:
        found = [near(v[p * w : (p + 1) * w], b) for p, b in enumerate(books)]
        error = sum(d for d, _ in found)
        of[label] += error
        out.append((None if null else vec_id, bytes(i for _, i in found).hex(), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, of[label], sha) for i, c, e, label in out), key=str)


@pytest.mark.parametrize("n,dims", [(300, 32), (20, 16), (100, 48)])
def test_vector_codes(spark, n, dims):
    r = random.Random(n)
    rows = [(r.choice([i, i, i // 2, None]), [r.choice([0.0, -0.5, r.gauss(0, 1), 0.25]) for _ in range(dims)], r.choice([1, 2, None])) for i in range(n)]
    rows += [(1, None, 1), (2, [math.nan] * dims, 1), (3, [None] + [0.0] * (dims - 1), 1), (4, [math.inf] * dims, None), rows[0], rows[0]]
    vectors = spark.createDataFrame(rows, VECTORS).select("*", *(F.lit(7).alias(c) for c in {*CLASHES, "code", "error", "v"}))
    got = codes.vector_codes(vectors).collect()
    assert sorted(map(tuple, got), key=str) == brute_codes(rows, dims)


def test_partial_distances_are_exact():
    r = np.random.default_rng(1)
    for width in (1, 3, 4, 8):
        rows, entries = r.integers(-9, 9, (500, width)), r.integers(-9, 9, (64, width))
        index, distance = codes.nearest(rows, entries)
        every = ((rows[:, None] - entries) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_vector_codes_of_odd_tables(spark):
    assert codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    ragged = [(1, [1.0] * 20, 1), (2, [1.0], 1), (3, [], None), (4, [1e30] * 20, 1)]
    got = codes.vector_codes(spark.createDataFrame(ragged, VECTORS)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4} and all(r.error == 0 for r in got)


def test_codes_stand_for_vectors(spark):
    r = random.Random(3)
    vectors = codes.kept(spark.createDataFrame([(i, [r.random() for _ in range(16)], 0) for i in range(64)], VECTORS), "label")
    books = codes.codebooks(vectors)
    back = {x.vec_id: x.embedding for x in codes.decoded(codes.encoded(vectors, books), books).collect()}
    for row in vectors.collect():
        assert max(abs(a - b) for a, b in zip(back[row.vec_id], row.v)) < 0.01


@pytest.mark.parametrize("name", ["trie_nodes", "op13_vector_codes"])
def test_sql_agrees(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got, want = Q.QUERIES[name](spark, sf).toPandas(), con.sql(Q.ORACLE[name]).df()
    rows = lambda f: sorted(f[sorted(f.columns)].astype(str).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
