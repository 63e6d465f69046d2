"""Operators that compare texts, against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parimutuel.llm import components, decontaminate, jaccard, lines, paragraphs, simhash
from parimutuel.llm.common import grams, words_of


class Sets:
    """Union-find."""

    def __init__(self, items):
        self.p = {i: i for i in items}

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)

    def __call__(self):
        return {x: self.find(x) for x in self.p}


@pytest.mark.parametrize("few", [400_000, 0], ids=["one task", "rounds"])
@pytest.mark.parametrize("shape", ["path", "star", "random", "cycle", "loops"])
def test_components(spark, monkeypatch, shape, few):
    monkeypatch.setattr(components, "FEW", few)
    r = random.Random(1)
    n = 60
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(77, i) for i in range(n)], "random": [(r.randrange(200), r.randrange(200)) for _ in range(90)], "cycle": [(i, (i + 1) % n) for i in range(n)], "loops": [(1, 1), (2, 3), (3, 2), (None, 4)]}[shape]
    want = Sets({x for e in edges if None not in e for x in e})
    for a, b in edges:
        if None not in (a, b):
            want.join(a, b)
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    assert {r.node: r.component for r in got.collect() if r.node != 1 or shape != "loops"} == {k: v for k, v in want().items() if k != 1 or shape != "loops"}


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash


def brute_fingerprint(text):
    words = text.encode().lower().split() if text.isascii() else words_of(text)
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(r, n):
    base = ["".join(r.choices("abcde", k=4)) for _ in range(400)]
    out = [None, "", " ", "One two", "one TWO"]
    while len(out) < n:
        words = r.choices(base, k=r.randint(1, 300))
        out.append(" ".join(words))
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(base)
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("leaf,large", [(4096, 16384), (8, 20)])
def test_simhash(documents, monkeypatch, leaf, large):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "TOO_LARGE", large)
    texts = near_texts(random.Random(4), 160)
    fps = {i: brute_fingerprint(t or "") for i, t in enumerate(texts)}
    want = Sets(fps)
    for i in fps:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                want.join(i, j)
    got = simhash.near_duplicates(documents(enumerate(texts))).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == want()


@pytest.mark.parametrize("rounds", [20, 0], ids=["vantage points", "bits"])
def test_close_variants_are_cut_further(spark, monkeypatch, rounds):
    """A crowded ball, which the first levels leave whole."""
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    monkeypatch.setattr(simhash, "LEAF", 64)
    monkeypatch.setattr(simhash, "TOO_LARGE", 64)
    r = random.Random(2)
    fps = sorted({r.getrandbits(64) if k % 3 else 0x1234567890ABCDEF ^ sum(1 << b for b in set(r.choices(range(64), k=6))) for k in range(900)})
    want = Sets(fps)
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 2:
                want.join(x, y)
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = Sets(fps)
    for e in simhash.links(spark.createDataFrame(rows, "fp long"), 2).collect():
        got.join(e.a % (1 << 64), e.b % (1 << 64))
    assert got() == want()


def test_majority_of_long_groups():
    r = np.random.default_rng(0)
    groups = [r.integers(0, 2**64, n, np.uint64).tolist() for n in (1, 2, 254, 255, 256, 510, 511, 1000)] + [[]]
    for g, f in zip(groups, simhash.majorities(groups)):
        assert int(f) % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in g) > len(g))


def jaccard_classes(sets, threshold):
    want = Sets(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and c >= threshold * (len(sets[i]) + len(sets[j]) - c):
                want.join(i, j)
    return want()


WAYS = pytest.mark.parametrize("small,block,direct", [(16, 2048, 4096), (1, 7, 4096), (1, 7, 3), (2, 50, 3)], ids=["pairs", "blocks", "rarest", "mixed"])


def search_so(monkeypatch, small, block, direct):
    """Let all buckets be searched pair by pair, block by block or by rarest members."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "DIRECT", direct)


@WAYS
def test_near_copies(documents, monkeypatch, small, block, direct):
    search_so(monkeypatch, small, block, direct)
    r = random.Random(8)
    base = ["".join(r.choices("abcdefgh", k=5)) for _ in range(2000)]
    texts = []
    for _ in range(12):
        words = r.choices(base, k=r.randint(60, 200))
        for _ in range(8):
            new = list(words)
            for _ in range(r.randint(0, 5)):
                new[r.randrange(len(new))] = r.choice(base)
            texts.append(" ".join(new))
    want = jaccard_classes([set(grams(words_of(t), 5)) for t in texts], 0.8)
    got = {x.doc_id: x.component_id for x in simhash.near_copies(documents(enumerate(texts))).collect()}
    assert got == want
    kept = simhash.near_dedup(documents(enumerate(texts)))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))


def test_near_dedup_of_odd_rows(odd):
    got = simhash.near_dedup(odd)
    assert got.columns == odd.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(4) == 1 and 5 not in ids and ids.count(None) == 2 and {1, 6, 7, 8, 9} <= set(ids) and 2 not in ids
    assert simhash.near_dedup(odd.limit(0)).count() == 0


def test_overlaps():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 30))) for _ in range(40)]
    left, right = np.full(40, -1), np.full(40, -1)
    left[:25], right[15:] = np.arange(25), np.arange(25)
    got = jaccard.overlaps(np.repeat(np.arange(40), [len(s) for s in sets]), np.concatenate(sets), left, right)
    assert all(got[i, j] == len(set(sets[i]) & set(sets[15 + j])) for i in range(25) for j in range(25))


def test_bands_reach_the_recall():
    bands, rows = jaccard.tuned(0.8, 0.995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995


# --- paragraphs


@WAYS
def test_paragraphs(documents, monkeypatch, small, block, direct):
    search_so(monkeypatch, small, block, direct)
    r = random.Random(5)
    base = ["".join(r.choices("abcdefgh", k=5)) for _ in range(3000)]
    pool = [r.choices(base, k=r.randint(30, 90)) for _ in range(12)]
    texts = []
    for _ in range(50):
        parts = []
        for _ in range(r.randint(1, 4)):
            words = list(r.choice(pool)) if r.random() < 0.6 else r.choices(base, k=r.randint(10, 80))
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(base)
            parts.append(" ".join(words))
        texts.append("\n".join(parts))
    places = [(i, a, b, set(grams(w, 5))) for i, t in enumerate(texts) for _, a, b, w in paragraphs.paragraphs_of(t, 45)]
    classes = jaccard_classes([p[3] for p in places], 0.8)
    want = {(*places[k][:3], *places[c][:2]) for k, c in classes.items() if k != c}
    got = {(r.doc_id, r.start, r.end, r.kept_doc_id, r.kept_start) for r in paragraphs.similar_paragraphs(documents(enumerate(texts))).collect()}
    assert len(want) > 15 and got == want


def test_embedded_passages(documents):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    fill = lambda n: [word() for _ in range(n)]
    shared = [fill(r.randint(51, 120)) for _ in range(4)]
    pairs = [(i, " ".join(fill(r.randint(0, 80)) + (shared[i % 5] if i % 5 < 4 else []) + fill(r.randint(0, 80)))) for i in range(60)]
    got = paragraphs.repeated_passages(documents(pairs)).collect()
    assert {x.doc_id for x in got} == {i for i in range(5, 60) if i % 5 < 4}
    assert {x.doc_id for x in got if x.kept_doc_id == x.doc_id % 5} == {x.doc_id for x in got}
    assert all(x.kept_doc_id % 5 == x.doc_id % 5 and x.kept_doc_id < x.doc_id for x in got)
    texts = dict(pairs)
    for x in got:
        assert texts[x.kept_doc_id][x.kept_start :].startswith(texts[x.doc_id][x.start : x.start + 40])
        assert texts[x.doc_id][x.start : x.end] in " ".join(shared[x.doc_id % 5])


def repeated_runs(pairs, length):
    """Brute force: of each text, places of its words, and which of its runs of so many words an earlier place has too."""
    seen, out = {}, {}
    for i, text in sorted(pairs):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        names = [text[a:b].lower() for a, b in words]
        runs = range(max(0, len(words) - length + 1))
        out[i] = words, np.array([seen.setdefault(tuple(names[k : k + length]), (i, k)) != (i, k) for k in runs], bool)
    return out


@pytest.mark.parametrize("part", [1 << 19, 23])
def test_passages_against_brute_force(monkeypatch, documents, part):
    """Pasted passages of 12 to 60 words, some with changed words, at any place of a text, edges and periodic texts included."""
    monkeypatch.setattr(paragraphs, "PART", part)
    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    fill = lambda n: [word() for _ in range(n)]
    pool = [fill(n) for n in (12, 15, 18, 19, 20, 20, 21, 24, 28, 32, 36, 40, 45, 60)]
    pairs = []
    for i in range(260):
        parts = fill(r.choice((0, 3, 30)))
        for _ in range(r.randint(0, 2)):
            piece = list(r.choice(pool))
            if r.random() < 0.4:
                piece[r.randrange(len(piece))] = word()
            cut = r.randrange(4) if r.random() < 0.3 else 0
            parts += piece[cut:] + fill(r.choice((0, 1, 5, 30)))
        pairs.append((i, r.choice((" ", "\n", " é ")).join(parts)))
    pairs += [(300, "na " * 90), (301, "one two three " * 30), (302, "x"), (303, "Na " * 19)]
    slack = paragraphs.GUARANTEE - paragraphs.WIDTH
    spans = defaultdict(list)
    for x in paragraphs.repeated_passages(documents(pairs)).collect():
        spans[x.doc_id].append((x.start, x.end))
        texts = dict(pairs)
        assert (x.kept_doc_id, x.kept_start) < (x.doc_id, x.start)
        first = texts[x.doc_id][x.start : x.end].lower().split()[: paragraphs.WIDTH]
        assert texts[x.kept_doc_id][x.kept_start :].lower().split()[: paragraphs.WIDTH] == first
    chance = found = 0
    for i, (words, again) in repeated_runs(pairs, paragraphs.GUARANTEE).items():
        covered = np.array([any(a <= p and q <= b for a, b in spans[i]) for p, q in words], bool)
        edges = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0))
        allowed = np.zeros(len(words), bool)
        for a, b in zip(edges[::2], edges[1::2] + paragraphs.GUARANTEE - 1):
            found += 1
            allowed[a:b] = True
            assert covered[a + slack : b - slack].all() and covered[a:b].sum() >= paragraphs.WIDTH
        chance += bool((covered & ~allowed).any())
    assert found > 60 and chance <= 1


@pytest.mark.parametrize("words", [20, 28, 36, 45])
def test_recall_of_embedded_passages(documents, words):
    r = random.Random(words)
    fill = lambda n: ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]
    pairs = []
    for i in range(300):
        shared = fill(words)
        pairs += [(k, " ".join(fill(40) + shared + fill(40))) for k in (i, 1000 + i)]
    pairs += [(2000 + i, " ".join(fill(100))) for i in range(300)]
    assert {x.doc_id for x in paragraphs.repeated_passages(documents(pairs)).collect()} == set(range(1000, 1300))


def test_passage_longer_than_its_anchor(documents):
    with pytest.raises(ValueError):
        paragraphs.repeated_passages(documents([]), 28, 51)


def test_passages_of_frequent_anchors_and_small_blocks(monkeypatch, documents):
    """What is frequent goes by its passages, what a task holds by blocks; neither changes a row."""
    r = random.Random(9)
    fill = lambda n: ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]
    pool = [fill(n) for n in (12, 19, 20, 21, 24, 30, 60)]
    pairs = [(i if i % 9 else None, " ".join(fill(r.choice((0, 3, 30))) + r.choice(pool) + fill(r.choice((0, 1, 5, 30))))) for i in range(200)]
    docs = documents([*pairs, *pairs[:20], (5, " ".join(pool[-1])), (1, "na " * 90)]).repartition(3)
    rows = lambda: sorted(map(repr, paragraphs.repeated_passages(docs).collect()))
    want = rows()
    for hot, held, together in ((2, 1 << 18, 1 << 16), (2, 40, 4), (1 << 12, 40, 4)):
        for name, value in (("HOT", hot), ("HELD", held), ("TOGETHER", together)):
            monkeypatch.setattr(paragraphs, name, value)
        assert rows() == want
    assert len(want) == len(set(want)) > 100


def shuffled_records(spark, run):
    """Records that the stages of ``run`` write to shuffles."""
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    written = lambda: (sc._jsc.sc().listenerBus().waitUntilEmpty(30_000), {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages().apply(i) for i in range(stages().size()))})[1]
    before = written()
    run()
    return sum(n for k, n in written().items() if k not in before)


def test_passages_shuffle_buckets_not_anchors(spark, documents):
    r = random.Random(11)
    fill = lambda n: ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]
    shared = [fill(600) for _ in range(200)]
    docs = documents([(i, " ".join(fill(3) + shared[i % 200] + fill(3))) for i in range(600)]).repartition(3)
    anchors = 600 * 600 // 6
    assert shuffled_records(spark, lambda: paragraphs.repeated_passages(docs).count()) < anchors


@pytest.mark.parametrize("part", [1 << 19, 40])
def test_passages_in_parts(monkeypatch, part):
    r = random.Random(3)
    text = " ".join("é" * r.randint(1, 3) + str(r.randrange(500)) for _ in range(700))
    whole = paragraphs.anchored(text, 28, 51)
    monkeypatch.setattr(paragraphs, "PART", part)
    got = paragraphs.anchored(text, 28, 51)
    assert set(got[0].tolist()) == set(whole[0].tolist())
    assert all(len(text[a:b].split()) == 28 for a, b in zip(got[0], got[1]))


def test_minima():
    r = np.random.default_rng(1)
    for span in (1, 2, 3, 7, 24):
        h = r.integers(0, 2**63, 300, np.uint64) & ~np.uint64(paragraphs.PLACE)
        want = {i + int(np.argmin(h[i : i + span])) for i in range(len(h) - span + 1)}
        assert set(paragraphs.minima(h, span).tolist()) == want


def test_substring_dedup_of_odd_rows(odd, documents):
    assert paragraphs.substring_dedup(odd).where("kept_doc_id IS NULL").count() == 0
    assert {r.doc_id for r in paragraphs.substring_dedup(odd).collect()} <= {5, 6}
    assert paragraphs.substring_dedup(odd.limit(0)).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    left = {r.doc_id: r.text for r in paragraphs.removed(documents([(1, text), (2, f"start {text}\nend"), (3, None)])).collect()}
    assert left[1] == text and left[2].endswith("\nend") and "w30" not in left[2] and left[3] == ""


def test_short_paragraphs(documents):
    """Lines of 10 to 44 words: exact copies and near copies with one word more."""
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    lines_of = [[word() for _ in range(n)] for n in (10, 15, 20, 27, 28, 40, 44)]
    pairs = [(i, f"{word()} {word()}\n" + " ".join(x)) for i, x in enumerate(lines_of)]
    pairs += [(100 + i, " ".join(x)) for i, x in enumerate(lines_of)] + [(200 + i, " ".join([*x, word()])) for i, x in enumerate(lines_of)]
    got = {(x.doc_id, x.kept_doc_id) for x in paragraphs.substring_dedup(documents(pairs)).where("kind = 'paragraph'").collect()}
    assert got == {(at + i, i) for at in (100, 200) for i in range(len(lines_of))}


# --- lines


def brute_lines(texts, window=3, words=None):
    """Kept text and the windows that occurred earlier, by document; fewer lines are windows from so many words on."""
    seen, gone = set(), defaultdict(set)
    for doc in sorted(texts):
        kept = [(k, s) for k, line in enumerate((texts[doc] or "").split("\n")) if (s := line.strip(lines.BLANKS))]
        for size in range(1 if words else window, window + 1):
            for j in range(len(kept) - size + 1):
                content = tuple(s for _, s in kept[j : j + size])
                if size < window and sum(len(s.split()) for s in content) < words:
                    continue
                if content in seen:
                    gone[doc] |= {*range(kept[j][0], kept[j + size - 1][0] + 1)}
                seen.add(content)
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in texts.items()}, gone


def test_lines(documents):
    r = random.Random(7)
    texts = {i: "\n".join(r.choice(["a", "b", " b", "c", "d", "", " ", "e", "f"]) for _ in range(r.randint(0, 14))) for i in range(80)} | {90: None, 91: "a\na\na\na\na\na"}
    want, gone = brute_lines(texts)
    got = {x.doc_id: (x.text, x.n_chars) for x in lines.deduplicated(documents(texts.items())).collect()}
    assert {d: t for d, (t, _) in got.items()} == want
    assert all(n == (None if want[d] is None else len(want[d])) for d, (_, n) in got.items())
    runs = defaultdict(set)
    for x in lines.repeated_runs(documents(texts.items())).collect():
        runs[x.doc_id] |= {*range(x.line, x.last + 1)}
        assert (x.kept_doc_id, x.kept_line) < (x.doc_id, x.line)
    assert runs == {d: g for d, g in gone.items() if g}


def test_long_single_and_double_lines(documents):
    """One or two repeated lines of 20 words go, fewer words stay."""
    r = random.Random(13)
    some = lambda n: " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(n))
    one, first, second, short = some(52), some(12), some(8), some(19)
    texts = {1: one, 2: f"{some(3)}\n{one}\n\n{some(4)}", 3: f"{first}\n{second}\n{short}", 4: f"x\n {first}\n\n{second} \ny", 5: f"{short}\nz", 6: one}
    got = {x.doc_id: x.text for x in lines.deduplicated(documents(texts.items())).collect()}
    want = {d: t.replace(one, "").replace("\n\n\n", "\n\n") if d == 2 else t for d, t in texts.items()} | {4: "x\ny", 6: ""}
    assert got == want
    found = {(x.doc_id, x.line, x.last, x.kept_doc_id) for x in lines.repeated_runs(documents(texts.items()), words=20).collect()}
    assert found == {(2, 1, 1, 1), (4, 1, 3, 3), (6, 0, 0, 1)}


def test_lines_of_odd_rows(odd):
    got = lines.deduplicated(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    texts = {r.doc_id: r.text for r in got.where("doc_id IS NOT NULL").collect()}
    assert texts[5] == "" and texts[4].count("\n") == 7 and texts[1] is None
    assert lines.repeated_runs(odd.limit(0)).count() == 0


# --- decontamination


def brute_distance(pattern, text):
    row, best = [*range(len(pattern) + 1)], len(pattern)
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row, best = new, min(best, new[-1])
    return best


def test_myers():
    r = random.Random(0)
    for _ in range(400):
        p, t = "".join(r.choices("abc", k=r.randint(1, 70))), "".join(r.choices("abc", k=r.randint(0, 90)))
        assert decontaminate.Pattern.of(p).distance(t)[0] == brute_distance(p, t)


def edited(r, words, n):
    s = " ".join(words)
    for _ in range(n):
        k = r.randrange(len(s))
        s = r.choice([s[:k] + s[k + 1 :], s[:k] + r.choice("xyz") + s[k:], s[:k] + r.choice("xyz") + s[k + 1 :]])
    return s


def test_leaks(spark, documents):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefg", k=r.randint(2, 8)))
    items = [(k, [word() for _ in range(r.randint(3, 30))]) for k in range(25)]
    texts = {}
    for d in range(120):
        parts = [word() for _ in range(r.randint(0, 60))]
        if d % 2:
            _, words = r.choice(items)
            parts.insert(r.randint(0, len(parts)), edited(r, words, r.randint(0, 16)).upper())
        texts[d] = ", ".join(parts)
    want = set()
    for d, t in texts.items():
        for k, words in items:
            item = decontaminate.normal(" ".join(words))
            distance = brute_distance(item, decontaminate.normal(t))
            if distance <= int(len(item) * decontaminate.BUDGET):
                want.add((d, k, distance))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(98, None), (99, "?!")], "item_id long, text string")
    for chars in (decontaminate.BLOCK_CHARS, 60):
        decontaminate.BLOCK_CHARS, old = chars, decontaminate.BLOCK_CHARS
        got = {(x.doc_id, x.item_id, x.distance) for x in decontaminate.leaks(documents(texts.items()), bench).collect()}
        decontaminate.BLOCK_CHARS = old
        assert len(want) > 25 and got == want
    clean = decontaminate.decontaminated(documents(texts.items()), bench)
    assert {x.doc_id for x in clean.collect()} == set(texts) - {d for d, *_ in want}


def test_joined_pieces_lose_no_match():
    """Items of few words, so that chance hits abound, found with edits up to their budget and not beyond."""
    r = random.Random(12)
    words = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 6))) for _ in range(30)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.choice([1, 3, 8, 20, 60]))) for i in range(120)]
    texts = []
    for _ in range(60):
        chars = list(say(30) + " " + r.choice(items)[1] + " " + say(10))
        for _ in range(r.randrange(0, 14)):
            at = r.randrange(len(chars))
            chars[at : at + r.randrange(2)] = r.choice(["", "a", "b", "dd"])
        texts.append("".join(chars))
    for budget in (0.08, 0.2):
        got = {(k, i, d) for k, i, d, _ in decontaminate.Matcher(items, budget).matches(texts)}
        want = set()
        for k, text in enumerate(map(decontaminate.normal, texts)):
            for i, item in ((i, decontaminate.normal(t)) for i, t in items):
                distance = decontaminate.Pattern.of(item).distance(text)[0]
                if distance <= int(len(item) * budget):
                    want.add((k, i, distance))
        assert got == want and len(want) > 500


def test_items_in_many_blocks(spark, documents, monkeypatch):
    """More blocks than a worker holds, in batches of few rows, give what one block gives."""
    r = random.Random(13)
    say = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    items = [(i, say(20)) for i in range(30)]
    docs = documents([(i, say(30) + (" " + items[i % 30][1] if i % 3 == 0 else "")) for i in range(90)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(x) for x in decontaminate.leaks(docs, bench).collect()}
    assert len(one) >= 30
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 500)
    monkeypatch.setattr(decontaminate, "HELD_CHARS", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert len(decontaminate.shared_blocks(bench, 0.08)) > decontaminate.KEPT_BLOCKS
        assert {tuple(x) for x in decontaminate.leaks(docs, bench).collect()} == one
        kept = {x.doc_id for x in decontaminate.decontaminated(docs, bench).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert kept == {i for i in range(90)} - {d for d, *_ in one}


def test_leaks_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "licensed under the mit license"), (2, None), (3, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, bench).collect()} == {(7, 1)}
    got = decontaminate.decontaminated(odd, bench)
    assert got.columns == odd.columns and got.count() == odd.count() - 1
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0 and decontaminate.leaks(odd.limit(0), bench).count() == 0
    assert decontaminate.decontaminated(odd, bench.limit(0)).count() == odd.count()


def test_a_third_of_all_rows_in_one_group(documents):
    """Copies and variants of one text make up most rows."""
    line = " ".join(f"w{i}" for i in range(70))
    pairs = [(i, line if i % 2 else f"{line} tail{i} end{i}") for i in range(300)] + [(1000 + i, f"other {i} text") for i in range(20)]
    got = simhash.near_copies(documents(pairs)).where("doc_id < 1000").select(F.countDistinct("component_id")).first()[0]
    assert got == 1


# --- rows without doc_id, and several texts of one


ITEM = "what is the largest planet of the solar system and how far is it"


@pytest.mark.parametrize("ids", [(None, None), (7, 7)], ids=["null", "repeated"])
def test_rows_are_judged_by_their_own_text(spark, documents, ids):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    texts = [f"so {ITEM} then", "a clean text of some other words"]
    got = decontaminate.decontaminated(documents([*zip(ids, texts)]), bench).collect()
    assert [r.text for r in got] == texts[1:]

    run = "\n".join(f"line {k} of the passage" for k in range(4))
    texts = [f"{run}\nfirst end", f"one\ntwo\nthree\n{run}", "four\nfive\nsix\nseven\neight\nnine"]
    docs = documents([(1, texts[0]), *zip(ids, texts[1:])])
    want = {texts[0], "one\ntwo\nthree", texts[2]} if ids[0] else {"first end", *texts[1:]}
    assert {r.text for r in lines.deduplicated(docs).collect()} == want

    passage = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(80))
    got = {r.text for r in paragraphs.removed(documents([(1, passage), *zip(ids, [f"start\n{passage}\nend", other])])).collect()}
    assert other in got and (passage in got) == bool(ids[0]) and any("start" in t for t in got)


def test_near_dedup_keeps_other_texts_of_an_id(documents):
    some = lambda k: " ".join(f"{k}w{i}" for i in range(50))
    pairs = [(7, some("a")), (7, some("b")), (7, some("b")), (8, some("b")), (9, some("c")), (None, some("c"))]
    got = sorted((r.doc_id or 0, r.text[0]) for r in simhash.near_dedup(documents(pairs)).collect())
    assert got == [(0, "c"), (7, "a"), (7, "b"), (9, "c")]


def test_long_texts_take_linear_time(documents):
    """Millions of characters of hits, at which a search from the start for each would not end."""
    from time import process_time

    from parimutuel.llm import licenses, secrets

    net = secrets.trained()
    began = process_time()
    n = 200_000
    assert licenses.scan("the mit license, " * n)[1:4] == (n, 1, 3 * n - 2)
    found = secrets.scan(["token = abcdefgh1 " * n], net)[0][0]
    assert len(found) == n
    assert process_time() - began < 60
    text = "\n".join(f"line {i // 2}" for i in range(40_000))
    assert lines.deduplicated(documents([(1, text), (2, text)])).where("doc_id = 2").first().text == ""


@pytest.mark.parametrize("variants", [0, 0.5, 1])
@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_tree_of_a_shard_links_what_all_pairs_link(variants, radius):
    """Components over random fingerprints, close variants of a few, and both."""
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    some = int(variants * len(fp))
    fp[:some] = np.resize(fp[:7], some)
    for _ in range(5):
        fp[:some] ^= np.uint64(1) << rng.integers(0, 64, some).astype(np.uint64)
    distinct = np.unique(fp)
    near = np.bitwise_count(distinct[:, None] ^ distinct) <= radius
    wanted = roots(distinct, *((distinct[x] for x in np.nonzero(near))))
    assert roots(distinct, *simhash.linked(fp, radius)) == wanted


def roots(nodes, a, b):
    parent = {int(x): int(x) for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}
