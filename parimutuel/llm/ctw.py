"""Language-model scoring (operator 9): context-tree weighting over bytes.

A byte is eight binary decisions, each with its own context tree over the bytes
before it. Every node keeps a Krichevsky-Trofimov estimate, and the weights between
a node and its children follow from how well each codes the whole training corpus.
A text's score is the sum of the logarithms of the mixed predictions of its bytes
and of the end; a node that training never saw predicts one half, as its empty
counts say.

No table of nodes leaves the cluster. The texts are kept in blocks; of each block the
distinct runs (``depth`` bytes of context, nearest first, then the byte) are counted,
and a shuffle adds them up; they travel packed by buckets. Runs that share their SPLIT nearest bytes are sorted into
one place, where all deeper nodes and their mixtures follow from them; at most
256**(depth + 1 - SPLIT) runs can share these bytes. The shallower nodes come from
grouping what the deeper ones add to them, and go back down by joins. So each distinct
run of the corpus gets its exact logarithm, which is joined to the blocks that hold
it, and every block's texts are then added up.

The base score is the contract's unigram model. Words are counted exactly (by 64-bit
hash); the counts of the COMMON most frequent ones are broadcast, those of all others
are joined.

Defined results: a null or empty text is its end alone; a null ``doc_id`` is never
held out; without training texts every decision has probability one half and
``base_score`` follows its formula with N = V = 0; repeated rows are scored each;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Tables, cut, pa_schema, packed, spread_join, unpacked, whole_buckets

#: Bytes of context, and how many of the nearest bring runs together.
DEPTH, SPLIT = 5, 3
#: Bytes of texts in a block.
BLOCK = 16 << 20
#: Frequent words whose counts are broadcast: 16 bytes each.
COMMON = 1 << 18
#: Bits of the bucket that a run travels in.
BUCKET = 10
#: Distinct runs or words that a task gathers before it hands them on.
HELD = 1 << 19
#: Texts are read in parts of about so many bytes.
PART = 1 << 20
END = b"\xff"
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def pieces(text: bytes, depth: int) -> Iterator[bytes]:
    """A text and its end in parts of bounded size, each after the bytes before it."""
    padded = END * depth + text + END
    for at in range(0, len(text) + 1, PART):
        yield padded[at : at + depth + PART]


def runs(parts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each byte's run (its contexts, nearest first, and the byte last) and the number of its piece."""
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    of = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    for a in range(0, len(buffer) - depth, PART):
        b = min(a + PART, len(buffer) - depth)
        run = np.zeros(b - a, np.int64)
        for k in (*range(depth)[::-1], depth):
            run <<= 8
            run |= buffer[a + k : b + k]
        # What reaches from one piece into the next is no run.
        inside = of[a:b] == of[a + depth : b + depth]
        yield run[inside], of[a:b][inside]


def added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of their values."""
    order = np.argsort(keys, kind="stable")  # merges keys that are sorted in parts
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values))


def grouped(batch: pa.RecordBatch, column: int, size: int = PART) -> Iterator[tuple[int, list[bytes]]]:
    """The first row and the lowered texts of parts of a batch, each of about ``size`` bytes."""
    held, total, first = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        held.append(lowered(text.as_py()))
        total += len(held[-1])
        if total >= size:
            yield first, held
            held, total, first = [], 0, i + 1
    if held:
        yield first, held


def text_name(text: bytes) -> int:
    """A signed 64-bit name for a lowered text."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


PIECES = "block long, name long, part int, times long, data binary"


def blocks(docs: DataFrame, depth: int) -> DataFrame:
    """The texts' pieces in blocks, once a block, and how often training has them.

    A task numbers its blocks as it reads, so the result has to be stored before use.
    """
    out = pa_schema(docs.sparkSession, PIECES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        block, size = TaskContext.get().partitionId() << 32, 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal block
            rows, size, sent = [], 0, 0
            for name, (text, times) in held.items():
                for k, piece in enumerate(pieces(text, depth)):
                    rows.append((block, name, k, times, piece))
                    size += len(piece)
                    if size - sent >= PART or size >= BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                        rows, sent = [], size
                    if size >= BLOCK:
                        size, sent, block = 0, 0, block + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
            if size:
                block += 1

        for batch in batches:
            training = batch.column(1).to_pylist()
            for first, texts in grouped(batch, 0):
                for k, text in enumerate(texts, first):
                    name = text_name(text)
                    if name not in held:
                        held[name] = [text, 0]
                        size += len(text) + 1
                    held[name][1] += training[k]
                if size >= BLOCK:
                    yield from emit()
                    held, size = {}, 0
        yield from emit()

    return docs.select("text", (~held_out(F.col("doc_id"))).alias("training")).mapInArrow(deal, PIECES)


RUNS = "block long, bucket int, runs binary, n binary"


def by_bucket(run: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Buckets, and for each of them the distinct runs of it, ascending, and their values.

    Runs of the same four nearest bytes share a bucket, which keeps a bucket's runs alike.
    """
    bucket = ((run >> 16).astype(np.uint64) * MIX >> np.uint64(64 - BUCKET)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange((1 << BUCKET) + 1))
    some = np.flatnonzero(np.diff(at))
    at = np.append(at[some], len(run))
    return some.astype(np.int32), [packed(v[order], at) for v in (run, *values)]


def block_runs(dealt: DataFrame, depth: int) -> DataFrame:
    """(block, bucket, runs, n): the distinct runs of each block, and how often training has them there, packed by buckets."""
    out = pa_schema(dealt.sparkSession, RUNS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, more = None, [], []

        def emit() -> pa.RecordBatch:
            buckets, columns = by_bucket(*added(*map(np.concatenate, zip(*more))))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(buckets), block)), pa.array(buckets), *columns], schema=out)

        def take(pieces_held: list[tuple[int, bytes]]) -> None:
            for times in {t for t, _ in pieces_held}:
                for run, _ in runs([d for t, d in pieces_held if t == times], depth):
                    distinct, n = np.unique(run, return_counts=True)
                    more.append((distinct, times * n))
                    if len(more) >= 6:
                        more[:] = [added(*map(np.concatenate, zip(*more)))]

        size = 0
        for batch in batches:
            of, times = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for k in range(batch.num_rows):
                if of[k] != block or size >= PART:
                    if parts:
                        take(parts)
                        parts, size = [], 0
                    if of[k] != block:
                        if more:
                            yield emit()
                            more.clear()
                        block = int(of[k])
                parts.append((int(times[k]), batch.column(4)[k].as_py()))
                size += len(parts[-1][1])
        if parts:
            take(parts)
            yield emit()

    return dealt.mapInArrow(count, RUNS)


def summed(found: DataFrame) -> DataFrame:
    """(run, n): the runs of all blocks, added up."""
    out = pa_schema(found.sparkSession, "run long, n long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, 1, PART):
            columns = added(*(unpacked(table[c].combine_chunks(), np.int64) for c in ("runs", "n")))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=out)

    return found.select("bucket", "runs", "n").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "run long, n long")


def counted_runs(dealt: DataFrame, depth: int) -> DataFrame:
    """(run, n): the distinct runs of all blocks, and how often training has them."""
    return summed(block_runs(dealt, depth))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    y, product = x + 8, np.ones_like(x)
    for k in range(8):
        product *= x + k
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 - z * (1 / 30 - z / 105)) / (12 * y) - np.log(product)


def estimated(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of the counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def weighed(zeros: np.ndarray, ones: np.ndarray, inner: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A node's weighted code length, and the share of its own estimate in it; the deepest have nothing inside."""
    own = estimated(zeros.astype(float), ones.astype(float))
    if inner is None:
        return own, np.ones(len(own))
    coded = np.logaddexp(own, inner) - math.log(2)
    return coded, np.exp(own - math.log(2) - coded)


class Level(NamedTuple):
    """One bit of the runs' bytes at depth ``split``: what deeper nodes give each run, and their roots."""

    p: np.ndarray  # of the run's own bit
    one: np.ndarray  # whether that bit is one
    root: np.ndarray  # each run's place among the nodes below
    node: np.ndarray  # context bytes, then the bits of the byte so far after a leading 1
    zeros: np.ndarray
    ones: np.ndarray
    coded: np.ndarray


def inside(run: np.ndarray, n: np.ndarray, depth: int, split: int) -> Iterator[Level]:
    """For each bit, all nodes from ``depth`` up to ``split`` that sorted, distinct, whole runs make up."""
    byte = run & 255
    for k in range(8):
        one = byte >> 7 - k & 1
        own = ((run >> 8) << k) | byte >> 8 - k  # the context and k bits
        first = np.flatnonzero(np.diff(own, prepend=-1))
        node, at = own[first], np.cumsum(np.diff(own, prepend=-1) != 0) - 1
        zeros, ones = np.add.reduceat(n * (1 - one), first), np.add.reduceat(n * one, first)
        inner, p = None, np.full(len(run), 0.5)
        for d in range(depth, split - 1, -1):
            coded, share = weighed(zeros, ones, inner)
            zero = (zeros + 0.5) / (zeros + ones + 1.0)
            p += share[at] * (np.where(one, 1 - zero[at], zero[at]) - p)
            if d > split:
                node, back = np.unique(node >> 8 + k << k | node & (1 << k) - 1, return_inverse=True)
                zeros, ones, inner = (np.bincount(back, x, len(node)) for x in (zeros, ones, coded))
                at = back[at]
        yield Level(p, one, at, node >> k << 8 | 1 << k | node & (1 << k) - 1, zeros, ones, coded)


def whole_keys(batches: Iterator[pa.RecordBatch], column: int, least: int = 1 << 16) -> Iterator[pa.Table]:
    """Sorted batches as tables of some size that never part equal keys."""
    held, rows = [], 0
    for batch in batches:
        if rows >= least and batch.num_rows:
            key = batch.column(column).to_numpy()
            end = int(np.searchsorted(key, held[-1].column(column)[-1].as_py(), side="right"))
            held.append(batch.slice(0, end))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            batch = batch.slice(end)
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


#: A node at a depth, and what its own level and deeper ones say of it.
NODE = "node long, zeros double, ones double, coded double"


def near(runs_of: DataFrame, depth: int, split: int) -> DataFrame:
    """``runs_of`` with the key that brings together those with the same ``split`` nearest bytes."""
    return runs_of.withColumn("key", F.shiftright("run", 8 * (depth + 1 - split)))


def deep_nodes(counts: DataFrame, depth: int, split: int) -> DataFrame:
    """The nodes of depth ``split``, from (run, n)."""
    out = pa_schema(counts.sparkSession, NODE)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, 0):
            for level in inside(table["run"].to_numpy(), table["n"].to_numpy(), depth, split):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip((level.node, level.zeros, level.ones, level.coded), out)], schema=out)

    keyed = near(counts, depth, split).select("key", "run", "n")
    return keyed.repartition("key").sortWithinPartitions("key", "run").mapInArrow(build, NODE)


def parent(node):
    """The node with the farthest context byte left out, for columns."""
    return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(node.bitwiseAND(255))


def weighed_level(below: DataFrame) -> DataFrame:
    """(node, zeros, ones, coded, zero, share) of the parents of these nodes."""
    schema = NODE + ", zero double, share double"
    out = pa_schema(below.sparkSession, schema)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, zeros, ones, inner = (batch.column(i).to_numpy() for i in range(4))
            coded, share = weighed(zeros, ones, inner)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, zeros, ones, coded, (zeros + 0.5) / (zeros + ones + 1.0), share)], schema=out)

    return below.groupBy(parent(F.col("node")).alias("node")).agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "coded"))).mapInArrow(weigh, schema)


def outside(deep: DataFrame, split: int, tables: Tables) -> DataFrame:
    """(node, a, b): a zero's probability is ``a + b p`` where the nodes from ``split`` on give it ``p``."""
    levels = [deep]
    for _ in range(split):
        levels.append(tables.store(weighed_level(levels[-1].select("node", "zeros", "ones", "coded"))))
    given = None
    for level in levels[:0:-1]:
        a, b = F.col("share") * F.col("zero"), 1 - F.col("share")
        if given is None:
            given = level.select("node", a.alias("a"), b.alias("b"))
        else:
            above = given.select(F.col("node").alias("up"), F.col("a").alias("up_a"), F.col("b").alias("up_b"))
            given = level.join(above, parent(F.col("node")) == F.col("up")).select("node", (F.col("up_a") + F.col("up_b") * a).alias("a"), (F.col("up_b") * b).alias("b"))
    if given is None:
        return deep.select("node", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    above = given.select(F.col("node").alias("up"), "a", "b")
    return deep.select("node").join(above, parent(F.col("node")) == F.col("up")).select("node", "a", "b")


def logarithms(counts: DataFrame, around: DataFrame, depth: int, split: int) -> DataFrame:
    """(run, log): log10 of the probability of each run's byte after its contexts."""
    out = pa_schema(counts.sparkSession, "run long, log double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, 0):
            here = table["a"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
            run = table["run"].to_numpy()
            node, a, b = run[~here], table["a"].to_numpy()[~here], table["b"].to_numpy()[~here]
            run, n = run[here], table["n"].to_numpy()[here]
            total = np.zeros(len(run))
            for level in inside(run, n, depth, split) if len(run) else ():
                at = np.searchsorted(node, level.node)[level.root]
                total += np.log10(np.where(level.one, 1 - a[at] - b[at], a[at]) + b[at] * level.p)
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(total)], schema=out)

    none = F.lit(None).cast("double")
    rows = near(counts, depth, split).select("key", "run", "n", none.alias("a"), none.alias("b"))
    # A node's row stands among the runs of its key.
    nodes = around.select(F.shiftright("node", 8).alias("key"), F.col("node").alias("run"), F.lit(0).cast("long").alias("n"), "a", "b")
    return rows.union(nodes).repartition("key").sortWithinPartitions("key", "run").mapInArrow(predict, "run long, log double")


def answered(found: DataFrame, logs: DataFrame) -> DataFrame:
    """(block, runs, logs): the logarithms (run, log) of each row of ``found``.

    Seven digits of each logarithm are enough on the way back to the blocks.
    """
    asked, answer = "bucket int, block long, runs binary, logs binary", "block long, runs binary, logs binary"
    sent, out = pa_schema(found.sparkSession, asked), pa_schema(found.sparkSession, answer)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            run, log = map(np.concatenate, zip(*held))
            buckets, columns = by_bucket(run, log.astype(np.float32))
            return pa.RecordBatch.from_arrays([pa.array(buckets), pa.nulls(len(buckets), pa.int64()), *columns], schema=sent)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                size += batch.num_rows
            if size >= HELD:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, 2, PART):
            given = table.filter(pa.compute.is_null(table["block"]))
            run, log = unpacked(given["runs"].combine_chunks(), np.int64), unpacked(given["logs"].combine_chunks(), np.float32)
            order = np.argsort(run)
            run, log = run[order], log[order]
            table = table.filter(pa.compute.is_valid(table["block"]))
            data = table["runs"].combine_chunks()
            ends = np.cumsum(pa.compute.binary_length(data).to_numpy() // 8)
            yield pa.RecordBatch.from_arrays([table["block"].combine_chunks(), data, packed(log[np.searchsorted(run, unpacked(data, np.int64))], np.append(0, ends))], schema=out)

    rows = found.select("bucket", "block", "runs", F.lit(None).cast("binary").alias("logs"))
    dealt = rows.union(logs.select("run", "log").mapInArrow(pack, asked))
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(look, answer)


def added_up(dealt: DataFrame, answers: DataFrame, depth: int) -> DataFrame:
    """(name, score) of each text, from the logarithms of the runs of its blocks."""
    out = pa_schema(dealt.sparkSession, "name long, part int, score double")

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        every, logs = unpacked(known["runs"].combine_chunks(), np.int64), unpacked(known["logs"].combine_chunks(), np.float32)
        order = np.argsort(every)
        every, logs = every[order], logs[order]
        total = np.zeros(texts.num_rows)
        # A few pieces at once: their runs' places take many times their own room.
        ends = np.cumsum(pa.compute.binary_length(texts["data"]).to_numpy())
        cuts = [0, *np.unique(np.searchsorted(ends, np.arange(PART, ends[-1], PART)) + 1), texts.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            for run, of in runs(texts["data"].slice(a, b - a).to_pylist(), depth) if a < b else ():
                coded = pa.array(run).dictionary_encode()
                distinct = coded.dictionary.to_numpy()
                order = np.argsort(distinct)  # places that are looked up in order are near each other
                here = np.empty(len(distinct), logs.dtype)
                here[order] = logs[np.searchsorted(every, distinct[order])]
                total[a:b] += np.bincount(of, here[coded.indices.to_numpy()], b - a)
        return pa.Table.from_arrays([texts["name"].combine_chunks(), texts["part"].combine_chunks(), pa.array(total)], schema=out)

    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "name long, part int, score double")
    return scored.groupBy("name", "part").agg(F.max("score").alias("score")).groupBy("name").agg(F.sum("score").alias("score"))


def predicted(docs: DataFrame, depth: int, split: int = SPLIT) -> DataFrame:
    """(name, score) of each distinct text, learned from those that are not held out."""
    split = min(split, depth)
    with Tables(docs.sparkSession) as tables:
        dealt = tables.store(blocks(docs, depth))
        found = tables.store(block_runs(dealt, depth))
        counts = tables.store(summed(found))
        deep = tables.store(deep_nodes(counts, depth, split))
        answers = tables.store(answered(found, logarithms(counts, outside(deep, split, tables), depth, split)))
        return cut(added_up(dealt, answers, depth))


def word_id(word: bytes) -> int:
    """A word's hash, below or above all places among the frequent words."""
    h = xxhash.xxh3_64_intdigest(word) - (1 << 63)
    return h if not 0 <= h < COMMON else h + (1 << 62)


def word_counts(text: bytes) -> Counter:
    """Words of a text, read in parts that end at a blank."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        to = at + 4 * PART
        while to < len(text) and text[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        found.update(text[at:to].split())
        at = to
    return found


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the training texts' words by hash."""
    out = pa_schema(docs.sparkSession, "word long, n long")

    def table(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([word_id(w) for w in found], pa.int64()), pa.array(found.values(), pa.int64())], schema=out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for _, texts in grouped(batch, 1):
                for text in texts:
                    found.update(text.split())
                if len(found) >= HELD // 2:
                    yield table(found)
                    found = Counter()
        yield table(found)

    return docs.select("doc_id", "text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Unigram:
    """The base model's totals and its most frequent words."""

    def __init__(self, tokens: int, types: int, ends: int, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.tokens, self.types, self.ends = tokens, types, ends

    def places(self) -> dict[int, int]:
        """Places of the frequent words, by hash."""
        return {word: k for k, word in enumerate(self.words.tolist())}

    def logs(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


ROWS = "row long, doc_id long, word long, times long, tokens long, known long, base double, name long, bytes long"


def based(docs: DataFrame, unigram: Unigram) -> DataFrame:
    """A row per document with what the broadcast tells and its text's name, and one per further word of it.

    ``row`` numbers the input's rows, so that repeated documents stay apart; a
    document's own row has a null ``times``.
    """
    sc = docs.sparkSession.sparkContext
    base = sc.broadcast(unigram)
    out = pa_schema(docs.sparkSession, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = base.value
        # A word's place among the frequent ones; of other words the hash, which is no place.
        places, ids, logs = one.places(), {}, one.logs(one.counts)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            docs_of = batch.column(0).to_pylist()
            for first, texts in grouped(batch, 1):
                words, times, of, tokens = [], [], [], []
                for k, text in enumerate(texts):
                    found = word_counts(text)
                    if len(ids) > HELD // 4:
                        ids.clear()
                    for w in found:
                        if w not in ids:
                            h = word_id(w)
                            ids[w] = places.get(h, h)
                    words += [ids[w] for w in found]
                    times += found.values()
                    of += [k] * len(found)
                    tokens.append(sum(found.values()) + 1)
                words, times, of = np.array(words, np.int64), np.array(times, np.int64), np.array(of, np.int64)
                hit = (words >= 0) & (words < len(places))
                sums = np.bincount(of[hit], times[hit] * logs[words[hit]], len(texts)) + one.logs(np.array(one.ends))
                known = np.bincount(of[hit], times[hit], len(texts)).astype(np.int64) + (one.ends > 0)
                n, m = len(texts), int((~hit).sum())
                rows = np.arange(row, row + n)
                none, docs_here = pa.nulls(m, pa.int64()), docs_of[first : first + n]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([rows, rows[of[~hit]]])), pa.concat_arrays([pa.array(docs_here, pa.int64()), none]), pa.array(np.concatenate([(rows.astype(np.uint64) * MIX).view(np.int64), words[~hit]])),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(times[~hit])]), pa.concat_arrays([pa.array(tokens, pa.int64()), none]), pa.concat_arrays([pa.array(known), none]),
                    pa.concat_arrays([pa.array(sums), pa.nulls(m, pa.float64())]), pa.concat_arrays([pa.array([text_name(t) for t in texts], pa.int64()), none]),
                    pa.concat_arrays([pa.array([len(t) + 1 for t in texts], pa.int64()), none]),
                ], schema=out)
                row += n

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


def frequent(words: DataFrame) -> DataFrame:
    """At most COMMON of the words, none of them rarer than one left out.

    A histogram of the counts' magnitudes tells where to cut, so no task has to sort
    candidates of all partitions.
    """
    level = F.floor(F.log2("n") * 4).cast("int")
    sizes = dict(words.groupBy(level.alias("level")).count().collect())
    least, total = None, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > COMMON:
            break
        least = at
    return words.where(level >= least) if least is not None else words.limit(0)


def language_scores(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document.

    ``bits_per_byte`` is the trees' code length of the text and its end, a byte of both.
    """
    training = docs.where(~held_out(F.col("doc_id")))
    words = cut(vocabulary(training))
    ends = training.count()
    total, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = frequent(words).toArrow()
    unigram = Unigram(total + ends, types + (ends > 0), ends, *(common.column(c).to_numpy() for c in ("word", "n")))
    found = based(docs, unigram)
    rest = F.coalesce(F.when(F.col("times").isNotNull(), F.col("n")), F.lit(0))
    log = F.log10((rest + 0.5) / (unigram.tokens + 0.5 * (unigram.types + 1)))
    own = F.col("times").isNull()
    joined = found.join(words, "word", "left").select("row", "doc_id", "tokens", "name", "bytes", F.when(own, F.col("known")).when(rest > 0, F.col("times")).otherwise(0).alias("known"), F.when(own, F.col("base")).otherwise(F.col("times") * log).alias("base"))
    firsts = (F.max(c).alias(c) for c in ("doc_id", "tokens", "name", "bytes"))
    summed = joined.groupBy("row").agg(*firsts, F.sum("known").alias("n_known"), F.sum("base").alias("base_score"))
    bits = -F.col("score") * math.log2(10) / F.col("bytes")
    return spread_join(summed, predicted(docs, depth), ["name"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tokens").alias("n_tokens"), "n_known", F.lit(unigram.tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
