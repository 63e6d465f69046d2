"""Conversation prefix trie (operator 12): conversations that begin alike share nodes.

A conversation is a sequence of turns (role, text). Its prefixes get polynomial rolling
fingerprints, mod 2^64, from numpy scans over the sorted turns. Prefixes of one depth
and fingerprint are candidates for one node; their last turns are compared with that
of the group's representative, its smallest conversation. Where all turns of all
groups agree, so do whole prefixes, as a fingerprint less its last turn's share is the
fingerprint of the prefix before. Turns that differ split their group, and all that
follows them, by the texts themselves, so results are exact for any fingerprints.

What a node adds up over its subtree is added up from its members instead, each with
what its own nodes come to: no recursion over depths, only aggregates with partial
results, so that a first turn that very many conversations share is reduced before
the shuffle. Turns are sorted over the whole cluster and scanned partition by
partition, and the sums of conversations that go on from one partition to the next
are carried along: a conversation with a third of all turns is spread like any other.
The hash of a node's ends has to read them in order; ids are joined to texts of some
thousand ids in the tasks that sort them, and one task streams those texts.

Defined results: a null role or text is empty; turns with equal numbers, null too, go by
role, then text, then as repeated turns; rows without conversation id are ignored; an
empty table gives no node, not even the root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut, pa_schema, slices, spread_join

#: Conversations of a block of ids borrow up to SHARED - 1 turns of the block's first.
BLOCK, SHARED = 20, 4
BASE = 0x9E3779B97F4A7C15
FULL = (1 << 64) - 1
NODE = ["depth", "fp", "path"]
SCANNED = "part long, conv_id long, k long, before long, after long, words long, words_so_far long, role string, text string"


def powers(exponents: np.ndarray) -> np.ndarray:
    """BASE to each exponent, mod 2^64; negative ones are powers of the inverse."""
    out = np.ones(len(exponents), np.uint64)
    for sign, base in ((1, BASE), (-1, pow(BASE, -1, 1 << 64))):
        left, step = np.maximum(sign * exponents, 0), base
        while left.any():
            out[left & 1 == 1] *= np.uint64(step)
            left, step = left >> 1, step * step & FULL
    return out


def turn_hash(role: bytes, text: bytes) -> int:
    return xxhash.xxh64_intdigest(b"%d:%b%b" % (len(role), role, text), 42)


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def scanned(turns: DataFrame) -> DataFrame:
    """Turns in order, with positions and sums counted from where a conversation enters its partition.

    ``before`` and ``after`` are the sums of hash * BASE^position without and with the turn.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    # Repeated rows are dealt by a number of their own.
    dealt = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    out = pa_schema(turns.sparkSession, SCANNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, k0, sum0, words0 = None, 0, np.uint64(0), 0
        for whole in batches:
            for batch in slices(whole, 2):
                ids = batch.column(0).to_numpy()
                said = [(r.encode("utf-8", "surrogatepass"), t.encode("utf-8", "surrogatepass")) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                hashes = np.fromiter((turn_hash(r, t) for r, t in said), np.uint64, len(said))
                words = np.fromiter((len(t.split()) for _, t in said), np.int64, len(said))
                new = np.diff(ids, prepend=ids[0]) != 0
                new[0] = ids[0] != conv
                begins = np.flatnonzero(new)
                nth = np.cumsum(new)  # 0: goes on from the batch before
                start = np.where(nth > 0, begins[nth - 1] if len(begins) else 0, 0)
                on = nth == 0
                k = np.arange(len(ids)) - start + 1 + np.where(on, k0, 0)
                term = hashes * powers(k)
                sums, counts = np.cumsum(term), np.cumsum(words)
                after = sums - (sums[start] - term[start]) + np.where(on, sum0, np.uint64(0))
                so_far = counts - (counts[start] - words[start]) + np.where(on, words0, 0)
                conv, k0, sum0, words0 = ids[-1], int(k[-1]), after[-1], int(so_far[-1])
                numbers = [np.full(len(ids), part), ids, k, (after - term).view(np.int64), after.view(np.int64), words, so_far]
                yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), batch.column(1), batch.column(2)], schema=out)

    return dealt.select("conv_id", "role", "text").mapInArrow(run, SCANNED)


Carry = dict[int, tuple[int, int, int, int]]


def carried(scan: DataFrame) -> Carry:
    """By partition: the conversation that goes on in it, and its turns, sum and words before.

    A row a partition reaches the driver.
    """
    tail = F.max_by(F.struct("k", "after", "words_so_far"), F.struct("conv_id", "k")).alias("tail")
    ends = scan.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), tail).orderBy("part").collect()
    out: Carry = {}
    last, k, total, words = None, 0, 0, 0
    for row in ends:
        on = row.first == last
        if on:
            out[row.part] = last, k, total, words
        if not (on and row.first == row.last):
            k, total, words = 0, 0, 0
        total = (total + pow(BASE, k, 1 << 64) * row.tail.after) & FULL
        last, k, words = row.last, k + row.tail.k, words + row.tail.words_so_far
    return out


def settled(part, ids, k, before, after, words, carry: Carry) -> tuple[np.ndarray, ...]:
    """Position, sums and words so far, counted from the conversation's first turn."""
    k, before, after, words = k.copy(), before.copy(), after.copy(), words.copy()
    for p in np.unique(part).tolist():
        if p in carry:
            conv, k0, sum0, words0 = carry[p]
            on = (part == p) & (ids == conv)
            scale, shift = np.uint64(pow(BASE, k0, 1 << 64)), np.uint64(sum0)
            k[on] += k0
            before[on], after[on] = before[on] * scale + shift, after[on] * scale + shift
            words[on] += words0
    return k, before, after, words


def placed(scan: DataFrame, carry: Carry, *more: str) -> DataFrame:
    """(conv_id, k, after, words_so_far) and further columns of every turn, from the conversation's first on."""
    kinds = {f.name: f.dataType.simpleString() for f in scan.schema}
    schema = "conv_id long, k long, after long, words_so_far long" + "".join(f", {c} {kinds[c]}" for c in more)
    out = pa_schema(scan.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, ids, k, words = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            after = unsigned(batch.column(3))
            k, _, after, words = settled(part, ids, k, after, after, words, carry)
            numbers = [ids, k, after.view(np.int64), words]
            yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), *batch.columns[5:]], schema=out)

    return scan.select("part", "conv_id", "k", "after", "words_so_far", *more).mapInArrow(run, schema)


def rebuilding(turns: DataFrame, borrowed: Column) -> DataFrame:
    """A row a conversation: how many turns it borrows (m) and leaves out (cut), and the sums that go with them.

    ``borrowed`` is how many first turns it takes from its block's first conversation.
    """
    heads = [F.max(F.when(F.col("k") == i, F.col(c))).alias(f"{c}{i}") for c in ("after", "words_so_far") for i in range(1, SHARED)]
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("words_so_far").alias("all_words"), *heads)
    sums = lambda c: F.array(F.lit(0).cast("long"), *(F.coalesce(f"{c}{i}", F.lit(0)) for i in range(1, SHARED)))
    convs = convs.select("conv_id", "n", "all_words", sums("after").alias("p"), sums("words_so_far").alias("w"))
    first = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("p").alias("base_p"), F.col("w").alias("base_w"))
    of = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("take", borrowed)
    none = F.array(*[F.lit(0).cast("long")] * SHARED)
    both = of.join(first, "base", "left").withColumns({"base_p": F.coalesce("base_p", none), "base_w": F.coalesce("base_w", none)})
    both = both.withColumns({"m": F.least("take", F.coalesce("base_n", F.lit(0))).cast("int"), "cut": F.least("take", "n").cast("int")})
    at = lambda c, i: F.get(c, F.col(i))
    return both.select("conv_id", "base", "m", "cut", (F.col("n") + F.col("m") - F.col("cut")).alias("len"), (F.col("all_words") + at("base_w", "m") - at("w", "cut")).alias("total"), at("base_p", "m").alias("lead"), at("base_w", "m").alias("lead_words"), at("p", "cut").alias("off"), at("w", "cut").alias("off_words"), "base_p", "base_w")


MEMBERS = "conv_id long, depth long, fp long, prev long, words long, words_to long, len long, total long, src long, src_k long"


def own_turns(scan: DataFrame, plan: DataFrame, carry: Carry) -> DataFrame:
    """A row for each turn that a conversation keeps of its own, at its place in the rebuilt one."""
    columns = ["part", "k", "before", "after", "words", "words_so_far", "conv_id", "m", "cut", "len", "total", "lead", "lead_words", "off", "off_words"]
    out = pa_schema(scan.sparkSession, MEMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i).to_numpy() for i, n in enumerate(columns)}
            before, after, lead, off = (c[n].view(np.uint64) for n in ("before", "after", "lead", "off"))
            k, before, after, so_far = settled(c["part"], c["conv_id"], c["k"], before, after, c["words_so_far"], carry)
            shift = c["m"].astype(np.int64) - c["cut"]
            scale = powers(shift)
            fp, prev = (lead + scale * (x - off) for x in (after, before))
            numbers = [c["conv_id"], k + shift, fp.view(np.int64), prev.view(np.int64), c["words"], c["lead_words"] + so_far - c["off_words"], c["len"], c["total"], c["conv_id"], k]
            keep = k > c["cut"]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in numbers], schema=out)

    joined = spread_join(scan.drop("role", "text"), plan.drop("base", "base_p", "base_w"), ["conv_id"])
    return joined.select(*columns).mapInArrow(run, MEMBERS)


def borrowed_turns(plan: DataFrame) -> DataFrame:
    """A row for each turn that a conversation takes from its block's first, and one for the root."""
    spread = plan.withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("m"))))
    at = lambda c, back: F.when(F.col("depth") < back, 0).otherwise(F.get(c, F.col("depth") - back))
    inside = F.when(F.col("depth") > 0, F.col("base"))
    return spread.select("conv_id", F.col("depth").cast("long").alias("depth"), at("base_p", 0).cast("long").alias("fp"), at("base_p", 1).cast("long").alias("prev"), (at("base_w", 0) - at("base_w", 1)).cast("long").alias("words"), at("base_w", 0).cast("long").alias("words_to"), "len", "total", inside.alias("src"), F.col("depth").cast("long").alias("src_k"))


def split_paths(tables: Tables, members: DataFrame, scan: DataFrame, carry: Carry) -> DataFrame:
    """Members with ``path`` and ``prev_path``: where their turns differ from their groups' representatives'.

    Turns of groups with more than one member are brought to their groups, equal ones
    once a task; a group left with more than one text is split by text, each named by
    the smallest conversation that has it.
    """
    inner = members.where("depth > 0")
    shared = inner.groupBy("depth", "fp").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    asked = spread_join(inner, shared, ["depth", "fp"]).groupBy("depth", "fp", "src", "src_k").agg(F.min("conv_id").alias("first"))
    texts = placed(scan, carry, "role", "text").select(F.col("conv_id").alias("src"), F.col("k").alias("src_k"), "role", "text")
    held = asked.join(texts, ["src", "src_k"])
    turns = held.groupBy("depth", "fp", "role", "text").agg(F.min("first").alias("variant"))
    unequal = turns.groupBy("depth", "fp").agg(F.count("*").alias("n"), F.min("variant").alias("representative")).where("n > 1")
    other = tables.store(turns.join(unequal, ["depth", "fp"]).where("variant <> representative").select("depth", "fp", "role", "text", "variant"))
    if other.isEmpty():
        return members.withColumns({"path": F.lit(""), "prev_path": F.lit("")})
    places = held.join(other, ["depth", "fp", "role", "text"]).select("depth", "fp", "src", "src_k", "variant")
    turned = inner.select("conv_id", "depth", "fp", "src", "src_k").join(places, ["depth", "fp", "src", "src_k"])
    turns_of = turned.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("depth").alias("at"), "variant"))).alias("turns"))
    said = lambda to: F.array_join(F.transform(F.filter(F.coalesce("turns", F.array()), lambda t: t["at"] <= to), lambda t: F.concat_ws(":", t["at"].cast("string"), t["variant"].cast("string"))), ",")
    joined = spread_join(members, turns_of, ["conv_id"], "left")
    return tables.store(joined.withColumns({"path": said(F.col("depth")), "prev_path": said(F.col("depth") - 1)}).drop("turns"))


#: Ids that are joined to one text; bounds what a task holds.
IDS = 20_000
CHUNK = "depth long, fp long, path string, first long, ids string"
ENDS = "depth long, fp long, path string, ends_sha256 string"


def ends(members: DataFrame) -> DataFrame:
    """The hash of each node's ends: ids in ascending order, comma-joined."""
    spark = members.sparkSession
    order = [*NODE, "conv_id"]
    last = members.where("depth = len").select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    chunk, out = pa_schema(spark, CHUNK), pa_schema(spark, ENDS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held: list[int] = []
            key = None
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (node != key or len(held) == IDS) and held:
                    rows.append((*key, held[0], ",".join(map(str, held))))
                    held = []
                key = node
                held.append(conv)
            if held:
                rows.append((*key, held[0], ",".join(map(str, held))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), chunk.types)] if rows else [pa.array([], t) for t in chunk.types], schema=chunk)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = []
            for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node == key:
                    state.update(b",")
                else:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = node, hashlib.sha256()
                state.update(ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*key, state.hexdigest()), out.types)], schema=out)

    chunks = last.mapInArrow(join, CHUNK).repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return chunks.mapInArrow(digest, ENDS)


def by_block(conv_id: Column) -> Column:
    """How many turns the contract borrows: the id's checksum mod 4."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def prefix_trie(conversations: DataFrame, borrowed: Column | None = None, bits: int = 64) -> DataFrame:
    """The nodes of the trie; ``borrowed`` says how many first turns, under SHARED, come from the block's first conversation (none by default).

    ``bits`` of the fingerprints count; fewer only make groups split more often.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", some("role").alias("role"), some("text").alias("text"))
    with Tables(conversations.sparkSession) as tables:
        scan = tables.store(scanned(turns))
        carry = carried(scan)
        plan = tables.store(rebuilding(placed(scan, carry), F.lit(0) if borrowed is None else borrowed))
        root = plan.agg(F.min("conv_id")).first()[0]
        masked = F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")
        every = own_turns(scan, plan, carry).union(borrowed_turns(plan))
        members = tables.store(every.withColumns({c: F.col(c).bitwiseAND(masked) for c in ("fp", "prev")}))
        members = split_paths(tables, members, scan, carry)
        # What a conversation adds to each node it is in: the words before the first node that
        # it is the smallest member of, or all its words where it is of none; and whether it ends in a leaf of its own.
        firsts = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max("len").alias("longest"), F.max(F.col("words_to") - F.col("words")).alias("above"))
        own = firsts.groupBy("conv_id").agg(F.min("above").alias("start"), F.max((F.col("depth") == F.col("longest")).cast("long")).alias("leaf"))
        part = F.coalesce("start", "total")
        grouped = spread_join(members, own, ["conv_id"], "left").groupBy(*NODE)
        nodes = tables.store(grouped.agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(part).alias("parts"), F.min_by(part, "conv_id").alias("own_part"),
            F.max(F.col("words_to") - F.col("words")).alias("above"), F.min("prev").alias("prev"), F.min("prev_path").alias("prev_path"),
        ))
        parent = [(F.col("depth") - 1).alias("depth"), F.col("prev").alias("fp"), F.col("prev_path").alias("path")]
        children = nodes.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
        known = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id")).where("depth > 0")
        # The root, parent of very many, is known; other parents are looked up.
        deep = nodes.where("depth > 1").withColumns({"child_fp": F.col("fp"), "child_path": F.col("path")}).withColumns({"depth": F.col("depth") - 1, "fp": F.col("prev"), "path": F.col("prev_path")})
        deep = spread_join(deep, known, NODE).withColumns({"depth": F.col("depth") + 1, "fp": F.col("child_fp"), "path": F.col("child_path")}).drop("child_fp", "child_path")
        top = nodes.where("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root).cast("long")))
        linked = deep.unionByName(top).join(children, NODE, "left").join(ends(members), NODE, "left")
        saved = F.col("parts") - (F.col("n_convs") - 1) * F.col("above") - F.col("own_part")
        digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
        return cut(linked.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"), digest.alias("ends_sha256"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")))
