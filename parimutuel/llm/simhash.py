"""SimHash near-dedup (operator 7): fingerprints searched with vantage-point trees.

A text's fingerprint takes the majority of each bit over the XXH64 hashes of its
word shingles. Distinct fingerprints go down a vantage-point tree that is spread
over the cluster: each level cuts Hamming space into rings around a vantage point.
By the triangle bound, two fingerprints within the radius lie in one ring or at a
shared border, so a fingerprint also goes to the next ring where the border is
within the radius; the ring of the farther one then holds both. What one task gets
is parted further by a tree with vantage points of its own. Its leaves are searched
exactly, and linked fingerprints become components.

Shards that stay too large after the first levels (many close variants of a text)
are cut further around vantage points of their own. Where these don't thin a shard any
more, its fingerprints are dealt by their bits: cut into one block more than the
radius, two within the radius have a block in common.

Defined results: a null or empty text, or one of blanks, has fingerprint zero, which
links like any other; repeated rows share a component; rows whose ``doc_id`` is null
keep their fingerprint and join components but never name one (``component_id`` is
null where no member has an id); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import Tables, cut, grams, hash_of, map_texts, pa_schema, spread_join, text_hash, words_of
from .components import components
from .paragraphs import REMEMBERED, content_id, shingle_sets

SEED = 42
#: Fingerprints that a leaf should hold, and above which a shard is cut again.
LEAF, TOO_LARGE = 4096, 16384
#: Fingerprints that a leaf's own tree stops at.
SMALL = 256
#: Width of a ring in the first levels and in shards of close variants.
RING, NARROW = 8, 4
#: Rounds of cutting large shards; each cut thins a shard by its distances' spread.
ROUNDS = 20
#: A byte's bits, spread over the bytes of a word.
LANES = np.array([sum((v >> j & 1) << 8 * j for j in range(8)) for v in range(256)], np.uint64)


def majorities(groups: list[list[int]]) -> np.ndarray:
    """The fingerprint of each group of hashes, as signed 64-bit integers.

    Bits are added up eight to a machine word, in steps short enough for a byte.
    """
    out = np.zeros(len(groups), np.int64)
    filled = [k for k, g in enumerate(groups) if g]
    if not filled:
        return out
    sizes = np.array([len(groups[k]) for k in filled])
    hashes = np.concatenate([np.array(groups[k], np.uint64) for k in filled])
    begins = np.cumsum(sizes) - sizes
    steps = np.concatenate([np.arange(a, a + n, 255) for a, n in zip(begins, sizes)])
    sums = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], steps, axis=0)
    counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), np.searchsorted(steps, begins), axis=0, dtype=np.int64)
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    out[filled] = np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64 bits of each whole text."""
    return map_texts(docs, lambda ids, texts: [ids, majorities([grams(words_of(t), width, SEED) for t in texts])], "doc_id long, fp long")


def vantage(level: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(b"vantage %d" % level, 0))


def dealt(points: DataFrame, levels: int, radius: int) -> DataFrame:
    """(cell, fp): each fingerprint in its shard and in those whose border is within the radius."""
    out = pa_schema(points.sparkSession, "cell long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                cell = np.zeros(len(part), np.uint64)
                for level in range(levels):
                    far = np.bitwise_count(part ^ vantage(level)).astype(np.uint64)
                    near, over = far // RING, (far + radius) // RING
                    both = near != over
                    part, ring, cell = np.concatenate([part, part[both]]), np.concatenate([near, over[both]]), np.concatenate([cell, cell[both]])
                    cell = (cell ^ ring) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(part.view(np.int64))], schema=out)

    return points.select("fp").mapInArrow(run, "cell long, fp long")


def thinned(cells: DataFrame, radius: int) -> DataFrame:
    """Cut shards that are too large around vantage points of their own, until none is.

    Only the number of such shards reaches the driver.
    """
    largest = None
    for _ in range(ROUNDS):
        big = cut(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", "cell")).alias("v")).where(F.col("n") > TOO_LARGE))
        n, most = big.agg(F.count("*"), F.max("n")).first()
        if not n or largest is not None and most > 0.97 * largest:
            break
        largest = most
        far = F.bit_count(F.col("fp").bitwiseXOR(F.col("v")))
        rings = F.array_distinct(F.array(F.floor(far / NARROW), F.floor((far + radius) / NARROW)))
        joined = cells.join(big.select("cell", "v"), "cell", "left")
        again = joined.where(F.col("v").isNotNull()).select("cell", "fp", F.explode(rings).alias("ring")).select(F.xxhash64("cell", "ring").alias("cell"), "fp")
        cells = cut(joined.where(F.col("v").isNull()).select("cell", "fp").union(again))
    return cells


def blocks_of(fp, radius: int) -> list:
    """The bits of ``fp`` in ``radius + 1`` blocks, for columns."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND((1 << b - a) - 1) for a, b in zip(cuts, cuts[1:])]


def crowded(cells: DataFrame, radius: int) -> DataFrame:
    """Deal shards that are still too large by blocks of bits, some one of which two linked fingerprints share."""
    big = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > TOO_LARGE).select("cell", F.lit(True).alias("large"))
    joined = cells.join(big, "cell", "left")
    keys = F.array(*(F.xxhash64("cell", F.lit(i), block) for i, block in enumerate(blocks_of(F.col("fp"), radius))))
    again = joined.where("large").select(F.explode(keys).alias("cell"), "fp")
    return joined.where("large IS NULL").select("cell", "fp").union(again)


def halves(fp: np.ndarray, radius: int) -> list[np.ndarray]:
    """A node of the tree: what lies within the median distance of a vantage point, and what lies farther or at the border.

    By the triangle bound, of two fingerprints within the radius one half holds both.
    The vantage point is one of the node's, or else the farthest from that one. A node
    that neither thins is a leaf.
    """
    v = fp[len(fp) // 2]
    for _ in range(2):
        far = np.bitwise_count(fp ^ v)
        middle = int(np.median(far))
        parts = [fp[far <= middle], fp[far.astype(np.int64) > middle - radius]]
        if sum(len(p) ** 2 for p in parts) < 0.8 * len(fp) ** 2:
            return parts
        v = fp[far.argmax()]
    return []


def linked(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the radius joins: each end, and what it is reached from.

    A vantage-point tree parts the shard down to SMALL fingerprints, or to leaves of
    close variants that no vantage point thins; these are searched exactly.
    """
    nodes, ends, seeds = [np.unique(fp)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    while nodes:
        node = nodes.pop()
        parts = halves(node, radius) if len(node) > SMALL else []
        nodes += parts
        if not parts:
            reach(node, radius, ends, seeds)
    return np.concatenate(ends), np.concatenate(seeds)


def reach(left: np.ndarray, radius: int, ends: list[np.ndarray], seeds: list[np.ndarray]) -> None:
    """Add each fingerprint of a leaf reached over links from an earlier one, and that one.

    A breadth-first search over exact distances: every fingerprint is compared
    with those not reached yet, so no list of pairs is built. In a small leaf those
    without any link are dropped first.
    """
    if len(left) <= SMALL:
        left = left[(np.bitwise_count(left[:, None] ^ left) <= radius).sum(axis=1) > 1]
    while len(left):
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for x in front:
                near |= np.bitwise_count(left ^ x) <= radius
            front, left = left[near], left[~near]
            ends.append(front)
            seeds.append(np.full(len(front), seed))


def links(points: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that join the fingerprints of each component; ``points`` has distinct ``fp``."""
    levels = max(0, math.ceil(math.log2(max(1, points.count()) / LEAF) / 0.85))
    cells = dealt(points, levels, radius)
    if levels:
        cells = crowded(thinned(cut(cells), radius), radius)
    out = pa_schema(points.sparkSession, "a long, b long")

    def search(table: pa.Table) -> pa.Table:
        found = linked(table.column("fp").combine_chunks().to_numpy().view(np.uint64), radius)
        return pa.Table.from_arrays([pa.array(x.view(np.int64)) for x in found], schema=out)

    return cells.groupBy("cell").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    of = cut(fingerprints(docs, width))
    points = cut(of.groupBy("fp").agg(F.min("doc_id").alias("first")))
    reached = components(links(points.select("fp"), radius))
    classes = points.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = classes.join(named, "root").select("fp", "component_id")
    return spread_join(of, of_fp, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Stages on word shingles: width, similarity and the recall that their bands are tuned for.
SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.995


def whole(text: str) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """A text as its own only unit."""
    yield 0, 0, len(text), words_of(text)


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, h, id, fp, bands): the text's hash, its words' name, fingerprint and MinHash bands; bands are null where the task has sent them."""
    schema = "doc_id long, h long, id long, fp long, bands array<long>"
    sent: set[int] = set()

    def run(ids, texts):
        words = [words_of(t) for t in texts]
        names = [content_id(w) for w in words]
        sets = [grams(w, width, SEED) for w in words]
        out: list = [None] * len(texts)
        new = []
        for k, name in enumerate(names):
            if name not in sent and sets[k]:
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(name)
                new.append(k)
        if new:
            for k, row in zip(new, jaccard.signatures([np.array(sets[k], np.uint64) for k in new], bands, rows)):
                out[k] = row
        return [ids, [hash_of(t) for t in texts], names, majorities(sets), out]

    return map_texts(docs, run, schema)


def near_copies(docs: DataFrame, width: int = SHINGLE, radius: int = 2, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, component_id, component_h): documents in one component are linked by fingerprint or by similarity.

    ``h`` is the hash of the text. A component is named by its first document: the one
    with the least ``doc_id``, of several texts of that id the one with the least hash.

    At a similarity of 0.8 fingerprints of 64 bits differ in about ten bits, where a
    triangle bound prunes nothing. So beside the fingerprints within the radius,
    which the vantage-point trees find, documents whose MinHash bands collide are
    linked where their exact Jaccard similarity reaches the threshold.
    """
    bands, rows = jaccard.tuned(similarity, RECALL)
    with Tables(docs.sparkSession) as tables:
        of = tables.store(sketches(docs, width, bands, rows))
        first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("first")
        contents = tables.store(of.groupBy("id").agg(first, F.max("fp").alias("fp")))
        points = tables.store(contents.groupBy("fp").agg(F.min("id").alias("name"), F.count("*").alias("n")))
        same = contents.join(points.where("n > 1"), "fp").where("id <> name").select(F.col("id").alias("a"), F.col("name").alias("b"))
        # Stored, so that no task needs two Python workers at once.
        near = tables.store(links(points.select("fp"), radius))
        a, b = (points.select(F.col("fp").alias(x), F.col("name").alias(f"{x}_name")) for x in "ab")
        close = near.join(a, "a").join(b, "b").select(F.col("a_name").alias("a"), F.col("b_name").alias("b"))
        alike = jaccard.links(of.select("id", "bands"), lambda ids: shingle_sets(docs, whole, ids), similarity, tables)
        reached = components(same.union(close).union(alike)).withColumnRenamed("node", "id")
        classes = contents.join(reached, "id", "left").select("id", "first", F.coalesce("component", "id").alias("root"))
        named = classes.groupBy("root").agg(F.min("first").alias("kept"))
        placed = spread_join(of.select("doc_id", "h", "id"), classes.join(named, "root").select("id", "kept"), ["id"])
        return cut(placed.select("doc_id", "h", F.col("kept.doc_id").alias("component_id"), F.col("kept.h").alias("component_h")))


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Documents, all columns, with one kept of each component: its first.

    Of repeated rows (same ``doc_id`` and text) of that document one stays; rows
    without ``doc_id`` all stay.
    """
    first = near_copies(docs, similarity=similarity).where("doc_id = component_id AND h = component_h")
    kept = first.select(F.col("doc_id").alias("kept id"), F.col("h").alias("kept hash")).distinct()
    marked = docs.withColumn("text hash", text_hash())
    stay = marked.join(kept, (marked["doc_id"] == kept["kept id"]) & (marked["text hash"] == kept["kept hash"]), "left_semi")
    return stay.dropDuplicates(["doc_id", "text hash"]).select(docs.columns).union(docs.where("doc_id IS NULL"))
