"""Links between similar sets: banded MinHash, then exact Jaccard.

Items are distinct contents, named by 64-bit ids. Their bands are joined; each item
of a bucket is first held against the bucket's smallest id only, so a bucket of any
size costs its length. Where a bucket's items are not yet in one component, all those of different
components are compared: in small buckets pair by pair, in large ones block by block
within tasks. Where large buckets connect very many items, these are first brought
together anew by their rarest members, as a similar pair must share some. So no link
between colliding items is lost.

Defined results: items without bands (repeats, or empty sets) have no links of their
own; equal sets of different ids are linked; a similarity of exactly the threshold
counts; which of several paths joins a component is not fixed, the components are; an
empty table gives no links. Ids and sets are never null, and further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, pa_schema, spread_join
from .components import components, forest

#: Bits of the filter that keeps a second pass from shuffling what no bucket holds; its size is fixed.
FILTER_BITS = 25
MIX = np.uint64(0x9E3779B97F4A7C15)


def tuned(similarity: float, recall: float, rows: int = 4) -> tuple[int, int]:
    """Bands needed, at so many rows each, to find a pair of that similarity with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


def signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """Band keys of each non-empty set of hashes: one row a set, one column a band."""
    sizes = np.array([len(s) for s in sets])
    every, begins = np.concatenate(sets), np.cumsum(sizes) - sizes
    factors = np.random.default_rng(seed).integers(0, 2**63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for f in factors[band]:
            key = (key ^ np.minimum.reduceat(every * f, begins)) * MIX
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64)


def bitmap(ids: DataFrame) -> np.ndarray:
    """A fixed-size filter: bit ``id mod 2**FILTER_BITS`` is set for each id."""
    low = F.col("id").bitwiseAND((1 << FILTER_BITS) - 1)
    words = ids.select(F.shiftright(low, 5).alias("w"), F.expr(f"shiftleft(1L, cast(id & 31 as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    out = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["v"].to_numpy().astype(np.uint32)
    return out


def in_bitmap(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    low = ids.astype(np.int64) & ((1 << FILTER_BITS) - 1)
    return words[low >> 5] >> (low & 31).astype(np.uint32) & np.uint32(1) != 0


def banded(items: DataFrame, known: np.ndarray) -> DataFrame:
    """(id, key): the bands of items (id, bands) that the filter knows."""
    out = pa_schema(items.sparkSession, "id long, key long")
    shared = items.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(1)
            keys = bands.flatten().to_numpy()
            wanted = in_bitmap(shared.value, keys)
            ids = np.repeat(batch.column(0).to_numpy(), pa.compute.list_value_length(bands).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(ids[wanted]), pa.array(keys[wanted])], schema=out)

    return items.select("id", "bands").where("bands IS NOT NULL").mapInArrow(run, "id long, key long")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose sets (id, grams) reach the Jaccard threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    common = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(left, "a").join(right, "b").withColumn("common", common).where(F.col("common") >= threshold * (F.size("ga") + F.size("gb") - F.col("common"))).select("a", "b")


def overlaps(owner: np.ndarray, gram: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many grams each left set shares with each right set.

    ``owner`` and ``gram`` list the members of all sets; ``left`` and ``right`` give
    a set's row and column, -1 for none.
    """
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    rows, columns = left.max() + 1, right.max() + 1
    out = np.zeros(rows * columns, np.int64)
    where = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
    a, b = left[owner] >= 0, right[owner] >= 0
    a_of, b_of = owner[a], owner[b]
    begins = np.searchsorted(where[b], np.arange(where[-1] + 1 if len(where) else 0))
    counts = np.bincount(where[b], minlength=len(begins))
    times = counts[where[a]]
    for at in range(0, len(a_of), STEP):
        t = times[at : at + STEP]
        first = np.repeat(left[a_of[at : at + STEP]], t)
        place = np.arange(len(first)) - np.repeat(np.cumsum(t) - t, t) + np.repeat(begins[where[a][at : at + STEP]], t)
        out += np.bincount(first * columns + right[b_of[place]], minlength=len(out))
    return out.reshape(rows, columns)


#: Members that are spread over their partners at once.
STEP = 2048
#: Items of a bucket up to which its pairs are joined one by one.
SMALL = 16
#: Sets of a block, and members of all its sets: a task compares one block with another.
BLOCK, BLOCK_MEMBERS = 2048, 1_500_000
#: Items of a cluster up to which all its blocks are compared; in larger ones the rarest members choose.
DIRECT = 4096


def block_links(table: pa.Table, threshold: float) -> pa.Table:
    """(a, b): a forest of the links between the two blocks of a table (id, c, own, i, j, grams)."""
    ids, c, own = (table.column(n).combine_chunks().to_numpy() for n in ("id", "c", "own"))
    grams = table.column("grams").combine_chunks()
    sizes = np.diff(grams.offsets.to_numpy())
    owner, gram = np.repeat(np.arange(len(ids)), sizes), grams.flatten().to_numpy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    rows, columns = np.flatnonzero(own == i), np.flatnonzero(own == j)
    found = [np.zeros(0, np.int64)] * 2
    if len(rows) and len(columns):
        left, right = np.full(len(ids), -1), np.full(len(ids), -1)
        left[rows], right[columns] = np.arange(len(rows)), np.arange(len(columns))
        common = overlaps(owner, gram, left, right)
        linked = (common >= threshold * (sizes[rows][:, None] + sizes[columns] - common)) & (c[rows][:, None] != c[columns])
        x, y = np.nonzero(linked)
        if len(x):
            found = forest(ids[rows[x]], ids[columns[y]])
    return pa.Table.from_arrays([pa.array(f) for f in found], names=["a", "b"])


def clustered(items: DataFrame) -> DataFrame:
    """(id, c, cluster): items (key, id, c) whose keys connect them, each once."""
    hubs = items.groupBy("key").agg(F.min("id").alias("hub"))
    of = components(items.join(hubs, "key").select(F.col("id").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("node", "id")
    return items.select("id", "c").distinct().join(of, "id").withColumnRenamed("component", "cluster")


def in_blocks(whole: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links within clusters (id, c, cluster), every pair of blocks in a task of its own."""
    sized = whole.join(sets.select("id", F.size("grams").alias("members")), "id")
    most = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(BLOCK_MEMBERS / F.avg("members"))))
    blocks = sized.groupBy("cluster").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    dealt = whole.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = dealt.select("id", "c", "cluster", "own", other.alias("other")).select("id", "c", "cluster", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return pairs.join(sets, "id").groupBy("cluster", "i", "j").applyInArrow(lambda table: block_links(table, threshold), "a long, b long")


def rarest(items: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(key, id, c): each item (id, c) under its rarest members.

    Two sets that similar share one of their ``n - ceil(threshold n) + 1`` rarest
    members. What a large group has in common, such as a passage that very many texts
    hold, is frequent and comes last; so it no longer brings all of them together.
    """
    grams = items.join(sets, "id").select("id", "c", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = spread_join(grams, often, ["gram"]).groupBy("id", "c", "n").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("ranked"))
    first = ranked.select("id", "c", F.explode(F.slice("ranked", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))).alias("r"))
    return first.where("r.often > 1").select(F.col("r.gram").alias("key"), "id", "c")


def parted(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n) of the keys whose items (key, id, c) lie in different components: small ones, and large ones."""
    split = items.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low <> high")
    return split.where(F.col("n") <= SMALL).select("key"), split.where(F.col("n") > SMALL).select("key")


def pairs_of(items: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b): items of different components under one of the keys, which have few each."""
    few = items.join(keys, "key", "left_semi")
    left, right = (few.select("key", *(F.col(x).alias(x + y) for x in ("id", "c"))) for y in "ab")
    return left.join(right, "key").where("ca < cb").select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct()


def links(items: DataFrame, grams_of: Callable[[DataFrame], DataFrame], threshold: float, tables: Tables) -> DataFrame:
    """(a, b): links that join the ids of each component.

    ``items`` is a stored table (id, bands); an id may repeat and a repeat's bands may
    be null. ``grams_of`` gives (id, grams: distinct array) for a table of ids, once
    each. The result reads what ``tables`` holds.
    """
    keyed = items.where("bands IS NOT NULL").select("id", F.explode("bands").alias("key"))
    leads = tables.store(keyed.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last").select("key", "lead"))
    shared = banded(items, bitmap(leads.select(F.col("key").alias("id"))))
    members = tables.store(spread_join(shared, leads, ["key"]).distinct())
    pairs = members.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    sets = tables.store(grams_of(members.select("id").distinct()))
    found = tables.store(similar(pairs, sets, threshold))
    of = components(found).withColumnRenamed("node", "id")
    placed = tables.store(members.join(of, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")))
    small, large = parted(placed)
    whole = tables.store(clustered(placed.join(large, "key", "left_semi")))
    huge = tables.store(whole.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > DIRECT).select("cluster"))
    every = [similar(pairs_of(placed, small), sets, threshold), in_blocks(whole.join(huge, "cluster", "left_anti"), sets, threshold)]
    if not huge.isEmpty():
        chosen = tables.store(rarest(whole.join(huge, "cluster", "left_semi").select("id", "c"), sets, threshold))
        small, large = parted(chosen)
        every += [similar(pairs_of(chosen, small), sets, threshold), in_blocks(clustered(chosen.join(large, "key", "left_semi")), sets, threshold)]
    return reduce(DataFrame.union, map(tables.store, every), found)
