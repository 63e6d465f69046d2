"""Substring dedup (operator 6): paragraphs by MinHash banding, and passages inside them.

Paragraphs are the lines of a text with enough words. Their MinHash bands are tuned
for recall, colliding paragraphs are verified by exact Jaccard similarity of their
five-word shingles, and components of verified links are classes of which the first
paragraph stays.

A passage that is pasted into different paragraphs makes these only partly alike, so
every text also yields anchors: of each stretch of ``guarantee`` words the run of
``width`` words with the least hash. Two texts that share such a stretch share an
anchor in it. A first pass counts the anchors; a second takes those that occur more
than once, each with one byte of every word beside it. Occurrences of an anchor whose
words beside it agree so far that ``guarantee`` words are shared are repeats. So no
repeat of that length is missed; one a word shorter is taken for one in a few of a
thousand cases, as a byte can agree by chance.

Anchors travel packed: a task gathers those of a block of texts and sends each bucket of
hashes one row with the first places of what the block holds; the bucket sends back the
first places of all blocks, and the block makes rows of them.

Defined results: a null or empty text has neither paragraphs nor passages; of
repeated rows (same ``doc_id`` and text) one place stands for all; a null ``doc_id``
sorts first, and of several texts of one ``doc_id`` the one with the least hash;
other columns are ignored. Words are runs of non-blank characters with A-Z
lower-cased; positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import LOWER, Tables, cut, freed_shuffles, grams, hash_of, pa_schema, packed, slices, spread_join, text_hash, unpacked, whole_buckets, words_of
from .components import components

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Words that make a line a paragraph; words of an anchor; words that a repeated passage has at least.
MIN_WORDS, WIDTH, GUARANTEE = 10, 12, 20
#: Words on each side of an anchor that are told apart, one byte each: the most by which a passage may be longer.
BESIDE = 8
#: Ids that a task remembers so as not to send the bands of a repeated paragraph again.
REMEMBERED = 200_000


def paragraphs_of(text: str, min_words: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """Number, start, end and words of each paragraph."""
    at = 0
    for k, line in enumerate(text.split("\n")):
        if len(line) >= 2 * min_words - 1 and len(words := words_of(line)) >= min_words:
            yield k, at, at + len(line), words
        at += len(line) + 1


def content_id(words: list[bytes]) -> int:
    """A signed 64-bit name for the words."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def occurrences(docs: DataFrame, min_words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, h, start, end, id, bands): the text's hash, place and content; bands are null where the task has sent them already."""
    schema = "doc_id long, h long, start int, end int, id long, bands array<long>"
    out = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                found, sets, new = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    h = hash_of(text or "")
                    for _, a, b, words in paragraphs_of(text or "", min_words):
                        name = content_id(words)
                        if name not in sent:
                            if len(sent) >= REMEMBERED:
                                sent.clear()
                            sent.add(name)
                            sets.append(np.array(grams(words, SHINGLE), np.uint64))
                            new.append(len(found))
                        found.append((doc, h, a, b, name))
                if found:
                    sent_bands: list = [None] * len(found)
                    for at, row in zip(new, jaccard.signatures(sets, bands, rows) if sets else ()):
                        sent_bands[at] = row
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*found), sent_bands], out)], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


Units = Callable[[str], Iterator[tuple[int, int, int, list[bytes]]]]


def shingle_sets(docs: DataFrame, units: Units, ids: DataFrame) -> DataFrame:
    """(id, grams) of the paragraphs (or other units of a text) with these ids, from a second pass over the texts."""
    known = docs.sparkSession.sparkContext.broadcast(jaccard.bitmap(ids))
    schema = "id long, grams array<long>"
    out = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                names, sets = [], []
                for text in part.column(1).to_pylist():
                    found = [(content_id(w), w) for _, _, _, w in units(text or "")]
                    if not found:
                        continue
                    wanted = jaccard.in_bitmap(known.value, np.array([n for n, _ in found], np.int64))
                    for name, words in (x for x, yes in zip(found, wanted) if yes and x[0] not in sent):
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add(name)
                        names.append(name)
                        sets.append(np.unique(np.array(grams(words, SHINGLE), np.uint64)).view(np.int64))
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, out[1].type)], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, schema).join(ids, "id", "left_semi").dropDuplicates(["id"])


def similar_paragraphs(docs: DataFrame, min_words: int = 45, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, start, end, class_id, kept_doc_id, kept_start) of paragraphs that repeat an earlier one."""
    bands, rows = jaccard.tuned(similarity, RECALL)
    with Tables(docs.sparkSession) as tables:
        found = tables.store(occurrences(docs, min_words, bands, rows))
        links = jaccard.links(found.select("id", "bands"), lambda ids: shingle_sets(docs, partial(paragraphs_of, min_words=min_words), ids), similarity, tables)
        of = components(links).withColumnRenamed("node", "id")
        place = F.struct("doc_id", "h", "start")
        counted = found.groupBy("id").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        classes = counted.join(of, "id", "left").select("id", "first", "last", F.coalesce("component", "id").alias("class_id"))
        kept = classes.groupBy("class_id").agg(F.min("first").alias("kept"), F.max("last").alias("last")).where("kept <> last").select("class_id", "kept")
        named = classes.join(kept, "class_id").select("id", "class_id", "kept")
        again = spread_join(found.drop("bands"), named, ["id"]).where(place != F.col("kept"))
        return cut(again.select("doc_id", "h", F.col("start").cast("long"), F.col("end").cast("long"), "class_id", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").cast("long").alias("kept_start")).distinct())


#: Odd base of the rolling hashes, and what makes a second word hash of a first.
BASE, OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BYTE_HASH = np.random.default_rng(3).integers(0, 2**64, 256, np.uint64)
LOW = (1 << 20) - 1
#: Bytes that are no blanks.
IN_WORD = ~np.isin(np.arange(256), [32, *range(9, 14)])


@lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    inverse = pow(BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, inverse))


def spans_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash, mixed, of values[start:end] for each span."""
    up, down = powers(1 << max(12, (len(values) + 1).bit_length()))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * down[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * up[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def minima(hashes: np.ndarray, span: int) -> np.ndarray:
    """Places of the least hash in each window of ``span``; of equal ones the first.

    The low bits of each hash give way to its place, so that a minimum tells where it is.
    """
    n = len(hashes) - span + 1
    low = hashes & ~np.uint64(LOW) | (np.arange(len(hashes)) & LOW).astype(np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    at = np.arange(n)
    places = at + ((low.astype(np.int64) & LOW) - at & LOW)  # ascending, as windows are
    return places[np.diff(places, prepend=-1) != 0]


#: Words that are hashed at once; longer texts go through in overlapping parts.
PART = 1 << 19


def anchored(text: str, width: int, guarantee: int, names_only: bool = False) -> tuple[np.ndarray, ...] | None:
    """Starts, ends and two hashes of a text's anchors, and the words on their left and right; or the first hashes alone.

    The words beside an anchor are bytes of one integer a side, the nearest word in the
    lowest; zero stands for no word.
    """
    if len(text) < 2 * guarantee - 1:
        return None
    padded = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(LOWER) + b" ", np.uint8)
    raw, inside = padded[1:-1], IN_WORD[padded]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if len(starts) < guarantee:
        return None
    beside = np.zeros(len(starts) + 2 * BESIDE, np.uint8)
    parts = []
    for a in range(0, len(starts) - guarantee + 1, PART):
        s, e = starts[a : a + PART + guarantee - 1], ends[a : a + PART + guarantee - 1]
        words = spans_hashed(BYTE_HASH[raw[s[0] : e[-1]]], s - s[0], e - s[0])
        first = np.arange(len(s) - width + 1)
        one = spans_hashed(words, first, first + width)
        chosen = minima(one, guarantee - width + 1)
        if names_only:
            parts.append((one[chosen],))
            continue
        beside[BESIDE + a : BESIDE + a + len(s)] = np.maximum(words >> np.uint64(40) & np.uint64(255), np.uint64(1))
        other = spans_hashed((words ^ words >> np.uint64(32)) * np.uint64(OTHER), chosen, chosen + width)
        parts.append((one[chosen], a + chosen, other))
    if names_only:
        return (np.concatenate([one for one, in parts]),)
    one, at, other = (np.concatenate(x) for x in zip(*parts))
    near = np.arange(BESIDE)
    left, right = (np.ascontiguousarray(beside[BESIDE + at[:, None] + k]).view(np.int64).ravel() for k in (-1 - near, width + near))
    a, b = starts[at], ends[at + width - 1]
    if not text.isascii():
        point = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32) - 1
        a, b = point[a], point[b - 1] + 1
    return a, b, one, other, left, right


#: Bits of an anchor's hash that name it here, those that choose its bucket, and those that choose its bit in the filter.
#: The highest bits are left out: an anchor has the least hash nearby, so they are mostly zero.
NAME, BUCKET, FILTER = 44, 12, 27
#: Anchors that a task gathers before it hands them on, and that are looked at together in a bucket.
HELD, TOGETHER = 1 << 18, 1 << 16
#: Occurrences from which an anchor's passages, no longer the anchor itself, are brought together.
HOT = 1 << 12


def named(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << NAME) - 1)


def parts_of(names: np.ndarray) -> np.ndarray:
    """Where each bucket begins among sorted names, and where the last one ends."""
    return np.searchsorted(names, np.arange((1 << BUCKET) + 1, dtype=np.uint64) << np.uint64(NAME - BUCKET))


def repeated_anchors(docs: DataFrame, width: int, guarantee: int) -> tuple[np.ndarray, np.ndarray]:
    """A filter of the anchors that occur more than once, and the names of those that occur HOT times.

    Tasks send the names of each bucket as one row, those that they have once apart from
    those with a count. The filter has a fixed size.
    """
    schema, rest = "bucket int, once binary, more binary, n binary", np.uint64((1 << NAME - BUCKET) - 1)
    out, result = pa_schema(docs.sparkSession, schema), pa_schema(docs.sparkSession, "bucket int, bits binary, hot binary")
    bits = 1 << FILTER - BUCKET

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            names, n = np.unique(named(np.concatenate(held)), return_counts=True)
            once, more = names[n == 1], names[n > 1]
            low = ((x & rest).astype(np.uint32) for x in (once, more))
            columns = [packed(next(low), parts_of(once)), packed(next(low), parts_of(more)), packed(n[n > 1].astype(np.uint32), parts_of(more))]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(1 << BUCKET, dtype=np.int32)), *columns], schema=out)

        for batch in batches:
            for part in slices(batch):
                for text in part.column(1).to_pylist():
                    if x := anchored(text or "", width, guarantee, names_only=True):
                        held.append(x[0])
                        size += len(x[0])
                if size >= 4 * HELD:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, 1, 4 * TOGETHER):
            of = table["bucket"].to_numpy()
            rows = []
            for bucket in np.unique(of).tolist():
                here = table.slice(int(np.searchsorted(of, bucket)), int((of == bucket).sum()))
                once, more, n = (unpacked(here[c].combine_chunks(), np.uint32) for c in ("once", "more", "n"))
                low, at = np.unique(np.concatenate([once, more]), return_inverse=True)
                total = np.bincount(at, np.concatenate([np.ones(len(once)), n]), len(low))
                known = np.zeros(bits, bool)
                known[low[total > 1] >> np.uint32(NAME - FILTER)] = True
                hot = low[total >= HOT].astype(np.uint64) | np.uint64(bucket << NAME - BUCKET)
                rows.append((bucket, np.packbits(known, bitorder="little").tobytes(), hot.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), result)], schema=result)

    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, schema)
    with freed_shuffles(docs.sparkSession):
        got = counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(repeated, "bucket int, bits binary, hot binary").toArrow()
    known = np.zeros((1 << BUCKET, bits // 8), np.uint8)
    if got.num_rows:
        known[got["bucket"].to_numpy()] = unpacked(got["bits"].combine_chunks(), np.uint8).reshape(got.num_rows, -1)
    return known.ravel(), np.sort(unpacked(got["hot"].combine_chunks(), np.uint64))


def in_filter(known: np.ndarray, names: np.ndarray) -> np.ndarray:
    bit = names >> np.uint64(NAME - FILTER)
    return known[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1) != 0


def mixed(*values: np.ndarray) -> np.ndarray:
    """A hash of some numbers for each row."""
    h = np.uint64(BASE)
    for v in values:
        h = (h ^ v) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def shared_runs(one: np.ndarray, other: np.ndarray, left: np.ndarray, right: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the passages around anchors that are ``slack`` words longer, and whose they are.

    One key for each number of words on the left, if the text has these; two occurrences
    with a key in common share that passage.
    """
    base, keys, of = mixed(one, other), [], []
    for n in range(slack + 1):
        has, near = np.ones(len(one), bool), []
        for side, k in ((left, n), (right, slack - n)):
            if k:
                has &= side >> np.uint64(8 * k - 8) & np.uint64(255) != 0
            near.append(side & np.uint64((1 << 8 * k) - 1))
        keys.append(mixed(base, *near, np.uint64(n))[has])
        of.append(np.flatnonzero(has))
    return np.concatenate(keys), np.concatenate(of)


#: The place of an occurrence; ``known`` is 0 for a null ``doc_id`` and NONE where there is no place. ``h`` has the high half of the text's hash.
PLACE = np.dtype([("known", "i1"), ("doc", "i8"), ("h", "i4"), ("start", "i4")])
NONE = 2
#: What a block asks of a bucket: an anchor with the words beside it, or (``hot``) the key of a passage, and the block's first place with it.
ITEM = np.dtype([("one", "u8"), ("other", "u4"), ("left", "u8"), ("right", "u8"), ("hot", "?"), ("again", "?"), *PLACE.descr])
#: What a block keeps: its occurrences with their items, its texts, and the items of hot occurrences.
OCCURRENCE = np.dtype([("text", "i4"), ("start", "i4"), ("length", "i4"), ("one", "u8"), ("item", "i4")])
TEXT, PAIR = np.dtype([("known", "i1"), ("doc", "i8"), ("h", "i8")]), np.dtype([("occurrence", "i4"), ("item", "i4")])


def ranks(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal places, ascending, and a row of each number."""
    columns = [places[c] for c in PLACE.names]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= np.diff(c[order]) != 0
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def block_of(texts: np.ndarray, found: list[tuple[np.ndarray, ...]], hot: np.ndarray, slack: int) -> tuple[np.ndarray, ...]:
    """OCCURRENCEs, PAIRs and sorted ITEMs of a block, and where the items of each bucket begin."""
    text = np.repeat(np.arange(len(found), dtype=np.int32), [len(f[0]) for f in found])
    a, b, one, other, left, right = (np.concatenate(c) for c in zip(*found))
    other, left, right = other >> np.uint64(32), left.view(np.uint64), right.view(np.uint64)
    places = np.zeros(len(text), PLACE)
    for c, v in (("known", texts["known"][text]), ("doc", texts["doc"][text]), ("h", texts["h"][text] >> 32), ("start", a)):
        places[c] = v
    rank, row = ranks(places)
    frequent = np.isin(named(one), hot)
    plain, busy = np.flatnonzero(~frequent), np.flatnonzero(frequent)
    keys, of = shared_runs(one[busy], other[busy], left[busy], right[busy], slack)
    # An item's bucket comes first in its order, then a hash of all that it asks.
    bucket = np.uint64((1 << BUCKET) - 1 << NAME - BUCKET)
    names = np.concatenate([one[plain], keys]) & bucket
    names = names << np.uint64(64 - NAME) | np.concatenate([mixed(one[plain], other[plain], left[plain], right[plain]), mixed(keys)]) >> np.uint64(BUCKET)
    occurrence = np.concatenate([plain, busy[of]])
    distinct, at, item = np.unique(names, return_index=True, return_inverse=True)
    least, most = np.full(len(distinct), len(rank)), np.full(len(distinct), -1)
    np.minimum.at(least, item, rank[occurrence])
    np.maximum.at(most, item, rank[occurrence])
    items = np.zeros(len(distinct), ITEM)
    is_key, of_item = at >= len(plain), occurrence[at]
    for c, v in (("one", one), ("other", other), ("left", left), ("right", right)):
        items[c] = np.where(is_key, 0, v[of_item])
    items["one"][is_key] = keys[at[is_key] - len(plain)]
    items["hot"], items["again"] = is_key, least != most
    for c in PLACE.names:
        items[c] = places[c][row[least]]
    rows = np.zeros(len(text), OCCURRENCE)
    for c, v in (("text", text), ("start", a), ("length", b - a), ("one", one), ("item", -1)):
        rows[c] = v
    rows["item"][plain] = item[: len(plain)]
    pairs = np.zeros(len(of), PAIR)
    pairs["occurrence"], pairs["item"] = busy[of], item[len(plain) :]
    return rows, pairs, items, np.searchsorted(distinct, np.arange(1 << BUCKET, dtype=np.uint64) << np.uint64(64 - BUCKET)).tolist() + [len(distinct)]


BLOCKS = "block long, bucket int, items binary, occurrences binary, texts binary, pairs binary"


def anchor_blocks(docs: DataFrame, width: int, guarantee: int, repeated: np.ndarray, hot: np.ndarray) -> DataFrame:
    """Blocks of the texts' anchors that the filter knows: a row with its occurrences (bucket -1), and one of items for each bucket."""
    out, slack = pa_schema(docs.sparkSession, BLOCKS), guarantee - width
    known = docs.sparkSession.sparkContext.broadcast((repeated, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, frequent = known.value
        block, size = TaskContext.get().partitionId() << 32, 0
        texts, found = [], []

        def emit() -> pa.RecordBatch:
            of = np.array(texts, TEXT)
            rows, pairs, items, at = block_of(of, found, frequent, slack)
            at = np.array(at)
            n = len(at) - 1
            own = [pa.array([x.tobytes(), *[None] * n], pa.binary()) for x in (rows, of, pairs)]
            columns = [pa.array(np.full(n + 1, block)), pa.array(np.arange(-1, n, dtype=np.int32)), pa.concat_arrays([pa.nulls(1, pa.binary()), packed(items, at)]), *own]
            return pa.RecordBatch.from_arrays(columns, schema=out).filter(np.concatenate([[True], np.diff(at) > 0]))

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if x := anchored(text or "", width, guarantee):
                        wanted = in_filter(filled, named(x[2]))
                        if n := int(wanted.sum()):
                            texts.append((doc is not None, doc or 0, hash_of(text)))
                            found.append(tuple(c[wanted] for c in x))
                            size += n
                    if size >= HELD:
                        yield emit()
                        texts, found, size, block = [], [], 0, block + 1
        if found:
            yield emit()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def first_places(items: np.ndarray, slack: int) -> np.ndarray:
    """For each item the first place that shares a passage with it, if there are two of them."""
    rank, row = ranks(items)
    nothing = len(row)
    names = np.where(items["hot"], items["one"], mixed(*(items[c].astype(np.uint64) for c in ("one", "other", "left", "right"))))
    _, at, back = np.unique(names, return_index=True, return_inverse=True)
    least, most = np.full(len(at), nothing), np.full(len(at), -1)
    np.minimum.at(least, back, rank)
    np.maximum.at(most, back, np.where(items["again"], nothing, rank))
    one = items[at]
    plain, busy = np.flatnonzero(~one["hot"]), np.flatnonzero(one["hot"])
    keys, of = shared_runs(*(one[c][plain].astype(np.uint64) for c in ("one", "other", "left", "right")), slack)
    keys, of = np.concatenate([keys, one["one"][busy]]), np.concatenate([plain[of], busy])
    order = np.argsort(keys)
    keys, of = keys[order], of[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    kept = np.full(len(at), nothing)
    if len(begins):
        low, high = np.minimum.reduceat(least[of], begins), np.maximum.reduceat(most[of], begins)
        low[low == high] = nothing
        np.minimum.at(kept, of, np.repeat(low, np.diff(begins, append=len(keys))))
    out = np.zeros(len(items), PLACE)
    out["known"] = NONE
    kept = kept[back]
    some = kept < nothing
    for c in PLACE.names:
        out[c][some] = items[c][row[kept[some]]]
    return out


def answered(asked: DataFrame, slack: int) -> DataFrame:
    """(block, bucket, places): the first places of each row's items."""
    schema = "block long, bucket int, places binary"
    out = pa_schema(asked.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, 2, ITEM.itemsize * TOGETHER):
            data = table["items"].combine_chunks()
            sizes = pa.compute.binary_length(data).to_numpy() // ITEM.itemsize
            places = first_places(unpacked(data, ITEM), slack)
            yield pa.RecordBatch.from_arrays([table["block"].combine_chunks(), table["bucket"].combine_chunks(), packed(places, np.concatenate([[0], np.cumsum(sizes)]))], schema=out)

    dealt = asked.where("bucket >= 0").select("bucket", "block", "items")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


SPANS = "doc_id long, h long, start long, end long, class_id long, kept_doc_id long, kept_start long"


def spans_of(rows: np.ndarray, texts: np.ndarray, pairs: np.ndarray, places: np.ndarray) -> list[pa.Array]:
    """The columns of SPANS from a block's occurrences, texts and pairs, and the places of its items."""
    rank, row = ranks(places)
    none = len(row)
    rank[places["known"] == NONE] = none
    first = np.where(rows["item"] >= 0, rank[rows["item"]], none)
    np.minimum.at(first, pairs["occurrence"], rank[pairs["item"]])
    rows, first = rows[first < none], first[first < none]
    kept, of = places[row[first]], texts[rows["text"]]
    later = (kept["known"] != of["known"]) | (kept["doc"] != of["doc"]) | (kept["h"] != of["h"] >> 32) | (kept["start"] != rows["start"])
    rows, kept, of = rows[later], kept[later], of[later]
    order = np.lexsort((rows["start"], kept["h"], kept["doc"], kept["known"], rows["text"]))
    rows, kept, of = rows[order], kept[order], of[order]
    start, end = rows["start"].astype(np.int64), rows["start"].astype(np.int64) + rows["length"]
    new = np.ones(len(rows), bool)
    new[1:] = start[1:] > end[:-1]
    for c in (rows["text"], kept["known"], kept["doc"], kept["h"]):
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(rows))[: len(at)] - 1
    of, kept = of[at], kept[at]
    return [pa.array(of["doc"], mask=of["known"] == 0), pa.array(of["h"]), pa.array(start[at]), pa.array(end[last]), pa.array(rows["one"][at].view(np.int64)), pa.array(kept["doc"], mask=kept["known"] == 0), pa.array(kept["start"].astype(np.int64))]


def repeated_passages(docs: DataFrame, width: int = WIDTH, guarantee: int = GUARANTEE) -> DataFrame:
    """(doc_id, h, start, end, class_id, kept_doc_id, kept_start): stretches that repeat earlier ones.

    Every passage of ``guarantee`` words that repeats an earlier one has a row, which lies
    inside the repeat and lacks at most ``guarantee - width`` words at each of its ends.
    Anchors that overlap and repeat the same document become one row.
    """
    slack = guarantee - width
    if not 0 <= slack <= BESIDE:
        raise ValueError(f"a passage may be up to {BESIDE} words longer than its anchor, not {slack}")
    out = pa_schema(docs.sparkSession, SPANS)

    def spans(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows, texts, pairs = (unpacked(own[c].combine_chunks(), t) for c, t in (("occurrences", OCCURRENCE), ("texts", TEXT), ("pairs", PAIR)))
        places = unpacked(answers.sort_by("bucket")["places"].combine_chunks(), PLACE)
        return pa.Table.from_arrays(spans_of(rows, texts, pairs, places), schema=out)

    with Tables(docs.sparkSession) as tables:
        blocks = tables.store(anchor_blocks(docs, width, guarantee, *repeated_anchors(docs, width, guarantee)))
        answers = tables.store(answered(blocks, slack))
        own = blocks.where("bucket < 0").select("block", "occurrences", "texts", "pairs")
        found = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(spans, SPANS)
        # Repeated rows of a text have the same spans.
        return cut(found.distinct())


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end, class_id, kept_doc_id, kept_start): what later texts repeat."""
    columns = ["doc_id", "h", "kind", "start", "end", "class_id", "kept_doc_id", "kept_start"]
    first = similar_paragraphs(docs, MIN_WORDS).withColumn("kind", F.lit("paragraph"))
    return first.select(columns).union(repeated_passages(docs).withColumn("kind", F.lit("passage")).select(columns))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``repeats`` without the texts' hashes."""
    return repeats(docs).drop("h")


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row without what ``repeats`` finds in its text; a null text becomes empty."""
    spans = repeats(docs).groupBy(F.col("doc_id").alias("cut id"), F.col("h").alias("cut hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at = [], 0
                for span in cuts or ():
                    parts.append((text or "")[at : max(at, span["start"])])
                    at = max(at, span["end"])
                texts.append("".join([*parts, (text or "")[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    own = docs.select("doc_id", "text")
    joined = own.join(spans, own["doc_id"].eqNullSafe(spans["cut id"]) & (text_hash() == spans["cut hash"]), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(rows, "doc_id long, text string")
