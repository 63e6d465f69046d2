"""Benchmark decontamination (operator 1): pigeonhole edit matching.

An item may occur in a text with edits, up to an error budget in proportion to its
length. Cut into one piece more than the budget, some piece must occur unchanged.
Pieces have few lengths; for each, the hashes of all windows of a text are looked up
among those of the pieces. Most hits are chance, the more the more items there are, so
a hit is verified in steps: joined in pairs, pairs of pairs and so on, some piece that
occurs unchanged must lie in joined pieces that match within one edit less than they
have pieces, at each step. The first steps are taken for all hits at once. Around what
is left, Myers' bit-parallel algorithm computes the least edit distance of the whole
item to any stretch there, which alone decides.

Texts and items are compared as streams of words (letters, digits and all from
U+0080 on, A-Z lower-cased) with one blank between.

Defined results: null and empty texts have no matches; an item without words, or
null, matches nothing; repeated items or documents give repeated pairs; texts and
items of any length are matched whole; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, pa_schema, text_filter
from .licenses import STREAM
from .paragraphs import powers

#: Edits allowed for each character of an item.
BUDGET = 0.08
#: Characters of items in a block; a worker holds KEPT_BLOCKS of them, more take turns.
BLOCK_CHARS, KEPT_BLOCKS = 8_000_000, 2
#: Characters of text that blocks taking turns are matched with before the next are read.
HELD_CHARS = 32_000_000
#: Joined pieces up to so many are verified for all hits at once.
JOINED = 8
#: Characters whose windows are hashed at once.
PART = 1 << 18


def normal(text: str) -> str:
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(STREAM).split()).decode("utf-8", "surrogatepass")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of about equal length, with their offsets."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern(NamedTuple):
    """Myers' view of an item: for each character the bits of the places it stands at."""

    places: dict[str, int]
    length: int

    @classmethod
    def of(cls, item: str) -> Pattern:
        places: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            places[c] |= 1 << i
        return cls(dict(places), len(item))

    def distance(self, text: str) -> tuple[int, int]:
        """Least edit distance to any stretch of ``text``, and the first place where one ends."""
        m = self.length
        top, mask = 1 << m - 1, (1 << m) - 1
        up, down, now = mask, 0, m
        best, end = m, 0
        places = self.places
        for j, c in enumerate(text, 1):
            eq = places.get(c, 0)
            x = eq | down
            d = ((eq & up) + up ^ up) | eq
            plus = down | ~(d | up) & mask
            minus = up & d
            if plus & top:
                now += 1
            elif minus & top:
                now -= 1
            plus = plus << 1 & mask  # a match may begin anywhere, so no border bit comes in
            up = (minus << 1 | ~(x | plus)) & mask
            down = plus & x
            if now < best:
                best, end = now, j
        return best, end


MIX = np.uint64(0x9E3779B97F4A7C15)


def prefixes(text: str) -> np.ndarray:
    """Sums from which the hash of any stretch of the text follows, whatever its place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    values = (codes + np.uint64(1)) * MIX
    values ^= values >> np.uint64(29)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values * powers(size_of(text))[1][: len(codes)], out=sums[1:])
    return sums


def size_of(text: str) -> int:
    """A number of powers that is enough, and the same for texts of about a size."""
    return 1 << max(12, (len(text) + 1).bit_length())


def hashed(text: str, sums: np.ndarray, starts, ends) -> np.ndarray:
    """Hashes of the stretches from ``starts`` (indices or a slice) to ``ends``."""
    h = (sums[ends] - sums[starts]) * powers(size_of(text))[0][starts]
    h *= MIX
    return h ^ h >> np.uint64(32)


def cuts(length: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where piece ``k`` of ``n`` begins."""
    return length * k // n


def extended(text: np.ndarray, items: np.ndarray, place: np.ndarray, at: np.ndarray, size: np.ndarray, step: int, budget: int) -> np.ndarray:
    """The edits that ``size`` characters of items, from ``at`` on, need to match the text from ``place`` on.

    Both are read in direction ``step``; more than ``budget`` edits count as one more.
    """
    width, far = 2 * budget + 1, budget + 1
    shift = np.arange(width) - budget
    cost = np.where(shift >= 0, np.minimum(shift, far), far).astype(np.int8)
    cost = np.repeat(cost[:, None], len(place), axis=1)
    out = cost.min(axis=0)
    last = len(text) - 1
    for i in range(int(size.max(initial=0))):
        wanted = items[np.clip(at + step * i, 0, len(items) - 1)]
        found = place + step * (i + shift[:, None])
        inside = (found >= 0) & (found <= last)
        unequal = (text[np.clip(found, 0, last)] != wanted) | ~inside | (i + shift[:, None] < 0)
        new = np.minimum(cost + unequal, far)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        for d in range(1, width):
            new[d] = np.minimum(new[d], new[d - 1] + 1)
        cost = new
        ends = size == i + 1
        out[ends] = cost[:, ends].min(axis=0)
    return out


class Matcher:
    """The items of a block, and the hashes of their pieces by length."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        self.items: list[tuple[int, str, int]] = []
        self.patterns: dict[int, Pattern] = {}
        of: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for item_id, text in items:
            if not (item := normal(text or "")):
                continue
            allowed = int(len(item) * budget)
            cut = np.array([at for at, _ in pieces(item, allowed)] + [len(item)])
            sizes = np.diff(cut)
            h = hashed(item, prefixes(item), cut[:-1], cut[1:])
            for size in np.unique(sizes):
                own = sizes == size
                of[int(size)].append((h[own], np.full(own.sum(), len(self.items)), np.flatnonzero(own)))
            self.items.append((item_id, item, allowed))
        self.length = np.array([len(i) for _, i, _ in self.items], np.int64)
        self.n = np.array([allowed + 1 for *_, allowed in self.items], np.int64)
        self.begins = np.cumsum(self.length) - self.length
        self.codes = np.frombuffer("".join(i for _, i, _ in self.items).encode("utf-32-le", "surrogatepass"), np.uint32)
        #: By length: pieces' hashes in order, their items and numbers; and a filter of the hashes.
        self.pieces = {}
        for size, found in of.items():
            h, item, piece = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h)
            bits = max(16, (16 * len(h)).bit_length())
            filter_ = np.zeros(1 << bits, bool)
            filter_[(h >> np.uint64(64 - bits)).view(np.int64)] = True
            self.pieces[size] = h[order], item[order], piece[order], bits, filter_

    def hits(self, joined: str) -> tuple[np.ndarray, ...]:
        """Items, the places of their pieces, and those where the items would begin."""
        found, raw, size_of_raw = [(np.zeros(0, np.int64),) * 3], [], 0
        longest = max(self.pieces, default=0)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        for a in range(0, len(joined), PART):
            text = joined[a : a + PART + longest - 1]
            sums = prefixes(text)
            for size, (known, item, piece, bits, filter_) in self.pieces.items():
                n = min(PART, len(text) - size + 1)
                if n <= 0:
                    continue
                h = hashed(text, sums, slice(0, n), slice(size, size + n))
                place = np.flatnonzero(filter_[(h >> np.uint64(64 - bits)).view(np.int64)])
                first, last = (np.searchsorted(known, h[place], side) for side in ("left", "right"))
                times = last - first
                # Each place as often as there are pieces with its hash.
                which = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - first, times)
                raw.append((item[which], np.repeat(place, times) + a, piece[which]))
                size_of_raw += len(which)
                if size_of_raw >= PART:
                    found.append(self.joinable(codes, *(np.concatenate(x) for x in zip(*raw))))
                    raw, size_of_raw = [], 0
        if size_of_raw:
            found.append(self.joinable(codes, *(np.concatenate(x) for x in zip(*raw))))
        return tuple(np.concatenate(x) for x in zip(*found))

    def joinable(self, text: np.ndarray, item: np.ndarray, place: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, ...]:
        """The hits whose piece, joined with its neighbours step by step, matches within what each step allows."""
        # From the whole item down to the piece, halves are halved again; steps back up are taken from the end.
        low, high = np.zeros_like(piece), self.n[item]
        halves = [(low, high)]
        while (high - low > 1).any():
            middle = (low + high) // 2
            right = piece >= middle
            parted = high - low > 1
            low, high = np.where(parted & right, middle, low), np.where(parted & ~right, middle, high)
            halves.append((low, high))
        alive = np.arange(len(item))
        for low, high in halves[::-1]:
            count = (high - low)[alive]
            small = alive[(count > 1) & (count <= JOINED)]
            if not len(small):
                continue
            of, lo, hi = item[small], low[small], high[small]
            length, n, begins = self.length[of], self.n[of], self.begins[of]
            start, end = cuts(length, n, piece[small]), cuts(length, n, piece[small] + 1)
            here, budget = place[small], int((hi - lo).max()) - 1
            after = extended(text, self.codes, here + end - start, begins + end, cuts(length, n, hi) - end, 1, budget)
            before = extended(text, self.codes, here - 1, begins + start - 1, start - cuts(length, n, lo), -1, budget)
            fails = np.zeros(len(item), bool)
            fails[small] = after.astype(np.int64) + before > hi - lo - 1
            alive = alive[~fails[alive]]
        return item[alive], place[alive], place[alive] - cuts(self.length[item[alive]], self.n[item[alive]], piece[alive])

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item_id, distance, end in the word stream) of each item that a text holds."""
        streams = [normal(t) for t in texts]
        begins = np.cumsum([0] + [len(t) + 1 for t in streams])
        item, place, start = self.hits("\0".join(streams))
        text = np.searchsorted(begins, place, side="right") - 1
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        edges = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(item, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(text)]):
            k = int(text[a])
            item_id, words, allowed = self.items[item[a]]
            if item[a] not in self.patterns:
                self.patterns[item[a]] = Pattern.of(words)
            best, pattern = None, self.patterns[item[a]]
            for x, y in regions((start[a:b] - begins[k]).tolist(), pattern.length, allowed):
                distance, end = pattern.distance(streams[k][max(0, x) : y])
                if distance <= allowed and (best is None or distance < best[0]):
                    best = distance, max(0, x) + end
            if best:
                yield k, item_id, *best


def regions(starts: list[int], length: int, allowed: int) -> Iterator[tuple[int, int]]:
    """Stretches that hold every place an item can begin at, near ones joined."""
    a = b = None
    for s in starts:
        if a is None:
            a, b = s - allowed, s + length + allowed
        elif s - allowed <= b:
            b = s + length + allowed
        else:
            yield a, b
            a, b = s - allowed, s + length + allowed
    if a is not None:
        yield a, b


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, so that no broadcast grows with the benchmark."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select("item_id", F.col("text").cast("string")).where("text IS NOT NULL").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


#: The matchers that a worker process keeps from task to task, the last used last.
KEPT: dict[str, Matcher] = {}


class Shared:
    """A block's items as a broadcast, and the matcher that a worker makes of them."""

    def __init__(self, spark: SparkSession, block: list[tuple[int, str]], budget: float):
        self.block, self.budget, self.name = spark.sparkContext.broadcast(block), budget, uuid4().hex

    def matcher(self) -> Matcher:
        kept = KEPT.pop(self.name, None)
        if kept is None:
            while len(KEPT) >= KEPT_BLOCKS:
                del KEPT[next(iter(KEPT))]
            kept = Matcher(self.block.value, self.budget)
        KEPT[self.name] = kept
        return kept


def shared_blocks(benchmark: DataFrame, budget: float) -> list[Shared]:
    return [Shared(benchmark.sparkSession, block, budget) for block in blocks(benchmark)]


def held(batches: Iterator, texts_of: Callable, shared: list[Shared]) -> Iterator[tuple[list, list[str]]]:
    """Batches together with their texts, some at a time where more blocks than a worker holds take turns."""
    some, texts, size = [], [], 0
    for batch in batches:
        own = [t or "" for t in texts_of(batch)]
        some.append(batch)
        texts += own
        size += sum(map(len, own))
        if len(shared) <= KEPT_BLOCKS or size >= HELD_CHARS:
            yield some, texts
            some, texts, size = [], [], 0
    if some:
        yield some, texts


def all_matches(shared: list[Shared], texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """What ``Matcher.matches`` finds in all blocks."""
    ends = np.cumsum([len(t) for t in texts])
    # Last time's last block first: it is still there.
    for block in shared if not shared or shared[0].name in KEPT else shared[::-1]:
        for a, b in parts(ends):
            for k, *found in block.matcher().matches(texts[a:b]):
                yield a + k, *found


def parts(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts, by where each ends, with about SLICE_BYTES of text, one text at least."""
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield at, to
        at = to


def holds(shared: list[Shared]):
    """Whether a text holds an item, for columns."""

    def found(parts: Iterator[list[str]]) -> Iterator[np.ndarray]:
        for _, texts in held(parts, lambda p: p, shared):
            out = np.zeros(len(texts), bool)
            out[[k for k, *_ in all_matches(shared, texts)]] = True
            yield out

    return text_filter(found, __name__)


LEAKS = "doc_id long, item_id long, distance int, ends long"


def leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(doc_id, item_id, distance, ends): each document's items, with the least distance.

    ``ends`` is the place in the document's word stream where the closest match ends.
    """
    shared, out = shared_blocks(benchmark, budget), pa_schema(docs.sparkSession, LEAKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, texts in held(batches, lambda b: b.column(1).to_pylist(), shared):
            ids = [i for b in some for i in b.column(0).to_pylist()]
            rows = [(ids[k], *m) for k, *m in all_matches(shared, texts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, LEAKS)


def decontaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The documents, all columns, that hold no item.

    Each row is judged by its text alone, in place: no text is shuffled, and rows
    with null or repeated ids don't touch each other. All blocks of items are looked up
    in one pass.
    """
    shared = shared_blocks(benchmark, budget)
    return docs.where(~holds(shared)(F.col("text").cast("string"))) if shared else docs
