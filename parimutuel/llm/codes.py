"""Vector code compression (operator 13): product codes found by partial-distance search.

Components become integers, vectors are cut into equal parts, and each part is
replaced by the number of the nearest entry of its position's codebook. Codebooks
start from the vectors with the smallest ids and are refined by rounds of Lloyd's
algorithm. All arithmetic is on integers, so nothing depends on how rows are dealt.

A part's nearest entry is found dimension by dimension, those with the largest
variance in the codebook first: the entry that is nearest so far is measured to the
end, and a mask drops every entry whose accumulated distance already exceeds it.

A round is one Arrow pass that sums a task's parts per entry and one aggregate of
those sums; only codebooks (64 entries a part) reach the driver.

Defined results: vectors that are null or hold null, NaN or infinite components are
dropped; ties go to the smaller entry; equal ids are rows of their own, ordered by
their components where they start a codebook, and a null id stays and starts one only
after all others; fewer than 64 vectors give fewer entries; an empty table gives no
rows; further columns are ignored. Vectors whose length is no multiple of 16, or
shorter than the longest, count as filled up with zeros. Components are limited to
+-2^30/sqrt(16 * dimensions), beyond which squared distances would not fit into a long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pa_schema, spread_join

#: Equal parts of a vector, entries of a part's codebook, rounds of refinement.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: What a component is multiplied by before it is cut to an integer.
SCALE = 256
#: Vectors searched at once.
CHUNK = 2048


def kept(vectors: DataFrame, *more: str) -> DataFrame:
    """Rows whose vector is there and finite, as doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", *more, v.alias("v")).where(F.col("v").isNotNull() & finite)


def limit(dims: int) -> int:
    """The largest component whose distances, summed over a vector, fit into a long."""
    return math.isqrt((2**63 - 1) // max(1, dims)) // 2


def whole(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x) of each component, vectors in rows, filled up with zeros to ``dims``."""
    offsets = np.asarray(vectors.offsets)
    sizes = np.diff(offsets)
    flat = np.asarray(vectors.values)[offsets[0] : offsets[-1]]
    most = limit(dims)
    cells = np.clip(np.floor(flat * SCALE), -most, most).astype(np.int64)
    if (sizes == dims).all():
        return cells.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = cells
    return out


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry and its squared distance; ties go to the smaller entry."""
    order = np.argsort(-entries.astype(np.float64).var(axis=0), kind="stable") if entries.size else np.zeros(0, np.int64)
    index, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    if not len(order):
        return index, distance
    for a in range(0, len(rows), CHUNK):
        x = rows[a : a + CHUNK]
        # The first dimension is measured for all entries; the nearest by it, to the end.
        reached = (x[:, order[:1]] - entries[:, order[0]]) ** 2
        best = ((x - entries[reached.argmin(axis=1)]) ** 2).sum(axis=1)
        row, entry = np.nonzero(reached <= best[:, None])
        reached = reached[row, entry]
        for d in order[1:]:
            reached += (x[row, d] - entries[entry, d]) ** 2
            alive = reached <= best[row]
            row, entry, reached = row[alive], entry[alive], reached[alive]
        # Complete distances are left; every row keeps at least the entry measured first.
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(reached, starts)
        first = np.where(reached == least[row], entry, len(entries))
        index[a : a + CHUNK], distance[a : a + CHUNK] = np.minimum.reduceat(first, starts), least
    return index, distance


def searched(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances, a column a part; ``books`` is (part, entry, place in the part)."""
    width = books.shape[2]
    found = [nearest(rows[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of the mean of the parts nearest to it; unused ones stay."""
    parts, entries, width = books.shape
    schema = "entry long, total array<long>, n long"
    out = pa_schema(vectors.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            rows = whole(batch.column(0), parts * width)
            for p, found in enumerate(searched(rows, books)[0].T):
                np.add.at(total, p * entries + found, rows[:, p * width : (p + 1) * width])
                n[p * entries : (p + 1) * entries] += np.bincount(found, minlength=entries)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.int64())), pa.array(n[used])], schema=out)

    sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    found = vectors.select("v").mapInArrow(run, schema).groupBy("entry").agg(F.sum("n").alias("n"), *sums).collect()
    flat = books.reshape(-1, width).copy()
    for row in found:
        flat[row.entry] = [int(row[f"s{i}"]) // row.n for i in range(width)]
    return flat.reshape(books.shape)


def codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks of ``kept`` vectors: (part, entry, place in the part)."""
    dims = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-dims // PARTS)
    # Rows without id come last, equal ids by their components.
    few = vectors.orderBy(F.col("vec_id").isNull(), "vec_id", F.transform("v", lambda x: F.floor(x * SCALE))).limit(ENTRIES).select("v").collect()
    start = whole(pa.array([r.v for r in few], pa.list_(pa.float64())), PARTS * width) if few else np.zeros((0, PARTS * width), np.int64)
    books = np.ascontiguousarray(start.reshape(len(few), PARTS, width).transpose(1, 0, 2))
    for _ in range(rounds if few and width else 0):
        books = refined(vectors, books)
    return books


def sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of ``kept`` vectors: entries in order of parts as two hex digits each, and the distance."""
    schema = "vec_id long, label string, code string, error long"
    out = pa_schema(vectors.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, distance = searched(whole(batch.column(2), books.shape[0] * books.shape[2]), books)
            code = [bytes(r).hex() for r in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(distance.sum(axis=1))], schema=out)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "v").mapInArrow(run, schema)


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, embedding): the vectors that codes stand for, in the scale of the input."""
    schema = "vec_id long, embedding array<double>"
    out = pa_schema(codes.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.array([list(bytes.fromhex(c)) for c in batch.column(1).to_pylist()], np.int64).reshape(-1, len(books))
            parts = [books[p][index[:, p]] for p in range(len(books))]
            rows = np.concatenate(parts, axis=1) / SCALE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], schema=out)

    return codes.select("vec_id", "code").mapInArrow(run, schema)


def vector_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept."""
    given = kept(vectors, "label")
    books = codebooks(given)
    coded = encoded(given, books)
    # Rows without label share one sum. A sum beyond a long counts as the largest.
    tag = [F.col("label").isNull().alias("no_label"), F.coalesce("label", F.lit("")).alias("label_key")]
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1)).cast("long")
    tagged = coded.select("vec_id", "code", "error", *tag)
    sums = tagged.groupBy("no_label", "label_key").agg(total.alias("label_error"))
    return spread_join(tagged, sums, ["no_label", "label_key"]).select("vec_id", "code", "error", "label_error", F.lit(sha256(books)).alias("codebooks_sha256"))
