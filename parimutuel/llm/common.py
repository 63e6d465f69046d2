"""Helpers that the training-data operators share.

Text operators run as one Arrow pass over ``doc_id`` and ``text`` alone, so any
further columns, whatever their names, neither travel nor clash.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoint import cut, freed_shuffles, shared_folder  # noqa: F401  cut is for the operators

#: Rows handled at once inside a task; bounds the memory of a Python worker.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Tables:
    """Intermediate Parquet tables in the shared folder, deleted when the block ends.

    Takes a fraction of a checkpoint's room. What leaves the block must not read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Tables:
        return self

    def store(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n}"
        with freed_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def __exit__(self, *_) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join whose two sides are shuffled for it alone.

    A side that was just aggregated by the same keys would hand its partitions on,
    and adaptive execution could then not split the partition of a hot key. With the
    keys' hash as one more key both sides get an exchange of their own.
    """
    tag = F.xxhash64(*keys)
    left, right = left.withColumn("hash of keys", tag), right.withColumn("hash of keys", tag)
    return left.join(right, [*keys, "hash of keys"], how).drop("hash of keys")


def text_hash():
    """XXH64 of ``text``, as ``hash_of`` gives it; tells apart different texts of one ``doc_id``."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def hash_of(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


#: What a worker process keeps from task to task, by the module whose passes need it.
KEPT: dict[str, dict] = {}


def kept(module: str) -> dict:
    """What this module's passes keep in a worker process; what another module's have left there goes."""
    if module not in KEPT:
        KEPT.clear()
    return KEPT.setdefault(module, {})


@contextmanager
def at_work(module: str) -> Iterator[None]:
    """A pass of this module in a worker process, which idles with no more memory than it still uses."""
    kept(module)
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library's
            trim(0)


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each, one row at least."""
    if not batch.num_rows:
        return
    texts = batch.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_texts(docs: DataFrame, fn: Callable[[pa.Array, list[str]], list], schema: str, *more: str) -> DataFrame:
    """Apply ``fn(ids, texts)`` to slices of (doc_id, text); null texts are empty.

    ``fn`` returns one sequence (list, numpy or Arrow array) per column of schema.
    """
    out = pa_schema(docs.sparkSession, schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = fn(part.column(0), [t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with at_work(fn.__module__):
            yield from mapped(batches)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def text_filter(judge: Callable[[Iterator[list[str]]], Iterator[np.ndarray]], module: str):
    """A filter for columns that judges texts by themselves, in slices; null texts are empty.

    ``judge`` gives one boolean a text, in order, in arrays of any length.
    """

    @F.arrow_udf("boolean")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with at_work(module):
            parts = (p.column(0).to_pylist() for c in columns for p in slices(pa.RecordBatch.from_arrays([c], ["text"]), 0))
            yield from map(pa.array, judge([t or "" for t in p] for p in parts))

    return run


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The values between each two of these places, as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


def unpacked(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), dtype)


def whole_buckets(batches: Iterator[pa.RecordBatch], column: int, least: int) -> Iterator[pa.Table]:
    """Rows sorted by bucket (column 0) as tables that part no bucket, of about so many bytes in a column."""
    held, size, last = [], 0, None
    for batch in batches:
        buckets, sizes = batch.column(0).to_numpy(), pa.compute.binary_length(batch.column(column)).to_numpy()
        at = 0
        for first in np.flatnonzero(np.diff(buckets, prepend=-1 if last is None else last)):
            if size + sizes[at:first].sum() >= least:
                yield pa.Table.from_batches([*held, batch.slice(at, first - at)])
                held, size, at = [], 0, first
        if batch.num_rows:
            held.append(batch.slice(at))
            size, last = size + sizes[at:].sum(), buckets[-1]
    if held:
        yield pa.Table.from_batches(held)


#: A-Z to a-z and nothing else.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")


def words_of(text: str) -> list[bytes]:
    """Words between blanks, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def grams(words: list[bytes], width: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``width`` words; of the whole sequence where it is shorter."""
    if not words:
        return []
    line = b" ".join(words)
    if len(words) < width:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
