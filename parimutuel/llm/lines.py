"""Line dedup (operator 10): winnowing over line hashes.

A text's lines (trimmed, blank ones left out) are hashed; of each window of lines
the least hash is a fingerprint, so any run of a window's length that two texts
share gives them a common fingerprint. Positions of repeated fingerprints are
joined and extended both ways by their neighbouring lines; matched windows that
follow each other form runs, and every run but the first of its kind is deleted.

One or two lines of many words are windows too where ``words`` tells how many words
they must have together; each of these is a fingerprint of its own.

Exactly: a line goes if some window over it occurred earlier, where earlier means
a smaller ``doc_id``, of different texts of one ``doc_id`` the smaller hash, and in one
text the smaller line number.

Defined results: null and empty texts, and texts with fewer lines than a window,
lose nothing and stay as they are; lines are compared whole; a null ``doc_id``
sorts first; of repeated rows (same ``doc_id`` and text) one place stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, cut, hash_of, map_texts, spread_join, text_hash

#: Lines of a window, and so of the shortest run that goes.
WINDOW = 3
#: Words that make fewer lines a window when documents are rewritten.
MANY_WORDS = 20
BLANKS = " \t\r\x0b\x0c"


def fingerprints(text: str, window: int, words: int | None = None) -> Iterator[tuple[int, int, int, list[int], list[int]]]:
    """Hash, lines of a window, number of windows, hashes and line numbers around each window minimum.

    Ties go to the last of the least lines, in every window alike.
    """
    kept = [(k, s) for k, line in enumerate(text.split("\n")) if (s := line.strip(BLANKS))]
    n = len(kept)
    if n < window and words is None:
        return
    numbers = [k for k, _ in kept]
    hashes = [xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63) for _, s in kept]
    if words is not None:
        counts = [len(s.split()) for _, s in kept]
        for size in range(1, window):
            for j in range(n - size + 1):
                if sum(counts[j : j + size]) >= words:
                    yield hashes[j], size, 1, hashes[j : j + size], numbers[j : j + size]
    if n < window:
        return
    views = np.lib.stride_tricks.sliding_window_view(np.array(hashes), window)
    least = window - 1 - views[:, ::-1].argmin(axis=1) + np.arange(n - window + 1)
    for p in np.unique(least).tolist():
        covering = np.flatnonzero(least == p) if n < 64 else np.arange(max(0, p - window + 1), min(p, n - window) + 1)
        covering = [j for j in covering.tolist() if least[j] == p]
        a, b = covering[0], covering[-1] + window
        yield hashes[p], window, len(covering), hashes[a:b], numbers[a:b]


SCHEMA = "doc_id long, h long, fp long, size int, windows int, hashes array<long>, lines array<int>"


def positions(docs: DataFrame, window: int, words: int | None) -> DataFrame:
    def rows(ids, texts):
        found = [(doc, hash_of(t), *f) for doc, t in zip(ids.to_pylist(), texts) if "\n" in t or window == 1 or words is not None for f in fingerprints(t, window, words)]
        return [*zip(*found)] if found else [[]] * 7

    return map_texts(docs, rows, SCHEMA)


def repeats(docs: DataFrame, window: int = WINDOW, words: int | None = None) -> DataFrame:
    """(doc_id, h, line, last, kept_doc_id, kept_h, kept_line): each window of lines that occurred earlier; ``h`` is the text's hash."""
    with Tables(docs.sparkSession) as tables:
        found = tables.store(positions(docs, window, words))
        place = F.struct("doc_id", "h", F.col("lines")[0].alias("line"))
        shared = found.groupBy("fp").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("fp")
        joined = spread_join(found, shared, ["fp"])
        # The windows around a fingerprint are all whose least line it is: they extend it both ways.
        at = F.explode(F.sequence(F.lit(0), F.col("windows") - 1))
        windows = joined.select("doc_id", "h", "fp", "size", "hashes", "lines", at.alias("at")).select("doc_id", "h", F.slice("hashes", F.col("at") + 1, F.col("size")).alias("content"), F.get("lines", F.col("at")).alias("line"), F.get("lines", F.col("at") + (F.col("size") - 1)).alias("last"))
        windows = tables.store(windows)
        here = F.struct("doc_id", "h", "line")
        firsts = windows.groupBy("content").agg(F.min(here).alias("kept"), F.max(here).alias("latest")).where("kept <> latest").select("content", "kept")
        return cut(spread_join(windows, firsts, ["content"]).where(here != F.col("kept")).select("doc_id", "h", "line", "last", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.h").alias("kept_h"), F.col("kept.line").alias("kept_line")))


def repeated_runs(docs: DataFrame, window: int = WINDOW, words: int | None = None) -> DataFrame:
    """(doc_id, line, last, kept_doc_id, kept_line): runs of lines that go, and the first of their kind.

    ``line`` and ``last`` are the numbers of a run's first and last line, from 0.
    """
    shifted = repeats(docs, window, words).distinct().withColumn("shift", F.col("kept_line") - F.col("line"))
    along = Window.partitionBy("doc_id", "h", "kept_doc_id", "kept_h", "shift").orderBy("line")
    new = F.coalesce(F.col("line") > F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = shifted.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(along))
    merged = runs.groupBy("doc_id", "h", "kept_doc_id", "kept_h", "shift", "run").agg(F.min("line").alias("line"), F.max("last").alias("last"), F.min("kept_line").alias("kept_line"))
    return merged.select("doc_id", *(F.col(c).cast("long") for c in ("line", "last", "kept_doc_id", "kept_line")))


def deduplicated(docs: DataFrame, window: int = WINDOW, words: int | None = MANY_WORDS) -> DataFrame:
    """The documents, all columns, without repeated runs in ``text``; ``n_chars``, if there, follows.

    Only documents that lose lines are rewritten.
    """
    spans = repeats(docs, window, words).groupBy(F.col("doc_id").alias("cut id"), F.col("h").alias("cut hash")).agg(F.collect_set(F.struct("line", "last")).alias("cut spans"))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["cut id"]) & (text_hash() == spans["cut hash"]), "left").drop("cut id", "cut hash")
    parts = F.split("text", "\n")
    gone = F.flatten(F.transform("cut spans", lambda s: F.sequence(s["line"], s["last"])))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    left = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    text = F.when(F.col("cut spans").isNotNull(), left).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        n = F.when(F.col("cut spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n)
    return out.select(docs.columns)
