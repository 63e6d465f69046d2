"""Language identification (operator 11): string kernels, landmarks and ridge regression.

Two texts are as similar as the n-grams, of 1 to 4 characters, that both hold: the
blended-spectrum presence kernel, |X and Y| / sqrt(|X| |Y|), over lower-cased letters
with one blank between words. Nyström's method takes a text's kernel values with a
few landmark texts as its features, whitened by the landmarks' own kernel matrix. One
ridge regression a language tells it from the rest, and the highest output wins;
kernel values of a slice of texts are scored by one matrix product.

The classifier is fitted on a bounded sample of labelled rows: SAMPLE texts, dealt
evenly to the languages and drawn by their hash, LANDMARKS of them landmarks, at most
LANGUAGES languages, those with most rows. Texts are turned into kernel values in the
tasks; landmarks and the sample's kernel values reach the driver, no other text does.
Scoring is one Arrow pass over all rows.

Defined results: ``und`` with score 0 where a text is null, empty or without letters, or
where no row was there to learn from; rows with null language teach nothing; copies
teach once a language; texts of any length are read whole; ties go to the language
first in alphabet; a null id counts as an empty one for its checksum; repeated rows
are rows of their own; ``lang``, ``source`` and ``doc_id`` are no input of a prediction;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, map_texts, pa_schema, slices

WIDTHS = 4
SAMPLE, LANDMARKS, LANGUAGES = 4000, 128, 500
#: Landmarks are rather texts up to so many characters, as short as they get where none is.
LANDMARK_CHARS = 2000
#: Strengths of the ridge that leave-one-out errors choose from.
RIDGES = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
MIX = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def normal(text: str) -> np.ndarray:
    """Code points of lower-cased words with a blank before, between and after; none without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    bounded = np.zeros(len(codes) + 2, np.uint64)
    bounded[1:-1] = np.where(letter, codes, 0)
    keep = np.ones(len(bounded), bool)
    keep[1:] = (bounded[1:] != 0) | (bounded[:-1] != 0)
    return bounded[keep]


def grams(text: str) -> np.ndarray:
    """The text's distinct n-grams, as sorted 64-bit hashes."""
    codes = normal(text) + np.uint64(1)
    if not len(codes):
        return codes
    of, every = codes, [codes]
    for n in range(1, min(WIDTHS, len(codes))):
        of = of[:-1] * MIX + codes[n:]
        every.append(of)
    found = np.sort(np.concatenate(every))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


class Landmarks:
    """The landmarks' n-grams, and for each which of them hold it."""

    def __init__(self, texts: list[str]):
        sets = [grams(t) for t in texts]
        self.sizes = np.array([len(s) for s in sets], np.float64)
        self.known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.held = np.zeros((len(self.known), len(sets)), np.float32)
        for i, s in enumerate(sets):
            self.held[np.searchsorted(self.known, s), i] = 1

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of each text with each landmark; all zero without letters."""
        out = np.zeros((len(texts), len(self.sizes)))
        for i, text in enumerate(texts):
            own = grams(text)
            if not len(own):
                continue
            at = np.searchsorted(self.known, own)
            at[at == len(self.known)] = 0
            out[i] = self.held[at[self.known[at] == own]].sum(axis=0) / np.sqrt(len(own) * self.sizes)
        return out


class Model(NamedTuple):
    """Languages in alphabetic order, landmark texts, and weights of kernel values and of a constant."""

    languages: list[str]
    texts: list[str]
    weights: np.ndarray

    def scores(self, kernel: np.ndarray) -> np.ndarray:
        # Row by row, as one product over all rows rounds a text's scores by how many texts are beside it.
        return np.matmul(kernel[:, None], self.weights[:-1])[:, 0] + self.weights[-1]


def fitted(languages: list[str], texts: list[str], own: np.ndarray, kernel: np.ndarray, y: np.ndarray) -> Model:
    """Ridge regressions of +-1 on Nyström features; ``own`` is the landmarks' kernel matrix.

    Every language weighs the same. The ridge is that with the least squared
    leave-one-out error.
    """
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = np.column_stack([kernel @ whiten, np.ones(len(kernel))])
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = 1 / (np.bincount(y, minlength=len(languages))[y] * len(languages))
    gram = features.T @ (features * share[:, None])
    best, weights = np.inf, None
    for ridge in RIDGES:
        penalty = np.full(len(gram), ridge)
        penalty[-1] = 1e-9  # the constant
        inverse = np.linalg.inv(gram + np.diag(penalty))
        w = inverse @ (features.T @ (target * share[:, None]))
        lever = share * np.einsum("ij,jk,ik->i", features, inverse, features)
        left_out = (target - features @ w) / np.maximum(1 - lever, 1e-9)[:, None]
        error = float((share[:, None] * left_out**2).sum())
        if error < best:
            best, weights = error, np.vstack([whiten @ w[:-1], w[-1:]])
    return Model(languages, texts, weights)


def sample(training: DataFrame, size: int = SAMPLE, most: int = LANGUAGES) -> DataFrame:
    """(lang, text, h, share) of about ``size`` rows with letters, dealt evenly to the languages.

    Rows are drawn by their texts' hashes, so how they are dealt does not matter.
    """
    rows = training.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    share = -(-size // max(1, len(counts)))
    # Twice the share is drawn, which leaves enough where some are copies.
    drawn = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(1.0, 2 * share / r.n)))) if counts else F.create_map(F.lit(""), F.lit(0.0))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    some = hashed.where(F.col("h").bitwiseAND(0xFFFFFF) / float(1 << 24) < F.try_element_at(drawn, F.col("lang")))
    once = some.groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = once.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return first.where(F.col("place") <= share).select("lang", "text", "h", F.lit(len(counts)).alias("languages"))


def trained(training: DataFrame, size: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """A model fitted on a sample of the rows; none where there is nothing to learn from."""
    with Tables(training.sparkSession) as tables:
        rows = tables.store(sample(training, size))
        long = F.greatest(F.length("text") - LANDMARK_CHARS, F.lit(0))
        place = F.row_number().over(Window.partitionBy("lang").orderBy(long, "h"))
        chosen = rows.withColumn("place", place).where(F.col("place") <= F.greatest(F.lit(1), F.lit(landmarks) / F.col("languages"))).orderBy("lang", "place").select("lang", "text").collect()
        if not chosen:
            return None
        shared = Shared(training.sparkSession, Model(sorted({r.lang for r in chosen}), [r.text for r in chosen], np.zeros(0)))
        schema = "lang string, h long, k array<double>"
        out = pa_schema(training.sparkSession, schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, 2):
                    kernel = shared.landmarks().kernel(batch.column(2).to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(kernel), pa.list_(pa.float64()))], schema=out)

        seen = rows.select("lang", "h", "text").mapInArrow(run, schema).orderBy("lang", "h").collect()
        model = shared.model.value
        marks = Landmarks(model.texts)
        own = marks.held.T.astype(np.float64) @ marks.held / np.sqrt(np.outer(marks.sizes, marks.sizes))
        y = np.searchsorted(np.array(model.languages, object), [r.lang for r in seen])
        return fitted(model.languages, model.texts, own, np.array([r.k for r in seen]), y)


#: The landmarks that a worker process keeps from task to task.
KEPT: dict[str, Landmarks] = {}


class Shared:
    """A model as a broadcast of bounded size, and the landmarks that a worker makes of it."""

    def __init__(self, spark, model: Model):
        self.model, self.name = spark.sparkContext.broadcast(model), uuid4().hex

    def landmarks(self) -> Landmarks:
        if self.name not in KEPT:
            KEPT.clear()
            KEPT[self.name] = Landmarks(self.model.value.texts)
        return KEPT[self.name]


PREDICTED = "doc_id long, lang_pred string, score double"


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every document, from its text alone."""
    if model is None:
        return map_texts(docs, lambda ids, texts: [ids, [UNKNOWN] * len(texts), np.zeros(len(texts))], PREDICTED)
    shared = Shared(docs.sparkSession, model)

    def rows(ids, texts):
        kernel = shared.landmarks().kernel(texts)
        of = shared.model.value
        outputs = of.scores(kernel)
        best = outputs.argmax(axis=1)
        known = kernel.any(axis=1) | np.array([any(map(str.isalpha, t)) for t in texts])
        score = np.where(known, np.clip((outputs[np.arange(len(texts)), best] + 1) / 2, 0, 1), 0)
        return [ids, [of.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score]

    return map_texts(docs, rows, PREDICTED)


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; those held out teach nothing."""
    model = trained(docs.where(~held_out(F.col("doc_id"))))
    return predicted(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
