"""Toxicity (operator 2): classifier chains over hashed character runs.

Categories are predicted one after the other by linear models; each model also sees
the log-odds of the categories before it. For training these come out of fold: every
document's are predicted by models that have not seen it. The categories are those
that the label table has: low quality (``quality`` 0), then toxic.

Features are byte runs of the lower-cased words with one blank between, hashed; the
chain keeps those whose document frequencies tell a category from the rest best, and
takes their rates per word, with four figures of a text's looks beside them. What a
fold is predicted by was chosen and fitted without it, and equal texts share a fold.
Training uses at most SAMPLE labelled documents, the ones with the least hash of their
id; scoring reads every text whole. A category's
threshold is the one with the best F1 out of fold, at least the log-odds of its rate.

Defined results: a null or empty text has no features; labels that are null or belong
to no document are ignored, of several labels of a document the largest counts; a
category with one class only is predicted at its rate, and nothing is rejected where
nothing is labelled toxic; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_filter
from .licenses import STREAM

#: Categories in the order of the chain, as SQL over the label table.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
#: Labelled documents that training takes at most, features kept of each category, folds.
SAMPLE, FEATURES, FOLDS = 2500, 600, 5
#: Bytes of a run, and bits of its hash.
RUNS, HASH_BITS = (4, 6, 8), 18
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Text bytes hashed at once, and texts scored at once: each byte takes some 40 bytes, each text a cell a feature.
PART, ROWS = 1 << 17, 512


def stream(text: str) -> bytes:
    """Words of the lower-cased text with one blank around each."""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(STREAM).split()) + b" "


def hashed(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each run length the hashes of the runs that begin at data's bytes but the last eight."""
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 8, 8), (1, 1)).copy().view("<u8").ravel()
    for size in RUNS:
        mask = np.uint64((1 << 8 * size) - 1)
        yield size, ((words & mask) + np.uint64(size << 56)) * MIX >> np.uint64(64 - HASH_BITS)


def found(texts: list[str], column: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, count) of the kept features, and the texts' words.

    ``column`` maps a hash to a feature's number, -1 where none is kept.
    """
    streams = [stream(t) for t in texts]
    lengths = np.array([len(s) for s in streams])
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(streams) + bytes(8), np.uint8)
    keys = []
    for a in range(0, len(data) - 8, PART):
        part = data[a : a + PART + 8]
        for size, h in hashed(part):
            at = column[h.astype(np.int64)]
            hit = np.flatnonzero(at >= 0)
            text = np.searchsorted(starts, hit + a, side="right") - 1
            inside = hit + a + size <= starts[text] + lengths[text]
            keys.append(text[inside] * columns + at[hit[inside]])
    key, count = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
    words = np.array([max(0, s.count(b" ") - 1) if len(s) > 2 else 0 for s in streams])
    return key // columns, key % columns, count, words


def rates(texts: list[str], chosen: np.ndarray) -> np.ndarray:
    """One row a text: each chosen feature's occurrences per hundred words, one at most."""
    column = np.full(1 << HASH_BITS, -1, np.int64)
    column[chosen] = np.arange(len(chosen))
    out = np.zeros((len(texts), len(chosen) + len(SHAPE)), np.float32)
    text, at, count, words = found(texts, column, max(1, len(chosen)))
    out[text, at] = np.minimum(1, 100 * count / np.maximum(1, words[text]))
    out[:, len(chosen) :] = np.array([shape(t) for t in texts], np.float32).reshape(len(texts), len(SHAPE))
    return out


#: What a text looks like, whatever its words.
SHAPE = ("marks", "capitals", "repetition", "length")
KIND = np.zeros(256, np.int64)
KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
KIND[65:91] = 2


def shape(text: str) -> tuple[float, float, float, float]:
    """Shares of marks and capitals, of words that repeat earlier ones, and the length, all about 0 to 1."""
    raw = text.encode("utf-8", "surrogatepass")
    _, marks, capitals = np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=3) / max(1, len(raw))
    words = raw.split()
    return 4 * marks, capitals, 1 - len(set(words)) / max(1, len(words)), np.log1p(len(words)) / 10


class Linear(NamedTuple):
    weights: np.ndarray
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> Linear:
    """Logistic regression by Adam over all rows; one class only gives its rate."""
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Linear(w, b)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        d = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / len(y)
        g = np.append(x.T @ d + penalty * w, d.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return Linear(w, b)


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The log-odds, halfway between two documents', with the best F1; infinite without positives."""
    if not y.any():
        return float("inf")
    order = np.argsort(-logits)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    low = logits[order[k + 1]] if k + 1 < len(y) else logits[order[k]] - 1
    return float((logits[order[k]] + low) / 2)


class Chain(NamedTuple):
    names: tuple[str, ...]
    chosen: np.ndarray
    models: tuple[Linear, ...]
    thresholds: tuple[float, ...]

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row a text, one column a category."""
        parts = [texts[a : a + ROWS] for a in range(0, max(1, len(texts)), ROWS)]
        return np.concatenate([chained(self.models, rates(p, self.chosen)) for p in parts])


def chained(models: tuple[Linear, ...], x: np.ndarray) -> np.ndarray:
    for model in models:
        x = np.column_stack([x, np.clip(model.logits(x), -10, 10)])
    return x[:, x.shape[1] - len(models) :].copy()  # else all of x stays


def train(texts: list[str], labels: np.ndarray, names: tuple[str, ...]) -> Chain:
    """Fit a chain; ``labels`` has one column a category, in the order of ``names``."""
    fold = np.array([zlib.crc32(stream(t)) % FOLDS for t in texts], np.int64)
    held = frequencies(texts, labels, fold)
    chosen = select(held.sum(0), counted(labels))
    # Each fold's features are chosen from the others alone, as its models are fitted.
    apart = [rates(texts, select(held.sum(0) - held[f], counted(labels[fold != f]))) for f in range(FOLDS)]
    feats, models, thresholds = rates(texts, chosen), [], []
    for k in range(len(names)):
        y = labels[:, k]
        # Out of fold, so that later models see what earlier ones say of unseen texts.
        out = np.zeros(len(texts), np.float32)
        for f in range(FOLDS):
            out[fold == f] = fitted(apart[f][fold != f], y[fold != f]).logits(apart[f][fold == f])
        models.append(fitted(feats, y))
        # A fold's models are weaker where labels are few; no threshold lies below the category's rate.
        floor = np.log(y.mean() / (1 - y.mean())) if 0 < y.sum() < len(y) else -np.inf
        thresholds.append(float(max(best_threshold(out, y), floor)))
        feats, *apart = (np.column_stack([x, np.clip(out, -10, 10)]) for x in (feats, *apart))
    return Chain(names, chosen, tuple(models), tuple(thresholds))


def frequencies(texts: list[str], labels: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """How many texts of each fold, category and class hold each hash."""
    every = np.arange(1 << HASH_BITS)
    held = np.zeros((FOLDS, labels.shape[1], 2, 1 << HASH_BITS), np.float32)
    for i, text in enumerate(texts):
        _, at, _, _ = found([text], every, 1 << HASH_BITS)
        for k, y in enumerate(labels[i]):
            held[fold[i], k, int(y), at] += 1
    return held


def counted(labels: np.ndarray) -> np.ndarray:
    """Texts of each category and class."""
    return np.stack([(labels == c).sum(0) for c in (0, 1)], axis=1).astype(np.float32)


def select(held: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes whose document frequencies differ most between a category and the rest."""
    chosen = np.zeros(0, np.int64)
    for k in range(len(held)):
        n = sizes[k][:, None]
        if not n.all():
            continue
        p, all_p = held[k] / n, held[k].sum(0) / n.sum()
        z = np.abs(p[1] - p[0]) / np.sqrt((all_p * (1 - all_p) + 1e-4) * (1 / n[0] + 1 / n[1]))
        top = np.argsort(-z, kind="stable")[:FEATURES]
        chosen = np.union1d(chosen, top[z[top] > 3])
    return chosen


def sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """At most ``size`` labelled documents: text and one 0/1 column a category."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    of = known.groupBy("doc_id").agg(*(F.max(F.expr(sql)).cast("int").alias(f"is_{name}") for name, sql in CATEGORIES.items()))
    few = of.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # Of several texts of one document the least counts, so that training never varies.
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    return own.groupBy("doc_id", *few.columns[1:]).agg(F.min("text").alias("text")).orderBy("doc_id")


def trained(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Chain:
    rows = sample(docs, labels, size).toPandas()
    y = rows[[f"is_{n}" for n in CATEGORIES]].to_numpy(np.float32).reshape(-1, len(CATEGORIES))
    return train([t or "" for t in rows["text"]], y, tuple(CATEGORIES))


def toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, low_quality, toxic) of every document."""
    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in chain.names) + ", " + ", ".join(f"{n} boolean" for n in chain.names)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def rows(ids, texts):
        z = shared.value.logits(texts).astype(np.float64)
        return [ids, *(1 / (1 + np.exp(-z.T))), *(z > np.array(shared.value.thresholds)).T]

    return map_texts(docs, rows, schema)


def accepted(docs: DataFrame, chain: Chain) -> DataFrame:
    """The documents, all columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = chain.names.index("toxic")

    def clean(parts: Iterator[list[str]]) -> Iterator[np.ndarray]:
        for texts in parts:
            yield shared.value.logits(texts)[:, at] <= shared.value.thresholds[at]

    return docs.where(text_filter(clean, __name__)(F.col("text").cast("string")))
