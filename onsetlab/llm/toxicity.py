"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the buckets of its words, word pairs and pairs with one word between,
each counted once. Training follows McMahan et al. (2013): each coordinate has its own learning
rate, and L1 keeps most weights at exactly zero, so the model is a short list of (bucket, weight).

The learner sees a bounded sample: at most ``sample_rows`` labelled rows (a documented parameter),
the first in a seeded order; they are the only data that one task trains on. Scoring covers every
row and whole texts, on the executors, with the sparse weights sent along (at most 2**bits of them).

Nulls, ties, odd rows: a null or empty text has no features and gets the bias's score; labels that
are null or neither 0 nor 1 are skipped; repeated label rows are repeated examples; a null doc_id has
no label and counts as held out, as the checksum of no text is 0; every input row is one result row.
Without training rows all documents score 0.1. Of ``documents`` only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onsetlab.llm.text import per_row, per_text

BITS = 20
SAMPLE_ROWS = 1 << 14
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
FOLDS = 5
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 15


class _Hashes(dict):
    """Word to hash; forgets everything when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = crc32(word.encode())
        return value


_hashes = _Hashes()
_words = re.compile(r"\w+").findall


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Buckets of the text's words, bigrams and skip-grams, with repeats."""
    words = _words(text.lower()) if text else ()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    mixed = [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        if len(h) > gap:
            mixed.append((h[:-gap] * np.uint64(0xFF51AFD7ED558CCD) + h[gap:]) * np.uint64(odd))
    return (np.concatenate(mixed) >> np.uint64(64 - bits)).astype(np.int64)


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(max(x, -35.0), 35.0)))


def ftrl(rows: list[np.ndarray], labels: list[int], bits: int, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Train on sets of buckets; the non-zero (bucket, weight). The last bucket, 2**bits, is the bias."""
    size = 1 << bits
    # A gradient is at most 1, so a bucket in this few rows never passes L1: leaving it out changes no weight.
    seen = np.bincount(np.concatenate([*rows, [size]]), minlength=size + 1)
    rows = [at[seen[at] * epochs > L1] for at in rows]
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        some = z[at]
        w, used = np.zeros(len(at)), np.abs(some) > L1
        some = some[used]
        w[used] = -(some - np.sign(some) * L1) / ((BETA + np.sqrt(n[at[used]])) / ALPHA + L2)
        return w

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            g = _sigmoid(w.sum()) - labels[i]
            before, used = n[at], np.flatnonzero(w)
            step = np.full(len(at), g)
            step[used] -= (np.sqrt(before[used] + g * g) - np.sqrt(before[used])) / ALPHA * w[used]
            z[at] += step
            n[at] = before + g * g
    w = weights(np.arange(size + 1))
    used = np.flatnonzero(w)
    return used, w[used]


def held_out(doc_id: Column) -> Column:
    """The fold that no training row comes from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> DataFrame:
    """doc_id, label and text of at most ``sample_rows`` labelled documents outside the held-out fold.

    A label that repeats counts once; of documents that share an id the least text is taken.
    """
    sample = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "label").limit(sample_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows rows
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample_rows: int = SAMPLE_ROWS, seed: int = 5):
    """The sparse weights (buckets, values), learnt from ``training_rows``."""
    rows = training_rows(docs, labels, sample_rows, seed)

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = [np.append(np.unique(features(t, bits)), 1 << bits).astype(np.int32) for t in frame["text"]]
            yield pd.DataFrame({"part": 0, "doc_id": frame["doc_id"], "label": frame["label"], "at": at})

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(size=frame["at"].map(len)).sort_values(["doc_id", "label", "size"], kind="stable")
        at, w = ftrl(list(frame["at"]), frame["label"].tolist(), bits, seed=seed)
        pa.default_memory_pool().release_unused()
        return pd.DataFrame({"bucket": at, "weight": w})

    model = (
        rows.mapInPandas(extract, "part int, doc_id long, label int, at array<int>")
        .groupBy("part").applyInPandas(fit, "bucket long, weight double").toPandas()
    )
    if model.empty:  # nothing to learn from
        return np.array([1 << bits]), np.array([np.log(0.1 / 0.9)])
    model = model.sort_values("bucket")
    return model["bucket"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list | None = None, bits: int = BITS, with_text: bool = False) -> DataFrame:
    """The ``keep`` columns (doc_id, if none are named) and the score of every document."""
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        dense = np.zeros((1 << bits) + 1)
        dense[weights.value[0]] = weights.value[1]

        def one(text: str | None) -> float:
            buckets = features(text, bits)
            used = np.unique(buckets[dense[buckets] != 0])
            return float(_sigmoid(dense[-1] + dense[used].sum()))

        return lambda texts: [[one(t) for t in texts]]

    return per_text(docs, keep or ["doc_id"], make, "score double", with_text=with_text)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score below ``threshold``."""
    model = train(docs, labels)
    scored, columns = per_row(docs, lambda d, keep, with_text: score(d, model, keep, with_text=with_text))
    return scored.filter(F.col("score") < threshold).select(*columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
