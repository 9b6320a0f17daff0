"""Toxicity by FTRL-proximal logistic regression over hashed words, word beginnings, word pairs and
skip pairs.

Every coordinate has its own learning rate, and the L1 term keeps a weight at exactly zero until its evidence exceeds
it, so the model that goes to the executors is a short list of buckets. It is fitted on a bounded sample of labelled
texts (``SAMPLE``), in the order of a hash of their keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from lexispark.llm.hashed import distinct, fit, labelled_sample, word_features
from lexispark.llm.textkit import text_chunks

SAMPLE = 8192       # labelled texts used for fitting, at most
BITS = 20           # buckets of the feature space, as a power of two
STEMS = (3, 4, 5, 6, 7)     # beginnings of longer words count as words too: inflected and compound insults share them
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 5.0, 0.5, 4


def learn(rows: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA,
          l1: float = L1, l2: float = L2, passes: int = PASSES) -> list[tuple[int, float]]:
    """(bucket, weight) of all weights that are not zero; bucket -1 is the intercept, which L1 leaves alone.

    A feature is there or not, its count plays no part.
    """
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    shrink = np.full(size + 1, l1)
    shrink[size] = 0.0

    def weight(at: np.ndarray) -> np.ndarray:
        over = np.maximum(np.abs(z[at]) - shrink[at], 0.0)
        return -np.sign(z[at]) * over / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(passes):
        for row, label in zip(rows, labels):
            at = np.append(row, size)
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    at = np.append(np.flatnonzero(np.abs(z[:size]) > l1), size)
    return [(int(b) if b < size else -1, float(w)) for b, w in zip(at, weight(at)) if w != 0.0]


def train(docs: DataFrame, labels: DataFrame, label: Column, key: str = "doc_id", text: str = "text",
          sample: int = SAMPLE, bits: int = BITS) -> list[tuple[int, float]]:
    """Fit on labelled rows (label 0 or 1); without any, the model is empty and every score is one half."""
    return fit(docs, labelled_sample(labels, key, label, sample), key, text, partial(word_features, bits=bits, stems=STEMS), bits,
               partial(learn, bits=bits))


def score(docs: DataFrame, model: list[tuple[int, float]], text: str = "text", threshold: float = 0.3,
          bits: int = BITS) -> DataFrame:
    """All rows and columns of ``docs`` with score (0 to 1) and predicted (1 if score >= threshold).

    A null or empty text gets the score of the intercept alone; columns with these names are replaced.
    """
    base = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    fields = base.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = np.zeros(1 << bits), 0.0
        for bucket, value in shared.value:
            if bucket < 0:
                intercept = value
            else:
                weights[bucket] = value
        for batch in text_chunks(batches, text):
            owner, bucket = word_features(batch.column(text).to_pylist(), bits, stems=STEMS)
            known = weights[bucket] != 0
            owner, bucket, _ = distinct(owner[known], bucket[known], bits)
            total = intercept + np.bincount(owner, weights[bucket], batch.num_rows)
            chance = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in fields], pa.array(chance), pa.array((chance >= threshold).astype(np.int32))],
                [*fields, "score", "predicted"])

    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(run, schema)
