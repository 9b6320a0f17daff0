"""Quality by ordinal regression: one weight vector over hashed text, ordered thresholds between grades.

P(grade >= k) = sigmoid(w . x - t_k) with t_1 < t_2 < ...; all grades share w, so a text's grades are ordered by
construction. x has one entry per distinct word, word pair and word end of the text: the square root of its share of
all of them, so x has unit length and what fills a text weighs more than what it has once. Thresholds
are kept ordered by learning the logarithm of their gaps. It is fitted on a bounded sample (``SAMPLE``) by adaptive
gradient steps in the order of a hash of the keys.
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
BITS = 18           # buckets of the feature space, as a power of two
PASSES, RATE, DECAY = 6, 0.2, 1e-6


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _thresholds(first: float, gaps: np.ndarray) -> np.ndarray:
    return first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def _values(counts: np.ndarray, total: np.ndarray | float) -> np.ndarray:
    return np.sqrt(counts / np.maximum(total, 1))


def learn(rows: list[np.ndarray], counts: list[np.ndarray], grades: np.ndarray, top: int, bits: int = BITS, passes: int = PASSES,
          rate: float = RATE) -> list[tuple[int, float]]:
    """(bucket, weight), and the thresholds as buckets -1, -2, ..."""
    w, seen = np.zeros(1 << bits), np.full(1 << bits, 1e-8)
    # start from the observed shares of grades
    tail = np.array([np.clip((grades >= k).mean(), 0.01, 0.99) for k in range(1, top + 1)])
    start = np.maximum.accumulate(-np.log(tail / (1 - tail)) + 1e-2 * np.arange(top))
    first, gaps = float(start[0]), np.log(np.maximum(np.diff(start), 1e-2))
    first_seen, gaps_seen = 1e-8, np.full(top - 1, 1e-8)
    for _ in range(passes):
        for row, count, grade in zip(rows, counts, grades):
            value = _values(count, count.sum())
            t = _thresholds(first, gaps)
            s = w[row] @ value
            upper = 1.0 if grade == 0 else _sigmoid(s - t[grade - 1])
            lower = 0.0 if grade == top else _sigmoid(s - t[grade])
            chance = max(upper - lower, 1e-9)
            du, dl = upper * (1 - upper), lower * (1 - lower)
            ds = -(du - dl) / chance                          # of the loss by s
            if len(row):
                g = ds * value + DECAY * w[row]
                seen[row] += g * g
                w[row] -= rate * g / np.sqrt(seen[row])
            dt = np.zeros(top)                                # of the loss by each threshold
            if grade > 0:
                dt[grade - 1] += du / chance
            if grade < top:
                dt[grade] -= dl / chance
            g = dt.sum()
            first_seen += g * g
            first -= 0.1 * rate * g / np.sqrt(first_seen)
            if top > 1:
                g = np.cumsum(dt[::-1])[::-1][1:] * np.exp(gaps)
                gaps_seen += g * g
                gaps -= 0.1 * rate * g / np.sqrt(gaps_seen)
    at = np.flatnonzero(np.abs(w) > 1e-6)
    return [(int(b), float(w[b])) for b in at] + [(-1 - k, float(t)) for k, t in enumerate(_thresholds(first, gaps))]


_features = partial(word_features, bits=BITS, skip=False, shape=True)


def train(docs: DataFrame, labels: DataFrame, grade: Column, top: int, key: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> list[tuple[int, float]]:
    """Fit on rows graded 0 to ``top``; without any, the model is empty and every tail probability is one half."""
    return fit(docs, labelled_sample(labels, key, grade, sample), key, text, _features, BITS, partial(learn, top=top))


def grade(docs: DataFrame, model: list[tuple[int, float]], top: int, text: str = "text", select_from: int = 1,
          least: float = 0.5) -> DataFrame:
    """All rows and columns of ``docs`` with tail (P(grade >= k) for k = 1 .. top), expected_grade and kept.

    kept is P(grade >= select_from) >= least. A null or empty text has no features and is graded by the thresholds
    alone; columns with these names are replaced.
    """
    added = ("tail", "expected_grade", "kept")
    base = docs.select(*[c for c in docs.columns if c not in added])
    fields = base.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = np.zeros(1 << BITS), np.zeros(top)
        for bucket, value in shared.value:
            if bucket < 0:
                t[-1 - bucket] = value
            else:
                w[bucket] = value
        for batch in text_chunks(batches, text):
            owner, bucket, count = distinct(*_features(batch.column(text).to_pylist()), BITS)
            total = np.bincount(owner, count, batch.num_rows)
            s = np.bincount(owner, w[bucket] * _values(count, total[owner]), batch.num_rows)
            tail = _sigmoid(s[:, None] - t[None, :])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in fields],
                 pa.ListArray.from_arrays(pa.array((np.arange(batch.num_rows + 1) * top).astype(np.int32)),
                                          pa.array(tail.ravel())),
                 pa.array(tail.sum(axis=1)), pa.array(tail[:, select_from - 1] >= least)], [*fields, *added])

    schema = T.StructType([*base.schema.fields, T.StructField("tail", T.ArrayType(T.DoubleType())),
                           T.StructField("expected_grade", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return base.mapInArrow(run, schema)
