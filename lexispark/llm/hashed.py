"""Hashed text features, and the bounded labelled sample that the linear models are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.textkit import Joined, mix, span_hashes, text_chunks, word_spans

Features = Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]


def word_features(texts: list[str | None], bits: int, skip: bool = True, shape: bool = False,
                  stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every word, word pair, with ``skip`` pair around one word, with ``shape`` word end
    and repetition of a word.

    ``stems`` adds the first so many characters of each word that is longer.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased unless word ends are wanted; buckets are the top ``bits`` bits.
    Sorted by text; a feature is named as often as it occurs.
    """
    joined = Joined(texts, fold_ascii=not shape)
    starts, ends, first = word_spans(joined)
    words = span_hashes(joined.codes, starts, ends)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    owners, hashes = [text], [words]
    for gap in (1, 2) if skip else (1,):
        if len(words) > gap:
            same = text[gap:] == text[:-gap]
            owners.append(text[gap:][same])
            hashes.append(mix(words[:-gap] * np.uint64(3) + words[gap:], gap)[same])
    if shape and len(words):
        owners.append(text)
        hashes.append(mix(span_hashes(joined.codes, np.maximum(starts, ends - 2), ends), 7))
        again = text[1:][(words[1:] == words[:-1]) & (text[1:] == text[:-1])]       # a word said twice, whichever
        owners.append(again)
        hashes.append(mix(np.zeros(len(again), np.uint64), 13))
    for size in stems:
        longer = ends - starts > size
        owners.append(text[longer])
        hashes.append(mix(span_hashes(joined.codes, starts[longer], starts[longer] + size), 11))
    owner, hashed = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return owner[order], (hashed[order] >> np.uint64(64 - bits)).astype(np.int64)


def distinct(owner: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (text, bucket) once, sorted by text, and how often it was named."""
    pairs, counts = np.unique((owner.astype(np.int64) << bits) | bucket, return_counts=True)
    return pairs >> bits, pairs & ((1 << bits) - 1), counts


def labelled_sample(labels: DataFrame, key: str, label: Column, limit: int) -> DataFrame:
    """(key, label) of at most ``limit`` labelled rows: those whose keys come first in the order of a hash.

    A key with several labels keeps the smallest, so a repeated label row changes nothing; null keys and labels are out.
    """
    return (
        labels.select(F.col(key).alias("__key"), label.alias("__label"))
        .where("__key is not null and __label is not null")
        .groupBy("__key").agg(F.min("__label").alias("__label"))
        .orderBy(F.xxhash64(F.col("__key").cast("string")), "__key").limit(limit)
    )


def fit(docs: DataFrame, sample: DataFrame, key: str, text: str, features: Features, bits: int,
        learn: Callable[[list[np.ndarray], list[np.ndarray], np.ndarray], list[tuple[int, float]]]) -> list[tuple[int, float]]:
    """Weights learned in one task from the sampled texts; the sample is bounded, so its broadcast and its task are too.

    ``learn`` gets the distinct buckets of each text, their counts, and the labels, in the order of a hash of the keys.
    """
    def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            owner, *found = distinct(*features(batch.column(2).to_pylist()), bits)
            bounds = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(values.astype(np.int32))) for values in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["turn", "label", "buckets", "counts"])

    def to_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, labels, rows, counts = [], [], [], []
        for batch in batches:
            turns += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            for held, column in ((rows, batch.column(2)), (counts, batch.column(3))):
                values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
                held += [values[a:b].copy() for a, b in zip(offsets[:-1], offsets[1:])]
        if not rows:
            return
        order = sorted(range(len(rows)), key=lambda i: (turns[i], labels[i], len(rows[i])))
        weights = learn([rows[i] for i in order], [counts[i] for i in order], np.array([labels[i] for i in order], np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in weights], pa.int64()), pa.array([w for _, w in weights], pa.float64())],
            ["bucket", "weight"])

    chosen = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(sample), "__key").select(
        F.xxhash64(F.col("__key").cast("string")).alias("turn"), F.col("__label").cast("long").alias("label"), "text")
    # the features of the sample move to one task by a shuffle; the scan before it stays spread over all tasks
    found = chosen.mapInArrow(to_features, "turn long, label long, buckets array<int>, counts array<int>").repartition(1).mapInArrow(
        to_weights, "bucket long, weight double").collect()
    return [(r.bucket, r.weight) for r in found]
