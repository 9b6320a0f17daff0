"""Substring dedup by seed and extend.

Seeds: every window of ``length`` words elects its smallest ``gram``-word hash (winnowing), so two equal windows elect
equal anchors, wherever they stand. Anchors that occur once anywhere are dropped by a join on the anchor hash.

Extension: a surviving anchor carries the windows around it that elected it, i.e. its match candidates in both
directions up to ``length`` words. All occurrences of one anchor are extended against each other at once, first by
their whole surroundings (copies fall together before any shuffle of pairs), then, where surroundings differ, window by
window. No pair of occurrences is ever formed, so a passage in a third of all documents costs what its own words cost.
Windows are equal if anchor and window agree in 64 bits each. Overlapping repeated windows are merged into maximal repeated spans per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.textkit import Joined, sliding_argmin, span_hashes, text_chunks, window_hashes, word_spans
from lexispark.session import settle

LENGTH = 35     # words of a repeat, at least
GRAM = 8        # words of an anchor

_ROW, _TEXT = "__repeat_row", "__repeat_text"


def _elected(batch: pa.RecordBatch, length: int, gram: int):
    """Window starts, the anchor each elected, its hash, the window hashes, and where each text's windows begin."""
    joined = Joined(batch.column(1).to_pylist())
    starts, ends, first = word_spans(joined)
    words = span_hashes(joined.codes, starts, ends)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(words))
    windows = at[at + length <= first[1:][text_of]] if len(words) else at
    grams = window_hashes(words, gram)
    if not len(windows):
        return windows, windows, grams[:0], grams[:0], text_of, first
    chosen = sliding_argmin(grams, length - gram + 1)[windows]
    return windows, chosen, grams[chosen], window_hashes(words, length)[windows], text_of, first


def _anchor_hashes(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, _TEXT):
            windows, chosen, hashes, _, _, _ = _elected(batch, length, gram)
            if len(windows):
                new = np.append(True, chosen[1:] != chosen[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64))], ["h"])
    return run


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, _TEXT):
            windows, chosen, hashes, whole, text_of, first = _elected(batch, length, gram)
            if not len(windows):
                continue
            new = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
            text = text_of[windows[new]]
            rows = batch.column(0).to_numpy()[text]
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(windows)).astype(np.int32)), pa.array(whole.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array((windows[new] - first[text]).astype(np.int64)),
                 pa.array(hashes[new].view(np.int64)), lists], ["row", "first", "h", "windows"])
    return run


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows are told apart by key and text, so that repeated rows share one entry and null keys do no harm."""
    return docs.withColumn(_ROW, F.xxhash64(F.col(key).cast("string"), F.col(text))).withColumn(_TEXT, F.col(text))


def repeated_starts(
    docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """Runs ``(row, low, high)`` of word positions at which a window starts that also starts elsewhere."""
    source = _keyed(docs, text, key).select(_ROW, _TEXT)
    # two equal rows of one table are two places, so repeated rows are kept here
    # (key lists are stored before they are joined, so that adaptive execution can split a hot key of the other side)
    shared = settle(
        source.mapInArrow(_anchor_hashes(length, gram), "h long")
        .groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    seeds = settle(
        source.mapInArrow(_anchors(length, gram), "row long, first long, h long, windows array<long>").join(shared, "h"))
    contexts = settle(seeds.groupBy("h", "windows").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min("first").alias("first")))
    whole = seeds.join(contexts.where("n > 1").select("h", "windows"), ["h", "windows"], "left_semi").select(
        "row", F.col("first").alias("low"), (F.col("first") + F.size("windows") - 1).alias("high"))
    unlike = settle(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"))
    each = contexts.join(unlike, "h").select(
        "h", "row", "first", "n", F.posexplode("windows").alias("pos", "w"))
    again = settle(each.groupBy("h", "w").agg(F.sum("n").alias("total")).where("total > 1").select("h", "w"))
    # contexts met more than once are in `whole` already, with all their occurrences
    single = each.where("n = 1").join(again, ["h", "w"], "left_semi").select(
        "row", (F.col("first") + F.col("pos")).alias("low"), (F.col("first") + F.col("pos")).alias("high"))
    return whole.unionByName(single)


def _strike(length: int, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, _TEXT):
            texts, runs = batch.column(_TEXT).to_pylist(), batch.column("__runs").to_pylist()
            kept, counts, removed, spans = [], [], [], []
            for value, found in zip(texts, runs):
                words = (value or "").encode().split()
                counts.append(len(words))
                if not found:
                    kept.append(b" ".join(words).decode())
                    removed.append(0)
                    spans.append([])
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                for run_ in found:
                    edge[run_["low"]] += 1
                    edge[run_["high"] + length] -= 1
                keep = np.cumsum(edge)[:-1] == 0
                kept.append(b" ".join(compress(words, keep.tolist())).decode())
                removed.append(int((~keep).sum()))
                flips = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).astype(np.int8)))
                spans.append(flips.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in fields]
                + [pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                   pa.array(spans, pa.list_(pa.int64()))],
                [*fields, "kept_text", "n_words", "n_removed", "repeat_bounds"])
    return run


def remove_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """All rows and columns of ``docs`` with kept_text, n_words, n_removed and repeat_bounds.

    A word goes if a window of ``length`` words over it occurs anywhere else, its own text included. kept_text has the
    other words joined by one blank; repeat_bounds lists start and end (exclusive) of each maximal repeated span.
    A null or empty text has no words and an empty kept_text; equal rows count as two places; an empty table gives an
    empty table; columns of ``docs`` named like the four results are replaced.
    """
    added = ("kept_text", "n_words", "n_removed", "repeat_bounds")
    base = docs.select(*[c for c in docs.columns if c not in added or c in (text, key)])
    runs = repeated_starts(base, text, key, length, gram).groupBy("row").agg(
        F.collect_list(F.struct("low", "high")).alias("__runs"))
    joined = _keyed(base, text, key).join(runs.withColumnRenamed("row", _ROW), _ROW, "left").drop(_ROW)
    fields = base.columns
    schema = T.StructType([*base.schema.fields, T.StructField("kept_text", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("repeat_bounds", T.ArrayType(T.LongType()))])
    return joined.mapInArrow(_strike(length, fields), schema)
