"""Hard-negative mining with exact integer scores from a residue-number-system matrix product.

Vector components become whole numbers. Their inner products are computed modulo several small primes: residues are so
small that a float32 matrix product of a few hundred columns is exact, and the products modulo all primes give the
signed score by Chinese remaindering. How many primes are needed follows from the longest vector, by Cauchy-Schwarz.

Anchors are compared with all rows on a grid: rows and anchors are dealt into blocks of bounded size, each cell of the
grid is one task's group, and only the best few rows per anchor leave a cell. A first round finds the positives, a second
one the negatives inside the window that each positive's score opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.session import settle

BLOCK = 1 << 19         # components of a block, at most; a row block and an anchor block meet in a cell
TILE = 1 << 20          # scores computed together inside a cell
LARGEST = 511           # primes lie below; half of one, squared, times ``INNER`` columns stays below 2**24
INNER = 256
LIMIT = 1 << 61         # scores must lie below, so that remaindering fits 64 bits
_NONE = np.iinfo(np.int64).min


def primes_for(bound: int, largest: int = LARGEST) -> list[int]:
    """Primes from ``largest`` downwards whose product exceeds twice ``bound``."""
    found: list[int] = []
    for n in range(largest, 2, -1):
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            found.append(n)
            if prod(found) > 2 * bound + 1:
                return found
    raise ValueError(f"no set of primes for scores up to {bound}")


def _residues(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues between -prime/2 and prime/2."""
    left = values % prime
    return np.where(left > prime // 2, left - prime, left).astype(np.float32)


class Residues:
    """Rows of whole numbers as one float32 matrix of residues per prime."""

    def __init__(self, values: np.ndarray, primes: list[int]) -> None:
        self.primes = primes
        self.parts = [_residues(values, p) for p in primes]

    def scores(self, other: "Residues", low: int, high: int) -> np.ndarray:
        """Exact inner products of rows ``low`` to ``high`` of this matrix with all rows of the other, as int64."""
        total, modulus = None, 1
        for prime, mine, theirs in zip(self.primes, self.parts, other.parts):
            left = np.zeros((high - low, len(theirs)), np.int64)
            for at in range(0, mine.shape[1], INNER):
                left += (mine[low:high, at:at + INNER] @ theirs[:, at:at + INNER].T).astype(np.int64)
            left %= prime
            if total is None:
                total = left
            else:       # the mixed-radix digit of this prime
                total += modulus * (((left - total) % prime) * pow(modulus, -1, prime) % prime)
            modulus *= prime
        total[total > modulus // 2] -= modulus
        return total


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists as rows of a matrix, short ones filled up with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], column.type)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    out = np.zeros((len(lists), dims), np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    flat = lists.values.to_numpy()[offsets[0]:offsets[-1]]
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def _best(scores: np.ndarray, allowed: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(line, column, score) of the best, second best ... allowed entry of each line; the first of equals wins."""
    left = np.where(allowed, scores, _NONE)
    lines = np.arange(len(left))
    for _ in range(count):
        if not len(lines) or not left.shape[1]:
            return
        at = left[lines].argmax(1) if len(lines) < len(left) else left.argmax(1)
        value = left[lines, at]
        lines, at, value = lines[value > _NONE], at[value > _NONE], value[value > _NONE]
        yield lines, at, value
        left[lines, at] = _NONE


def _cell(dims: int, primes: list[int], tile: int, work):
    """Runs ``work`` over the tiles of one cell: all its rows, in the order of their ids, against some of its anchors."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            rows = rows.sort_by("vec_id")
            theirs = Residues(_matrix(rows["whole"], dims), primes)
            mine = Residues(_matrix(anchors["whole"], dims), primes)
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            step = max(1, tile // rows.num_rows)
            for low in range(0, anchors.num_rows, step):
                part = anchors.slice(low, step)
                out += work(mine.scores(theirs, low, low + part.num_rows), ids, labels, part)
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], ["anchor_id", "positive_id", "other_id", "score"])
    return run


def _find_positives(count: int):
    def work(scores, ids, labels, anchors):
        own, label = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        allowed = (labels[None, :] == label[:, None]) & (ids[None, :] != own[:, None])
        for line, at, value in _best(scores, allowed, count):
            yield own[line], ids[at], ids[at], value
    return work


def _find_negatives(count: int, positives: int, low_percent: int, high_percent: int):
    def work(scores, ids, labels, anchors):
        own, label = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        given = anchors["positives"].to_pylist()
        other = labels[None, :] != label[:, None]
        for turn in range(positives):
            lines = np.array([i for i, p in enumerate(given) if len(p) > turn], np.int64)
            if not len(lines):
                return
            chosen = [given[i][turn] for i in lines]
            high = np.array([high_percent * p["score"] // 100 for p in chosen], np.int64)
            low = np.array([-(-low_percent * p["score"] // 100) for p in chosen], np.int64)
            names = np.array([p["id"] for p in chosen], np.int64)
            inside = other[lines] & (scores[lines] >= low[:, None]) & (scores[lines] <= high[:, None])
            for line, at, value in _best(scores[lines], inside, count):
                yield own[lines[line]], names[line], ids[at], value
    return work


def whole_vectors(rows: DataFrame, key: str, vector: str, label: Column, scale: int) -> tuple[DataFrame, int, int]:
    """Stored (vec_id, label, whole) of the rows that take part, the longest length, and a bound of all scores."""
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    taking = rows.select(
        F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    wide = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(F.abs(x) * scale + 1, F.lit(2.0)))
    dims, longest = taking.agg(F.max(F.size("v")), F.max(wide)).first()
    bound = int(longest or 0) + 1
    bound += bound >> 20        # rounding of the sum above
    if bound >= LIMIT:
        raise ValueError(f"scores up to {bound} do not fit: scale the vectors down")
    whole = F.transform("v", lambda x: F.floor(x * scale))
    stored = taking.select("vec_id", "label", whole.alias("whole"))
    if not taking.groupBy("vec_id").count().where("count > 1").isEmpty():
        stored = stored.groupBy("vec_id").agg(F.min(F.struct("label", "whole")).alias("s")).select("vec_id", "s.*")
    return settle(stored), dims or 0, bound


def hard_negatives(rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding",
                   label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 3,
                   low_percent: int = 50, high_percent: int = 95, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Components become floor(``scale`` * x). An anchor's positives are the first ``positives`` other rows of its label by
    (score descending, id); its negatives, for each positive, the first ``negatives`` rows of other labels whose score
    is between ``low_percent`` and ``high_percent`` of the positive's. ``is_anchor`` is a condition on ``vec_id``.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part. Vectors of unequal
    length count as filled up with zeros, empty ones score 0. Repeated rows count once; of different rows with one id
    the first by label and vector takes part. Equal scores go by the smaller id. An anchor without positives or
    negatives, and an empty table, give no rows. Extra columns are ignored. Scores of 2**61 and more are refused.
    """
    stored, dims, bound = whole_vectors(rows, key, vector, F.col("label") if label is None else label, scale)
    primes = primes_for(bound)
    per_block = max(1, block // max(dims, 1))
    anchors = settle(stored.where(is_anchor))
    n_rows, n_anchors = stored.count(), anchors.count()
    down, across = max(1, ceil(n_rows / per_block)), max(1, ceil(n_anchors / per_block))

    def place(salt: int, blocks: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(blocks))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    def grid(asking: DataFrame, work) -> DataFrame:
        left = stored.select("*", place(1, down).alias("i")).select("*", every(across).alias("j"))
        right = asking.select("*", place(2, across).alias("j")).select("*", every(down).alias("i"))
        return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(
            _cell(dims, primes, tile, work), "anchor_id long, positive_id long, other_id long, score long")

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    found = settle(
        grid(anchors, _find_positives(positives)).withColumn("turn", F.row_number().over(first))
        .where(F.col("turn") <= positives).select("anchor_id", F.col("other_id").alias("positive_id"), "score"))
    # at most ``positives`` rows per anchor
    listed = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score"))).alias("positives"))
    asking = settle(anchors.join(listed, "vec_id"))
    nearest = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other_id")
    return (
        grid(asking, _find_negatives(negatives, positives, low_percent, high_percent))
        .withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"),
                F.col("score").alias("negative_score"))
        .join(found.withColumnRenamed("score", "positive_score"), ["anchor_id", "positive_id"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
