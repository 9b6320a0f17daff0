"""What each of several filters removes, in every order in which they could run, from one count per failure mask.

Orders are numbered in lexicographic order (Lehmer rank), so all orders that begin alike are one interval of ranks. A
document whose failed filters are a mask leaves at step s of exactly the orders whose first s - 1 filters lie outside
the mask and whose s-th lies inside: a set of such intervals. Counts per mask are added where an interval begins,
subtracted where it ends, and a prefix sum over the ranks gives the documents removed at each step of each order.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.session import settle

SEPARATORS = r"[\x20\x09-\x0D]+"
MOST = 7        # filters at most: orders are 5,040 then


def intervals(count: int) -> list[tuple[int, int, int, int, int]]:
    """(mask, step, filter, first rank, rank behind the last) of every interval in which a mask leaves at a step."""
    found = []
    for step in range(1, count + 1):
        width = factorial(count - step)
        # prefixes in lexicographic order tile the ranks
        for turn, prefix in enumerate(permutations(range(count), step)):
            before = sum(1 << f for f in prefix[:-1])
            for mask in range(1 << count):
                if not mask & before and mask >> prefix[-1] & 1:
                    found.append((mask, step, prefix[-1], turn * width, (turn + 1) * width))
    return found


def text_failures(text: Column) -> list[Column]:
    """Failure of the four rules that a text decides alone; null counts as empty.

    Under 100 words; under 80 % distinct words; over 10 % of A-Z; any of #$%&*|.
    """
    plain = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(plain, SEPARATORS), "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    return [
        counts["n"] < 100, 100 * counts["d"] < 80 * counts["n"],
        100 * F.regexp_count(plain, F.lit("[A-Z]")) > 10 * F.length(plain), plain.rlike(r"[#$%&*|]")]


def mask_of(failures: Sequence[Column], first: int = 0) -> Column:
    mask = F.lit(0)
    for i, failed in enumerate(failures):
        mask = mask + F.when(failed, 1 << (first + i)).otherwise(0)
    return mask


def document_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and failure mask of the five rules; the fifth is a repeated text.

    A text is a repeat if a smaller key has the same one; keys that tie for the smallest, and null keys, are none. A
    document is good or toxic if any of its label rows says so. Null parts are the empty string.

    Texts leave the scan as digests. Equal texts are counted per task before they meet, so a text that a third of all
    documents share is a few rows; the smallest key of a text is looked up among these counts, not among documents.
    """
    base = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
        mask_of(text_failures(F.col(text))).alias("mask"))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = base.join(marks, "key", "left").withColumns({
        "good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    group = ["digest", "mask", "part", "good", "toxic"]
    # rows of one key are counted first, so that the smallest key of a group comes with its number of rows
    keyed = marked.groupBy("key", *group).agg(F.count(F.lit(1)).alias("m"))
    groups = settle(keyed.groupBy(*group).agg(
        F.sum("m").alias("n"), F.min(F.when(F.col("key").isNotNull(), F.struct("key", "m"))).alias("least"),
        F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("m"))), F.lit(0)).alias("without")))
    smallest = groups.groupBy("digest").agg(F.min("least.key").alias("smallest"))
    first = F.coalesce(F.when(F.col("least.key") == F.col("smallest"), F.col("least.m")), F.lit(0)) + F.col("without")
    split = groups.join(smallest, "digest").select("mask", "part", "good", "toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("again"), first.alias("n")),
        F.struct(F.lit(16).alias("again"), (F.col("n") - first).alias("n")))).alias("e"))
    n = F.col("e.n")
    return split.groupBy("part", (F.col("mask") + F.col("e.again")).alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def interaction_audit(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``counts`` has (part, mask, n, good, toxic), one row per part and mask or several that add up; bit i of the mask
    says that filter ``names[i]`` fails. One row per part, order and step, zeros included. removed: documents that leave
    here; kept: those left after; redundant: those that fail this filter and left earlier; unique_fails: those that fail
    no other; good_lost, toxic_lost: parts of removed; shapley: the filter's removed, summed over all orders.
    Null counts are 0, a null part is the empty string; a part without documents does not appear, so an empty table gives none.
    """
    if not 1 <= len(names) <= MOST:
        raise ValueError(f"1 to {MOST} filters")
    spark, count = counts.sparkSession, len(names)
    orders = [("".join(names[f] for f in order), rank, list(order)) for rank, order in enumerate(permutations(range(count)))]
    zero = F.lit(0).cast("long")
    per_mask = counts.groupBy(F.coalesce("part", F.lit("")).alias("part"), F.col("mask").cast("int").alias("mask")).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("n", "good", "toxic")])

    # sizes of both tables follow from the number of filters alone
    spread = F.broadcast(spark.createDataFrame(intervals(count), "mask int, step int, filter int, low int, high int"))
    ranks = spark.createDataFrame(orders, "filter_order string, rank int, filters array<int>")
    ends = F.explode(F.array(F.struct(F.col("low").alias("rank"), F.lit(1).alias("sign")),
                             F.struct(F.col("high").alias("rank"), F.lit(-1).alias("sign")))).alias("e")
    moved = per_mask.join(spread, "mask").select("part", "step", "n", "good", "toxic", ends).groupBy(
        "part", "step", F.col("e.rank").alias("rank")).agg(
        *[F.sum(F.col(c) * F.col("e.sign")).alias(c) for c in ("n", "good", "toxic")])

    own = [F.struct(
        F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << f)) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("mask") == 1 << f, F.col("n")).otherwise(0)).alias("alone")) for f in range(count)]
    parts = per_mask.groupBy("part").agg(F.sum("n").alias("total"), F.array(*own).alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(factorial(count) - 1))).alias("rank")
    grid = parts.select("*", every).join(F.broadcast(ranks), "rank").select(
        "part", "total", "own", "rank", "filter_order", F.posexplode("filters").alias("step", "filter")).withColumn(
        "step", F.col("step") + 1)
    by_rank = Window.partitionBy("part", "step").orderBy("rank")       # one row per order
    summed = grid.join(moved, ["part", "step", "rank"], "left").select(
        "part", "total", "rank", "filter_order", "step", "filter", F.col("own")[F.col("filter")].alias("own"),
        *[F.sum(F.coalesce(c, zero)).over(by_rank).alias(into)
          for c, into in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))])
    along = Window.partitionBy("part", "rank").orderBy("step")
    whole = Window.partitionBy("part", "filter")
    letters = F.array(*[F.lit(n) for n in names])
    return summed.select(
        "part", "filter_order", "step", letters[F.col("filter")].alias("filter"),
        (F.col("total") - F.sum("removed").over(along)).alias("kept"), "removed",
        (F.col("own.fails") - F.col("removed")).alias("redundant"),      # who fails it and is still there, leaves here
        F.col("own.alone").alias("unique_fails"), "good_lost", "toxic_lost",
        F.sum("removed").over(whole).alias("shapley"))
