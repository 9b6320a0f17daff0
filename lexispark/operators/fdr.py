"""False-discovery control without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.session import settle


def _needed_rank(p, m, q: float):
    """Smallest rank r with p <= (r/m) q, corrected for rounding so it agrees with that comparison."""
    guess = F.ceil(p * m / F.lit(q)).cast("long")
    limit = lambda r: (r / m) * F.lit(q)
    guess = F.when((guess > 1) & (p <= limit(guess - 1)), guess - 1).when(p > limit(guess), guess + 1).otherwise(guess)
    return F.greatest(guess, F.lit(1).cast("long"))


def benjamini_hochberg(rows: DataFrame, family: Sequence[str], q: float = 0.05) -> DataFrame:
    """Step-up Benjamini-Hochberg per family; adds ``fdr_significant``.

    ``rows`` has ``p`` and ``in_family`` and should be a stored table, since it is read three times.

    Step-up asks for the largest rank whose p is within its share of q. Every p needs a certain
    rank to pass, an integer v, and v passes if at least v tests need no more than v. So the search
    runs over counts per needed rank. The ranks of a family of m tests are cut into about sqrt(m)
    ranges: one running sum over the ranges, then one within each range, so no window ever
    holds more than about sqrt(m) rows.
    """
    family = list(family)
    tests = rows.where(F.col("in_family") & F.col("p").isNotNull()).select(*family, "p", F.lit(1).alias("n"))
    return (
        rows.join(F.broadcast(significance_limits(tests, family, q)), family, "left")
        .withColumn("fdr_significant",
                    F.coalesce(F.col("in_family") & (F.col("p") <= F.col("_p_limit")), F.lit(False)))
        .drop("_p_limit")
    )


def significance_limits(tests: DataFrame, family: Sequence[str], q: float = 0.05) -> DataFrame:
    """The largest significant p of each family that has one, as ``_p_limit``.

    ``tests`` has ``p`` and ``n``, the number of tests with it; tests whose p is above q may be given without it.
    """
    family = list(family)
    sizes = tests.groupBy(*family).agg(F.sum("n").alias("m")).withColumn(
        "width", F.ceil(F.sqrt(F.col("m"))).cast("long"))
    # one row per family
    ranked = tests.where(F.col("p").isNotNull()).join(F.broadcast(sizes), family).withColumn("need", _needed_rank(F.col("p"), F.col("m"), q))
    per_rank = (
        ranked.where(F.col("need") <= F.col("m"))
        .groupBy(*family, F.floor((F.col("need") - 1) / F.col("width")).alias("range"), "need")
        .agg(F.sum("n").alias("c"), F.max("p").alias("p_max"))
    )
    before = Window.partitionBy(*family).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_rank.groupBy(*family, "range").agg(F.sum("c").alias("t")).select(
        *family, "range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(*family, "range").orderBy("need").rowsBetween(Window.unboundedPreceding, 0)
    reached = per_rank.join(starts, [*family, "range"]).withColumn(
        "cum", F.col("start") + F.sum("c").over(within))
    # stored: one number per family, so that reading the flags costs no more than reading the table
    return settle(reached.where(F.col("cum") >= F.col("need")).groupBy(*family).agg(F.max("p_max").alias("_p_limit")))
