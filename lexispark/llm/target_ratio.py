"""Quality rules by a likelihood ratio of hashed n-grams, in DataFrame functions only.

Two multinomials over ``buckets`` hash buckets of words and word pairs are counted: one over a trusted target, one over
the whole raw corpus. A text's score is the mean over its n-grams of log P_target - log P_raw, so length cancels; it is
kept if its base rules hold and the score reaches a fixed threshold. Both counts are reduced per task before they are
shuffled, and what every row then looks up is one array of ``buckets`` numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
SMOOTHING = 0.5         # added to every bucket
TRUSTED = 8192          # trusted texts that define the target, at most
THRESHOLD = -0.1        # mean log ratio from which a text is kept
UNIT = 10_000           # parts of a natural-log unit in which ratios are kept
SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, also where a lambda of ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _windows(words: Column, width: int) -> Column:
    """Hash of each ``width`` consecutive words."""
    at = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[words[i + k] for k in range(width)]))


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that occurs at least twice in the text, first one included."""
    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))),
            lambda e: e["i"])))
        return let(twice, lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(width), F.get(p, j + 1) - x), F.lit(width))),
            F.lit(0), lambda total, x: total + x))

    return let(_windows(words, width), lambda hashes: F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(0))


def base_rules(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; a null text counts as empty."""
    plain = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(word_array(text), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(plain, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda own: F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words")))


def _grams(words: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbouring words."""
    at = F.sequence(F.lit(0), F.size(words) - 2)
    singles = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = F.transform(at, lambda i: F.pmod(F.xxhash64(words[i], words[i + 1]), F.lit(buckets)).cast("int"))
    return F.concat(singles, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<int>")))


def _counts(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    grams = let(word_array(F.col(text)), lambda words: _grams(words, buckets))
    return docs.select(F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """log P_target - log P_raw of every bucket in whole units of 1 / ``UNIT``: ``buckets`` numbers, whatever the corpus.

    Whole numbers make a text's score the same in every order of summation.
    """
    raw, target = _counts(docs, text, buckets), _counts(trusted, text, buckets)
    both = raw.select("bucket", F.col("n").alias("r"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("r"), F.col("n").alias("t"))).unionByName(
        docs.sparkSession.range(buckets).select(
            F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("t")))
    summed = both.groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    # a row per bucket meets here: bounded by the parameter
    listed = summed.agg(F.sort_array(F.collect_list(F.struct("bucket", "r", "t"))).alias("all"),
                        F.sum("r").alias("raw"), F.sum("t").alias("target"))

    def share(n: Column, total: Column) -> Column:
        return F.log((n + SMOOTHING) / (total + SMOOTHING * buckets))

    return listed.select(F.transform("all", lambda x: F.round(
        UNIT * (share(x["t"], F.col("target")) - share(x["r"], F.col("raw")))).cast("int")).alias("weights")).first().weights


def judge(docs: DataFrame, ratios: list[int], text: str = "text", threshold: float = THRESHOLD,
          buckets: int = BUCKETS) -> DataFrame:
    """All rows and columns of ``docs`` with the base counts, score, base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated three-word windows. A text without
    words (null included) scores 0 and fails the base rules. Columns with these names are replaced.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")
    base = docs.select(*[c for c in docs.columns if c not in added])
    # one constant: folded into a literal array before execution
    weights = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    score = let(word_array(F.col(text)), lambda words: let(_grams(words, buckets), lambda grams: F.aggregate(
        grams, F.lit(0).cast("long"), lambda total, g: total + weights[g]) / UNIT / F.greatest(F.size(grams), F.lit(1))))
    counted = base.withColumns({"__base": base_rules(F.col(text)), "score": score}).select(*base.columns, "__base.*", "score")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def trusted_texts(docs: DataFrame, labels: DataFrame, is_trusted: Column, key: str = "doc_id", limit: int = TRUSTED
                  ) -> DataFrame:
    """The rows of at most ``limit`` trusted keys, those first in the order of a hash; the key list is bounded so."""
    keys = (
        labels.where(is_trusted).where(F.col(key).isNotNull()).select(F.col(key).alias("__key")).distinct()
        .orderBy(F.xxhash64(F.col("__key").cast("string")), "__key").limit(limit)
    )
    return docs.join(F.broadcast(keys), docs[key] == F.col("__key"), "left_semi")


def train(docs: DataFrame, labels: DataFrame, is_trusted: Column, key: str = "doc_id", text: str = "text",
          buckets: int = BUCKETS, limit: int = TRUSTED) -> list[int]:
    """``log_ratios`` against the trusted sample; without trusted rows the target is uniform over the buckets."""
    return log_ratios(docs, trusted_texts(docs, labels, is_trusted, key, limit), text, buckets)
