"""Repeated phrases: identical units, shared unit endings, and what they mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import clip
from lexispark.params import Params

FULL_UNIT = "full_unit"
FINAL_NGRAM = "final_ngram"

_OCCURRENCE = ["phrase_id", "kind", "pattern", "word_count", "unit_id", "start_pos", "end_pos", "is_first"]


def _phrase_id(kind, *parts):
    return F.xxhash64(kind, *parts)


def unit_lengths(tokens: DataFrame) -> DataFrame:
    """Tokens per unit."""
    return tokens.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_tokens"))


def full_unit_repeats(units: DataFrame, lengths: DataFrame, p: Params = Params()) -> DataFrame:
    """Occurrences of texts shared by enough units.

    Units are grouped by a 256-bit digest so whole texts stay out of the shuffle; the text itself
    is only fetched for the first unit of each repeated group.
    """
    keyed = units.select("unit_id", F.unhex(F.sha2("text_norm", 256)).alias("_key"))
    groups = (
        keyed.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("unit_id").alias("_first"))
        .where(F.col("_n") >= p.full_unit_min)
    )
    heads = units.select(F.col("unit_id").alias("_first"), clip(F.col("text_norm"), 500).alias("pattern"))
    sizes = lengths.select(F.col("unit_id").alias("_first"), F.col("n_tokens").alias("word_count"))
    described = groups.join(heads, "_first").join(sizes, "_first", "left").fillna(0, ["word_count"])
    return keyed.join(described, "_key").select(
        _phrase_id(F.lit(FULL_UNIT), F.col("_key")).alias("phrase_id"),
        F.lit(FULL_UNIT).alias("kind"),
        "pattern",
        "word_count",
        "unit_id",
        F.lit(1).cast("long").alias("start_pos"),
        F.col("word_count").alias("end_pos"),
        (F.col("unit_id") == F.col("_first")).alias("is_first"),
    )


def unit_tails(tokens: DataFrame, lengths: DataFrame, p: Params = Params()) -> DataFrame:
    """The last few tokens of each unit as an array (never more than the longest n-gram)."""
    near_end = tokens.join(lengths, "unit_id").where(F.col("pos") > F.col("n_tokens") - p.ngram_max_n)
    last = near_end.groupBy("unit_id", "n_tokens").agg(
        F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("_tail"))
    return last.select("unit_id", "n_tokens", F.col("_tail.norm").alias("tail"))


def final_ngrams(tails: DataFrame, p: Params = Params()) -> DataFrame:
    """Every unit-final n-gram: unit_id, n, pattern, start_pos, end_pos."""
    n = F.explode(F.sequence(F.lit(p.ngram_min_n), F.lit(p.ngram_max_n))).alias("n")
    grams = tails.select("unit_id", "n_tokens", "tail", n).where(F.col("n") <= F.size("tail"))
    return grams.select(
        "unit_id", "n",
        F.array_join(F.slice("tail", -F.col("n"), F.col("n")), " ").alias("pattern"),
        (F.col("n_tokens") - F.col("n") + 1).alias("start_pos"),
        F.col("n_tokens").alias("end_pos"),
    )


def qualifying_patterns(grams: DataFrame, p: Params = Params()) -> DataFrame:
    """(n, pattern) that end enough units; each unit contributes one row per n."""
    counts = grams.groupBy("n", "pattern").agg(F.count(F.lit(1)).alias("n_units"))
    return counts.where(F.col("n_units") >= p.ngram_min_units)


def longest_assignment(grams: DataFrame, qualifying: DataFrame) -> DataFrame:
    """One row per unit: its longest qualifying ending."""
    hits = grams.join(qualifying.select("n", "pattern"), ["n", "pattern"], "left_semi")
    best = hits.groupBy("unit_id").agg(
        F.max(F.struct("n", "pattern", "start_pos", "end_pos")).alias("_best"))
    return best.select("unit_id", "_best.*")


def ngram_occurrences(assigned: DataFrame) -> DataFrame:
    """Occurrences regrouped by assigned pattern; the lowest unit of each is the first."""
    firsts = assigned.groupBy("n", "pattern").agg(F.min("unit_id").alias("_first"))
    return assigned.join(firsts, ["n", "pattern"]).select(
        _phrase_id(F.lit(FINAL_NGRAM), F.col("n"), F.col("pattern")).alias("phrase_id"),
        F.lit(FINAL_NGRAM).alias("kind"),
        clip(F.col("pattern"), 500).alias("pattern"),
        F.col("n").cast("long").alias("word_count"),
        "unit_id", "start_pos", "end_pos",
        (F.col("unit_id") == F.col("_first")).alias("is_first"),
    )


def word_tails(units: DataFrame, p: Params = Params()) -> DataFrame:
    """:func:`unit_tails` of units that hold their words as an array: nothing is exploded or shuffled."""
    some = units.where(F.size("words") > 0)
    last = F.when(F.size("words") <= p.ngram_max_n, F.col("words")).otherwise(
        F.slice("words", -p.ngram_max_n, p.ngram_max_n))
    return some.select("unit_id", F.size("words").cast("long").alias("n_tokens"), last.alias("tail"))


def phrase_occurrences(units: DataFrame, tokens: DataFrame | None = None, p: Params = Params()) -> DataFrame:
    """Both detectors together; without ``tokens`` the units' own ``words`` are used, which costs no token shuffle."""
    tails = word_tails(units, p) if tokens is None else unit_tails(tokens, unit_lengths(tokens), p)
    lengths = tails.select("unit_id", "n_tokens")
    grams = final_ngrams(tails, p)
    assigned = longest_assignment(grams, qualifying_patterns(grams, p))
    return full_unit_repeats(units, lengths, p).unionByName(ngram_occurrences(assigned)).select(*_OCCURRENCE)


def phrase_table(occurrences: DataFrame) -> DataFrame:
    """One row per phrase; the count is taken after assignment, so it may be below the threshold."""
    return occurrences.groupBy("phrase_id", "kind", "pattern", "word_count").agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.min("unit_id").alias("first_unit"))


def masked_ranges(occurrences: DataFrame) -> DataFrame:
    """Token ranges to leave out: all but the first occurrence of every phrase."""
    return occurrences.where(~F.col("is_first")).select("unit_id", "start_pos", "end_pos")


def first_instance_units(occurrences: DataFrame) -> DataFrame:
    """Units that hold some phrase's first occurrence and in which nothing is masked."""
    per_unit = occurrences.groupBy("unit_id").agg(
        F.max("is_first").alias("_any_first"), F.max(~F.col("is_first")).alias("_any_masked"))
    return per_unit.where("_any_first and not _any_masked").select("unit_id")


def first_instance_conflicts(occurrences: DataFrame) -> DataFrame:
    """How many claimed first instances lose the claim because another detector masks them."""
    per_unit = occurrences.groupBy("unit_id").agg(
        F.max("is_first").alias("_any_first"), F.max(~F.col("is_first")).alias("_any_masked"))
    return per_unit.where("_any_first").agg(
        F.count(F.lit(1)).alias("claimed"),
        F.count(F.when(F.col("_any_masked"), 1)).alias("conflicts"))
