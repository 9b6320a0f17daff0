"""Reading the pair table from the side of single items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import stats as st
from lexispark.params import RAW, REDUCED
from lexispark.session import with_group_rank

_KEY = ["item_type", "item", "partner"]


def partner_view(table: DataFrame) -> DataFrame:
    """Each pair seen from both ends: item, partner. Joins and groups need no OR over two columns."""
    rest = [c for c in table.columns if c not in ("item_a", "item_b")]
    ends = F.inline(F.array(
        F.struct(F.col("item_a").alias("item"), F.col("item_b").alias("partner")),
        F.struct(F.col("item_b").alias("item"), F.col("item_a").alias("partner"))))
    return table.select(*rest, ends)


def with_direction(view: DataFrame) -> DataFrame:
    return view.withColumn("direction", st.direction(F.col("n_ab"), F.col("expected")))


def status_changes(view: DataFrame) -> DataFrame:
    """item_type, item, partner of pairs in both variants whose significance or direction differs."""
    of = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    both = view.groupBy(*_KEY).agg(
        of(RAW, "fdr_significant").alias("s1"), of(REDUCED, "fdr_significant").alias("s2"),
        of(RAW, "direction").alias("d1"), of(REDUCED, "direction").alias("d2"))
    return both.where("s1 is not null and s2 is not null and (s1 <> s2 or d1 <> d2)").select(*_KEY)


def top_n_forced(view: DataFrame, n: int = 10) -> DataFrame:
    """The n strongest partners per item and variant, plus every partner whose status changed.

    The two parts are found separately: the top-n filter is limited inside each task before the
    shuffle, so a very frequent item's partners are never sorted in one place.
    """
    changed = status_changes(view).withColumn("status_changed", F.lit(True))
    marked = view.join(changed, _KEY, "left").withColumn(
        "status_changed", F.coalesce("status_changed", F.lit(False)))
    strongest = Window.partitionBy("item_type", "variant", "item").orderBy(F.desc("g2"), F.asc("partner"))
    top = marked.withColumn("rank", F.row_number().over(strongest)).where(F.col("rank") <= n)
    keys = ["item_type", "variant", "item", "partner"]
    forced = marked.where("status_changed").join(top.select(*keys), keys, "left_anti").withColumn(
        "rank", F.lit(None).cast("int"))
    return top.unionByName(forced)


def shown_total(view: DataFrame, shown: DataFrame) -> DataFrame:
    """How many partners are shown out of how many, per item and variant."""
    keys = ["item_type", "variant", "item"]
    total = view.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    some = shown.groupBy(*keys).agg(F.count(F.lit(1)).alias("shown"))
    return total.join(some, keys)


def presented(rows: DataFrame) -> DataFrame:
    """Rounded payload columns of a partner row."""
    reduced = F.col("variant") == REDUCED
    return rows.select(
        "item_type", "variant", "item", "partner", "n_ab",
        F.when(reduced, F.col("n_ab_first_instance")).alias("n_ab_first_instance"),
        F.when(reduced, F.col("n_ab") - F.col("n_ab_first_instance")).alias("n_ab_non_phrase"),
        F.round("expected", 2).alias("expected"),
        F.round(st.ratio(F.col("n_ab"), F.col("expected")), 1).alias("ratio"),
        F.round("pmi", 2).alias("pmi"),
        F.round("g2", 1).alias("g2"),
        "direction", "fdr_significant", "top_section",
        F.round("top_share", 3).alias("top_share"),
        st.concentrated(F.col("top_share")).alias("concentration_warning"),
        "status_changed")


def finding_classes(view: DataFrame) -> DataFrame:
    """The finding label of every partner row, given its counterpart in the other variant."""
    changed = status_changes(view).withColumn("status_changed", F.lit(True))
    other = view.select(
        *_KEY, F.when(F.col("variant") == RAW, REDUCED).otherwise(RAW).alias("variant"),
        F.col("fdr_significant").alias("_other"))
    rows = view.join(other, [*_KEY, "variant"], "left").join(changed, _KEY, "left")
    return rows.withColumn("finding", st.finding_class(
        F.coalesce("status_changed", F.lit(False)), F.col("fdr_significant"), F.col("_other"),
        F.col("direction"), F.col("expected"), F.col("top_share"))).drop("_other", "status_changed")


def group_by_direction(view: DataFrame) -> DataFrame:
    """Partners per item, variant and direction with the number of changed ones."""
    changed = status_changes(view).withColumn("status_changed", F.lit(True))
    rows = view.join(changed, _KEY, "left")
    order = F.when(F.col("direction") == "association", 1).when(F.col("direction") == "neutral", 2).otherwise(3)
    return rows.groupBy("item_type", "variant", "item", "direction", order.alias("direction_rank")).agg(
        F.count(F.lit(1)).alias("n_partners"),
        F.count(F.when(F.col("status_changed"), 1)).alias("n_changed"),
        F.max("g2").alias("max_g2"))


def direction_lists(view: DataFrame) -> DataFrame:
    """Partners of each item, variant and direction in the order of the groups: strongest first, then byte order.

    One row per partner with its place, so a common item's list is rows, never one value, and its order is found by a
    range sort of all lists, never in one task.
    """
    order = F.when(F.col("direction") == "association", 1).when(F.col("direction") == "neutral", 2).otherwise(3)
    group = ["item_type", "variant", "item", "direction"]
    rows = view.select(*group, order.alias("direction_rank"), "partner", "g2")
    return with_group_rank(rows, group, [F.desc("g2"), F.asc("partner")], "place")


def variant_compare(table: DataFrame) -> DataFrame:
    """The same pair in both variants side by side."""
    keys = ["item_type", "item_a", "item_b"]
    side = lambda v, s: table.where(F.col("variant") == v).select(
        *keys, *[F.col(c).alias(f"{c}_{s}") for c in ("n_ab", "expected", "g2", "fdr_significant")])
    return side(RAW, "raw").join(side(REDUCED, "reduced"), keys, "full_outer")


def item_statistics(table: DataFrame, dispersion: DataFrame, profiles: DataFrame, builds: DataFrame,
                    n: int = 10) -> DataFrame:
    """One nested row per item of the published build: partners per variant, dispersion, profile counts.

    The partner array holds the top n plus the changed partners; it is the result's shape.
    """
    published = builds.where("is_current").select("build")
    live = with_direction(partner_view(table.join(F.broadcast(published), "build", "left_semi")))
    shown = top_n_forced(live, n)
    counts = shown_total(live, shown)
    partners = presented(shown).groupBy("item_type", "variant", "item").agg(
        F.sort_array(F.collect_list(F.struct(F.col("g2"), F.col("partner"), F.col("n_ab"), F.col("direction"),
                                             F.col("fdr_significant"), F.col("status_changed"))), asc=False).alias("partners"))
    spread = dispersion.where(F.col("variant") == RAW).select(
        "item_type", "item", F.struct("n_units", F.round("juilland_d", 3).alias("juilland_d"),
                                      F.round("dp", 3).alias("dp")).alias("dispersion"))
    return (
        partners.join(counts, ["item_type", "variant", "item"])
        .join(spread, ["item_type", "item"], "left")
        .join(profiles, ["item_type", "variant", "item"], "left")
    )
