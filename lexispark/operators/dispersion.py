"""How evenly items spread over sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.params import RAW, REDUCED, Params
from lexispark.session import settle


def item_sections(sets: DataFrame) -> DataFrame:
    """Units per item and section in both variants: item_type, variant, item, section, n, first_unit."""
    wide = sets.groupBy("item_type", "item", "section").agg(
        F.count(F.lit(1)).alias("c_raw"),
        F.count(F.when(F.col("in_reduced"), 1)).alias("c_red"),
        F.min("unit_id").alias("u_raw"),
        F.min(F.when(F.col("in_reduced"), F.col("unit_id"))).alias("u_red"))
    side = lambda v, c, u: F.struct(F.lit(v).alias("variant"), F.col(c).alias("n"), F.col(u).alias("first_unit"))
    return wide.select("item_type", "item", "section", F.inline(F.array(
        side(RAW, "c_raw", "u_raw"), side(REDUCED, "c_red", "u_red")))).where("n > 0")


def section_weights(per_section: DataFrame) -> DataFrame:
    """Item slots per section, the total, and the number of sections in use."""
    weights = per_section.groupBy("item_type", "variant", "section").agg(F.sum("n").alias("weight"))
    total = weights.groupBy("item_type", "variant").agg(
        F.sum("weight").alias("total_weight"), F.count(F.lit(1)).alias("k"))
    # one row per item type and variant
    return weights.join(F.broadcast(total), ["item_type", "variant"])


def dispersion_table(sets: DataFrame, p: Params = Params()) -> DataFrame:
    """Juilland's D, Gries' DP, n_units and the leading section per item.

    Only sections in which an item occurs are visited. D needs the sum of squared counts; in DP an
    absent section contributes exactly its weight share, so those sum to one minus the present shares.
    """
    per_section = settle(item_sections(sets))
    weights = settle(section_weights(per_section))
    rows = per_section.join(weights, ["item_type", "variant", "section"])
    keys = ["item_type", "variant", "item"]
    total = F.sum("n").over(Window.partitionBy(*keys))  # at most one row per section
    share = F.col("n") / F.col("n_units")
    weight_share = F.col("weight") / F.col("total_weight")
    scored = rows.withColumn("n_units", total).where(F.col("n_units") >= p.floor_item).groupBy(*keys).agg(
        F.max("n_units").alias("n_units"),
        F.max("k").alias("k"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        F.sum(F.abs(share - weight_share) - weight_share).alias("present"),
        F.max_by("section", F.struct(F.col("n"), -F.col("first_unit"))).alias("top_section"),
        F.max("n").alias("top_n"),
    )
    t = F.col("n_units").cast("double")
    cv = F.sqrt(F.greatest(F.col("k") * F.col("squares") - t * t, F.lit(0.0))) / t
    return scored.select(
        *keys, "n_units",
        F.when(F.col("k") > 1, F.greatest(F.lit(0.0), 1.0 - cv / F.sqrt(F.greatest(F.col("k") - 1, F.lit(1)))))
        .alias("juilland_d"),
        ((F.col("present") + 1.0) / 2.0).alias("dp"),
        "top_section",
        (F.col("top_n") / F.col("n_units")).alias("top_share"),
    )
