"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Every source is a task with a weight, its blocks of ``block`` rows are the task's jobs. Block i (from 0) of a source
with weight w is released at slot floor(i / w) and due by slot ceil((i + 1) / w). Weights are quanta of a frame of
``frame`` slots, so releases and deadlines repeat from frame to frame, and one frame of earliest-deadline-first
decisions, each among the released blocks, fixes the order of all frames. While every source still has blocks, a source
is never a whole block ahead of or behind its share: |blocks taken by slot t - w t| < 1.

No row is dropped or repeated. A source that has run out leaves its slots empty, and later slots move up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.session import settle, with_global_rank

BLOCK = 16
FRAME = 1024
MOST_SOURCES = 2048     # sources whose slots one task decides


def quanta(counts: DataFrame, frame: int = FRAME, power: float = 0.5) -> DataFrame:
    """(source, quanta): slots of a frame per source, in proportion to n ** power, one at least, ``frame`` in sum.

    With a column ``weight`` in ``counts`` the slots are in proportion to that instead. Largest remainders get the slots that
    rounding leaves over; of equal remainders the smaller source. ``counts`` has one row per source, ``frame`` at most, so
    they may meet in one row.
    """
    weight = F.col("weight").cast("double") if "weight" in counts.columns else F.pow("n", F.lit(power))
    listed = counts.agg(F.sort_array(F.collect_list(F.struct(
        F.col("source").isNull().alias("none"), "source", weight.alias("w")))).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda sum_, s: sum_ + s["w"])
    shared = listed.withColumn("share", F.transform("all", lambda s: (
        (F.lit(frame) - F.size("all")) * s["w"] / total))).withColumn(
        "left", F.lit(frame) - F.size("all") - F.aggregate("share", F.lit(0).cast("long"), lambda sum_, x: sum_ + F.floor(x)))
    order = shared.withColumn("order", F.array_sort(F.transform("share", lambda x, i: F.struct(
        F.round(F.floor(x) - x, 9).alias("r"), i.alias("i")))))
    return order.select(F.posexplode("order").alias("place", "o"), "all", "share", "left").select(
        F.col("all")[F.col("o.i")]["source"].alias("source"),
        (F.floor(F.col("share")[F.col("o.i")]) + 1 + F.when(F.col("place") < F.col("left"), 1).otherwise(0))
        .cast("int").alias("quanta"))


def _weighted(counts: DataFrame, weights: DataFrame | dict) -> DataFrame:
    """``counts`` with the weight of every source; a source without exactly one positive weight raises ValueError."""
    if isinstance(weights, dict):
        kind = counts.schema["source"].dataType
        fields = T.StructType([T.StructField("source", kind), T.StructField("weight", T.DoubleType())])
        weights = counts.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], fields)
    given = weights.groupBy(F.col("source").alias("s")).agg(F.min("weight").alias("weight"), F.count(F.lit(1)).alias("times"))
    joined = settle(counts.join(given, counts["source"].eqNullSafe(F.col("s")), "left").select("source", "n", "weight", "times"))
    finite = (F.col("weight") > 0) & (F.col("weight") < float("inf")) & (F.col("times") == 1)
    bad = joined.where(~F.coalesce(finite, F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} sources without one positive weight")
    return joined.select("source", "n", "weight")


def frame_pattern(weights: DataFrame, frame: int = FRAME) -> DataFrame:
    """(source, turn, slot): the slot in a frame at which each source's turn-th block of the frame comes.

    Among the blocks whose release has come, the earliest deadline goes first; of equal deadlines the source with more
    quanta, then the smaller source.
    """
    tasks = weights.agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("quanta")).alias("q"), F.col("source").isNull().alias("none"), "source"))).alias("tasks"))
    start = F.struct(F.transform("tasks", lambda t: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("order"))

    def decide(state: Column, slot: Column) -> Column:
        due = F.transform("tasks", lambda t, i: F.when(
            F.floor(state["done"][i] * F.lit(frame) / -t["q"]) <= slot,
            F.struct(F.ceil((state["done"][i] + 1) * F.lit(frame) / -t["q"]).alias("deadline"), i.alias("i"))))
        pick = F.array_min(due)["i"]
        return F.struct(
            F.transform(state["done"], lambda d, i: F.when(i == pick, d + 1).otherwise(d)).alias("done"),
            F.concat(state["order"], F.array(pick)).alias("order"))

    run = tasks.where(F.size("tasks") > 0).select("tasks", F.aggregate(F.sequence(F.lit(0), F.lit(frame - 1)), start, decide)["order"].alias("order"))
    slots = run.select("tasks", F.posexplode("order").alias("slot", "i")).select(
        F.col("tasks")[F.col("i")]["source"].alias("source"), "slot", "i")
    by_source = slots.groupBy("i", "source").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    return by_source.select("source", F.posexplode("slots").alias("turn", "slot"))


def mix_sources(
    docs: DataFrame, source: str = "source", key: str = "doc_id", block: int = BLOCK, frame: int = FRAME,
    power: float = 0.5, weights: DataFrame | dict | None = None
) -> DataFrame:
    """One row ``(key, source, block, slot, position)`` per row of ``docs``; position counts from 1 in mixed order.

    Rows of a source are ordered by the md5 of their key, then the key, and cut into blocks of ``block``. Targets are in
    proportion to ``weights`` (source, weight), or else to (rows of the source) ** power. Every source of ``docs`` then needs
    one positive weight; others are not looked at. A frame has a slot per weight's share, so more than ``MOST_SOURCES``
    sources are refused: one task decides a frame. A null source is a source of its own, null keys and repeated rows are
    placed like others, an empty table gives an empty table; only the two named columns are read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.md5(F.col(key).cast("string")).alias("__o"))
    # range-partitioned ranks: no source, however large, is ordered in one task
    ranked = settle(with_global_rank(
        rows, [F.col("source").asc_nulls_first(), F.col("__o"), F.col("key")], "rank").drop("__o"))
    counts = settle(ranked.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")))
    n_sources = counts.count()
    if n_sources > MOST_SOURCES:
        raise ValueError(f"{n_sources} sources: group them into {MOST_SOURCES} or fewer")
    frame = max(frame, 2 * n_sources)       # a source has one slot at least
    sized = counts.select("source", "n")
    if weights is not None:
        sized = _weighted(sized, weights)
    weights = settle(quanta(sized, frame, power))
    # both are bounded: a row per source, and a row per slot of a frame
    sources = weights.join(counts, weights["source"].eqNullSafe(counts["source"])).select(
        counts["source"].alias("s"), "first", "quanta")
    pattern = settle(frame_pattern(weights, frame)).withColumnRenamed("source", "s")
    placed = (
        ranked.join(F.broadcast(sources), ranked["source"].eqNullSafe(F.col("s"))).drop("s")
        .withColumn("within", F.col("rank") - F.col("first"))
        .withColumn("block", F.floor(F.col("within") / block))
        .withColumn("round", F.floor(F.col("block") / F.col("quanta")))
        .withColumn("__turn", (F.col("block") % F.col("quanta")).cast("int"))
    )
    slotted = placed.join(
        F.broadcast(pattern), placed["source"].eqNullSafe(F.col("s")) & (F.col("__turn") == F.col("turn"))
    ).select("key", "source", "block", (F.col("round") * frame + F.col("slot")).alias("slot"), "within")
    out = with_global_rank(slotted, [F.col("slot"), F.col("within")], "position")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "block", "slot", "position")


def in_mixed_order(docs: DataFrame, source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """All rows and columns of ``docs``, range-partitioned and sorted by their position in the mix."""
    found = mix_sources(docs, source, key, **options).groupBy(
        F.col(key).alias("__k"), F.col(source).alias("__s")).agg(F.min("position").alias("__position"))
    joined = docs.join(found, docs[key].eqNullSafe(F.col("__k")) & docs[source].eqNullSafe(F.col("__s")))
    return joined.repartitionByRange("__position").sortWithinPartitions("__position").drop("__k", "__s", "__position")
