"""Item sets per unit, pair counts and the full pair table for both corpus variants."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import stats as st
from lexispark.operators.fdr import benjamini_hochberg, significance_limits
from lexispark.params import RAW, REDUCED, Params
from lexispark.session import let_go, settle, unsettle, with_global_rank

PAIRS_IN_TASK = 1 << 20     # pairs of single units that a task counts, about
PAIRS_AT_ONCE = 1 << 26     # pairs of single units on the way at a time, about; they take some three bytes each
SLICES = 64                 # times that the units are read at most
HOT_ITEMS, HOT_UNITS = 1 << 10, 1 << 12     # so many items, of more units, are paired with each other before they move
LOOKUP_ROWS = 1 << 19       # numbered items up to which their counts go to all tasks


def mask_ranges(tokens: DataFrame, ranges: DataFrame) -> DataFrame:
    """Tokens outside every masked range of their unit."""
    r = ranges.select(F.col("unit_id").alias("_u"), "start_pos", "end_pos")
    hit = (F.col("unit_id") == F.col("_u")) & F.col("pos").between(F.col("start_pos"), F.col("end_pos"))
    return tokens.join(r, hit, "left_anti")


def flag_masked(tokens: DataFrame, ranges: DataFrame | None) -> DataFrame:
    """All tokens with ``kept``, false inside a masked range.

    A token in two overlapping ranges appears twice; every consumer takes a maximum per unit, so
    that does no harm and saves a second pass for the reduced variant.
    """
    if ranges is None:
        return tokens.withColumn("kept", F.lit(True))
    r = ranges.select(F.col("unit_id").alias("_u"), "start_pos", "end_pos")
    hit = (F.col("unit_id") == F.col("_u")) & F.col("pos").between(F.col("start_pos"), F.col("end_pos"))
    return tokens.join(r, hit, "left").withColumn("kept", F.col("_u").isNull()).drop("_u", "start_pos", "end_pos")


def item_occurrences(tokens: DataFrame, item_columns: Mapping[str, str]) -> DataFrame:
    """One row per token and item type; null and empty items are dropped."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("item_type"), F.col(col).cast("string").alias("item"))
        for name, col in item_columns.items()
    ])
    return tokens.select("unit_id", "section", "kept", F.inline(pairs)).where(
        F.col("item").isNotNull() & (F.col("item") != ""))


def item_sets(occurrences: DataFrame) -> DataFrame:
    """Distinct items per unit (presence only); ``in_reduced`` if it also occurs unmasked."""
    return occurrences.groupBy("item_type", "unit_id", "section", "item").agg(
        F.max("kept").alias("in_reduced"))


def marginals(sets: DataFrame) -> DataFrame:
    """Units per item in both variants."""
    return sets.groupBy("item_type", "item").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count(F.when(F.col("in_reduced"), 1)).alias("n_reduced"))


def unit_totals(sets: DataFrame) -> DataFrame:
    """Units with at least one item, per item type and variant: item_type, variant, n_total."""
    per_unit = sets.groupBy("item_type", "unit_id").agg(F.max("in_reduced").alias("in_reduced"))
    wide = per_unit.groupBy("item_type").agg(
        F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("in_reduced"), 1)).alias("reduced"))
    return wide.select("item_type", F.inline(F.array(
        F.struct(F.lit(RAW).alias("variant"), F.col("raw").alias("n_total")),
        F.struct(F.lit(REDUCED).alias("variant"), F.col("reduced").alias("n_total")))))


def unit_scopes(flagged: DataFrame) -> DataFrame:
    """Units with tokens, and units not wholly masked: variant, n_scope."""
    per_unit = flagged.groupBy("unit_id").agg(F.max("kept").alias("kept"))
    wide = per_unit.agg(F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("kept"), 1)).alias("reduced"))
    return wide.select(F.inline(F.array(
        F.struct(F.lit(RAW).alias("variant"), F.col("raw").alias("n_scope")),
        F.struct(F.lit(REDUCED).alias("variant"), F.col("reduced").alias("n_scope")))))


def unit_cells(rows: DataFrame, unit: Sequence[str] = ("item_type", "unit_id"), p: Params = Params()) -> DataFrame:
    """The units' items as sorted arrays, whose pairs :func:`unit_partners` makes; ``rows`` has the unit columns and distinct items.

    A unit with n items is cut into about n/block blocks, and cell (i, j) receives blocks i and j, so
    no task pairs a whole large unit; ordinary units keep a single cell. Items become arrays before they move.
    """
    unit, on = list(unit), [*unit, "_blocks", "_ci", "_cj"]
    blocks = F.ceil(F.size("_items") / p.pair_block).cast("int")
    lists = rows.groupBy(*unit).agg(F.sort_array(F.collect_list("item")).alias("_items")).withColumn("_blocks", blocks)
    block, zero = F.pmod(F.hash("item"), F.col("_blocks")), F.lit(0)
    ordinary = lists.where("_blocks <= 1").select(*unit, "_blocks", zero.alias("_ci"), zero.alias("_cj"), "_items")
    placed = lists.where("_blocks > 1").select(*unit, "_blocks", F.explode("_items").alias("item")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    # pairing turns few input bytes into many rows, so the partition count is fixed here instead of
    # being coalesced by input size; a cell holds at most about two blocks, so there is no skew to split
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = placed.select(
        *unit, "item", "_blocks", F.least(block, F.col("_other")).alias("_ci"), F.greatest(block, F.col("_other")).alias("_cj")
    ).repartition(parts, *on).groupBy(*on).agg(F.sort_array(F.collect_list("item")).alias("_items"))
    return ordinary.unionByName(cells)


def unit_partners(cells: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Every item of a cell as item_a, with the larger ones that it is paired with there: unit columns, item_a, partners."""
    block = lambda c: F.pmod(F.hash(c), F.col("_blocks"))
    firsts = cells.select("*", F.posexplode("_items").alias("_i", "item_a"))
    larger = F.slice("_items", F.col("_i") + 2, F.size("_items"))
    # pairs inside one block belong to its diagonal cell only
    once = F.when(F.col("_ci") == F.col("_cj"), larger).otherwise(F.filter(larger, lambda x: block(x) != block(F.col("item_a"))))
    return firsts.select(*unit, "item_a", once.alias("partners"))


def unit_pairs(rows: DataFrame, unit: Sequence[str] = ("item_type", "unit_id"), p: Params = Params()) -> DataFrame:
    """Unordered item pairs of each unit as item_a < item_b; ``rows`` has the unit columns and distinct items.

    Each bounded cell is sorted once, then every item is followed by the larger ones: two fused generators instead of a self-join.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = unit_cells(rows, unit, p).repartition(parts, *unit, "_ci", "_cj")
    return unit_partners(cells, unit).select(*unit, "item_a", F.explode("partners").alias("item_b"))


class NumberedItems:
    """Numbers of items, in the byte order of type and item, and units whose items are such numbers.

    In a unit an item is its number, below it one bit that the caller sets, above it whether it is hot: among the ``HOT_ITEMS`` in
    most units, and in more than ``HOT_UNITS``. So hot items are the last of a unit.
    """

    def __init__(self, wanted: DataFrame) -> None:
        self.table = settle(with_global_rank(wanted, [F.col("item_type"), F.col("item")], "id"))
        self.count = self.table.count()
        most = self.table.select("n_raw").orderBy(F.desc("n_raw")).limit(HOT_ITEMS + 1)
        after = most.agg(F.count(F.lit(1)).alias("n"), F.min("n_raw").alias("least")).first()   # two numbers
        self.hot_above = max(HOT_UNITS, after.least if after.n > HOT_ITEMS else 0)
        self.kind, self.hot_bit = ("int", 1 << 29) if self.count < 1 << 28 else ("bigint", 1 << 61)
        # numbers go up with the types, of which there are a few
        self.types = self.table.groupBy("item_type").agg(F.max("id").alias("last")).orderBy("last").collect()

    def held(self, bit: Column) -> Column:
        """What stands in a unit for an item of the table."""
        hot = F.when(F.col("n_raw") > self.hot_above, self.hot_bit).otherwise(0)
        return (F.col("id") * 2 + bit.cast("long") + hot).cast(self.kind)

    def number(self, held: str) -> Column:
        return F.shiftright(F.col(held).bitwiseAND(F.lit(self.hot_bit - 1).cast(self.kind)), 1)

    def is_hot(self, held: str) -> Column:
        return F.col(held) >= F.lit(self.hot_bit).cast(self.kind)

    def item_type(self, number: str) -> Column:
        found = F.lit(None).cast("string")
        for row in reversed(self.types):
            found = F.when(F.col(number) <= row.last, F.lit(row.item_type)).otherwise(found)
        return found

    def lookup(self, *columns: str | Column) -> DataFrame:
        picked = self.table.select(*columns)
        return F.broadcast(picked) if self.count <= LOOKUP_ROWS else picked


def pair_slices(cells: DataFrame, unit: Sequence[str], numbers: NumberedItems, slices: int | None = None) -> Iterator[DataFrame]:
    """All pairs of stored cells, slice by slice: unit columns, item_a and item_b as held in units, and router and partner, their numbers.

    A slice has all pairs of some smaller items. Those of one router are dealt to one task as arrays of its partners,
    so that groupings by router and partner move nothing; tasks count about ``PAIRS_IN_TASK`` pairs. Two hot items
    are a slice of their own, which is left to be combined before it moves. Without ``slices`` there are as many as keep
    about ``PAIRS_AT_ONCE`` pairs on the way.
    """
    n = F.size("_items").cast("long")
    here = F.when(F.col("_ci") == F.col("_cj"), n * (n - 1) / 2).otherwise(n * n / 4)
    pairs = int(cells.agg(F.sum(here)).first()[0] or 0)
    slices = min(-(-pairs // PAIRS_AT_ONCE) or 1, SLICES) if slices is None else slices
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // slices // PAIRS_IN_TASK))
    spread = unit_partners(cells, unit).withColumn("router", numbers.number("item_a"))

    def opened(rows: DataFrame) -> DataFrame:
        return rows.select(*unit, "item_a", "router", F.explode("partners").alias("item_b")).withColumn("partner", numbers.number("item_b"))

    cold = spread.where(~numbers.is_hot("item_a") & (F.size("partners") > 0))
    for k in range(slices):
        yield opened(cold.where(F.pmod(F.xxhash64("router"), F.lit(slices)) == k).repartition(tasks, "router"))
    yield opened(spread.where(numbers.is_hot("item_a")))


def _counted_parts(sets: DataFrame, p: Params, floor: int | None, slices: int | None) -> tuple[Iterator[DataFrame], NumberedItems]:
    """(item_type, a, b, n_ab) of all pairs, slice by slice, and the numbered items; rare items are dropped before pairing."""
    floor = p.floor_item if floor is None else floor
    numbers = NumberedItems(marginals(sets).where(F.col("n_raw") >= floor))
    unit = ("unit_id", "item_type")
    rows = sets.join(numbers.lookup("item_type", "item", "id", "n_raw"), ["item_type", "item"]).select(
        *unit, numbers.held(F.lit(0)).alias("item"))
    cells = settle(unit_cells(rows, unit, p))
    parts = (part.groupBy("router", "partner").agg(F.count(F.lit(1)).alias("n_ab")).select(
        F.least("router", "partner").alias("a"), F.greatest("router", "partner").alias("b"), "n_ab").select(
        numbers.item_type("a").alias("item_type"), "*") for part in pair_slices(cells, unit, numbers, slices))
    return parts, numbers


def pair_counts(sets: DataFrame, p: Params = Params(), floor: int | None = None) -> DataFrame:
    """item_type, item_a, item_b, n_ab over all units; rare items are dropped before pairing."""
    parts, numbers = _counted_parts(sets, p, floor, 1)
    side = lambda s: numbers.lookup(F.col("id").alias(s), F.col("item").alias(f"item_{s}"))
    return reduce(DataFrame.unionByName, parts).join(side("a"), "a").join(side("b"), "b").select("item_type", "item_a", "item_b", "n_ab")


def pair_count_sizes(sets: DataFrame, p: Params = Params(), floor: int | None = None) -> DataFrame:
    """:func:`pair_counts` folded by type and n_ab: n_pairs, last_a, first_b. No more than a slice of the pairs is on the way."""
    parts, numbers = _counted_parts(sets, p, floor, None)
    folds = []
    for part in parts:
        folds.append(settle(part.groupBy("item_type", "n_ab").agg(
            F.count(F.lit(1)).alias("n_pairs"), F.max("a").alias("a"), F.min("b").alias("b"))))
        let_go(sets.sparkSession)
    # numbers are in the byte order of the items
    whole = reduce(DataFrame.unionByName, folds).groupBy("item_type", "n_ab").agg(
        F.sum("n_pairs").alias("n_pairs"), F.max("a").alias("a"), F.min("b").alias("b"))
    side = lambda s, name: numbers.lookup(F.col("id").alias(s), F.col("item").alias(name))
    return whole.join(side("a", "last_a"), "a").join(side("b", "first_b"), "b").select("item_type", "n_ab", "n_pairs", "last_a", "first_b")


def canonical_pairs(forced: Sequence[tuple[str, str, str]], spark) -> DataFrame:
    """The listed (item_type, item, item) with the smaller item (byte order) first."""
    rows = [(t, *sorted((a, b), key=lambda s: s.encode())) for t, a, b in forced]
    return spark.createDataFrame(rows, "item_type string, item_a string, item_b string").distinct()


def _section_rank(sets: DataFrame, items: DataFrame, names: DataFrame):
    """How to pack (count, first unit, section code) into one orderable number, and to read the code back.

    Highest count first, then lowest unit id. One number keeps the aggregation a hash aggregate; a struct would force a
    sort. Every field is as wide as the data make it; the number is a LONG where that is wide enough and a DECIMAL(38)
    otherwise, of the same value. Data that do not fit even there are refused, never folded into each other.
    """
    u = sets.agg(F.min("unit_id").alias("low"), F.max("unit_id").alias("high")).first()  # single numbers
    n, k = items.agg(F.max("n_raw")).first()[0] or 1, names.agg(F.max("code")).first()[0] or 1
    low, high = (u.low, u.high) if u.low is not None else (0, 0)
    units, codes = high - low + 1, k + 1
    needed = (n + 1) * units * codes
    if needed >= 10**38:
        raise ValueError(f"ranks of sections need {needed} values, more than 38 digits hold")
    kind = "bigint" if needed < 2**63 else "decimal(38,0)"

    def number(value):
        return F.lit(Decimal(value)).cast(kind) if isinstance(value, int) else value.cast(kind)

    def pack(count, unit, code):
        behind = number(high) - number(unit)
        return ((number(count) * number(units)).cast(kind) + behind).cast(kind) * number(codes) + number(code)

    return lambda *fields: pack(*fields).cast(kind), lambda c: F.pmod(c, number(codes)).cast("long")


class PairParts:
    """The joint counts of all pairs of items that are wanted, both variants in one pass, slice by slice."""

    def __init__(self, sets: DataFrame, wanted: DataFrame, first_units: DataFrame | None, p: Params) -> None:
        # Items and sections get numbers: fewer bytes per pair, and item numbers follow byte order, so
        # the smaller number is the smaller item. Both tables are stored, so every use sees the same numbers.
        self.p, self.numbers = p, NumberedItems(wanted)
        self.names = settle(with_global_rank(sets.select("section").distinct(), [F.col("section")], "code"))
        # The bit below an item's number says whether it is left in the reduced variant, so a unit's
        # items are one array of numbers; what belongs to the whole unit rides in the unit key.
        rows = sets.join(self.numbers.lookup("item_type", "item", "id", "n_raw"), ["item_type", "item"]).join(self.names, "section").select(
            "unit_id", "item_type", "code", self.numbers.held(F.col("in_reduced")).alias("item"))
        self.unit = ("unit_id", "item_type", "code", "first")
        lists = unit_cells(rows, self.unit[:3], p)
        if first_units is not None:
            # a unit that is listed several times has its items as often
            marks = first_units.groupBy("unit_id").agg(F.count(F.lit(1)).cast("int").alias("_mark"))
            often = F.sort_array(F.flatten(F.array_repeat("_items", F.col("_mark"))))
            lists = lists.join(marks, "unit_id", "left").withColumns({
                "first": F.col("_mark").isNotNull(), "_items": F.when(F.col("_mark") > 1, often).otherwise(F.col("_items"))}).drop("_mark")
        else:
            lists = lists.withColumn("first", F.lit(False))
        self.cells = settle(lists)
        self.rank, self.code_of = _section_rank(sets, self.numbers.table, self.names)

    def counted(self, slices: int | None = None) -> Iterator[DataFrame]:
        """a, b and their counts: numbers only, a few bytes a pair when stored."""
        both = F.col("item_a").bitwiseAND(F.col("item_b")).bitwiseAND(F.lit(1)) == 1
        one, rank = F.lit(1), self.rank
        for pairs in pair_slices(self.cells, self.unit, self.numbers, slices):
            # numeric aggregates only, so that both steps stay hash aggregates
            per_section = pairs.groupBy("router", "partner", "code").agg(
                F.count(one).alias("c_raw"),
                F.count(F.when(both, 1)).alias("c_red"),
                F.count(F.when(both & F.col("first"), 1)).alias("c_first"),
                F.min("unit_id").alias("u_raw"),
                F.min(F.when(both, F.col("unit_id"))).alias("u_red"))
            folded = per_section.groupBy("router", "partner").agg(
                F.sum("c_raw").alias("c_raw"), F.sum("c_red").alias("c_red"), F.sum("c_first").alias("c_first"),
                F.max("c_raw").alias("m_raw"), F.max("c_red").alias("m_red"),
                F.max(rank(F.col("c_raw"), F.col("u_raw"), F.col("code"))).alias("t_raw"),
                F.max(F.when(F.col("c_red") > 0, rank(F.col("c_red"), F.col("u_red"), F.col("code")))).alias("t_red"))
            yield folded.select(
                F.least("router", "partner").alias("a"), F.greatest("router", "partner").alias("b"), "c_raw", "c_red", "c_first",
                "m_raw", "m_red", self.code_of(F.col("t_raw")).alias("k_raw"), self.code_of(F.col("t_red")).alias("k_red"))

    def rows(self, counted: DataFrame) -> DataFrame:
        """One row per pair and variant: item_type, variant, a, b, n_a, n_b, n_ab, n_ab_first_instance, code, top_share."""
        side = lambda s: self.numbers.lookup(
            F.col("id").alias(s), F.col("n_raw").alias(f"n_raw_{s}"), F.col("n_reduced").alias(f"n_reduced_{s}"))
        folded = counted.join(side("a"), "a").join(side("b"), "b")
        zero = F.lit(0).cast("long")

        def variant(name, a, b, n, first, top, best):
            return F.struct(
                F.lit(name).alias("variant"), F.col(a).alias("n_a"), F.col(b).alias("n_b"), F.col(n).alias("n_ab"),
                first.alias("n_ab_first_instance"), F.col(top).alias("code"),
                (F.col(best) / F.greatest(F.col(n), F.lit(1))).alias("top_share"))

        return folded.select(self.numbers.item_type("a").alias("item_type"), "a", "b", F.inline(F.array(
            variant(RAW, "n_raw_a", "n_raw_b", "c_raw", zero, "k_raw", "m_raw"),
            variant(REDUCED, "n_reduced_a", "n_reduced_b", "c_red", F.col("c_first"), "k_red", "m_red"),
        ))).where("n_ab > 0")

    def above(self) -> Column:
        return (F.col("n_a") >= self.p.floor_item) & (F.col("n_b") >= self.p.floor_item)

    def sections(self) -> DataFrame:
        return self.names.withColumnRenamed("section", "top_section")


def pair_rows(
    sets: DataFrame,
    first_units: DataFrame | None = None,
    p: Params = Params(),
    forced: Sequence[tuple[str, str, str]] = (),
) -> DataFrame:
    """Joint counts of every reportable pair, one row per variant.

    Columns: item_type, variant, item_a, item_b, n_a, n_b, n_ab, n_ab_first_instance,
    top_section, top_share. Both variants come out of one pairing pass.
    """
    spark = sets.sparkSession
    counts = marginals(sets)
    wanted = counts.where(F.col("n_raw") >= p.floor_item)
    if forced:
        listed = canonical_pairs(forced, spark)
        ends = listed.select("item_type", F.col("item_a").alias("item")).unionByName(
            listed.select("item_type", F.col("item_b").alias("item"))).distinct()
        rare = counts.where(F.col("n_raw") < p.floor_item).join(F.broadcast(ends), ["item_type", "item"], "left_semi")
        wanted = wanted.unionByName(rare)

    parts = PairParts(sets, wanted, first_units, p)
    named = lambda s: parts.numbers.lookup(F.col("id").alias(s), F.col("item").alias(f"item_{s}"))
    long_rows = parts.rows(reduce(DataFrame.unionByName, parts.counted(1))).join(named("a"), "a").join(named("b"), "b").drop("a", "b")
    if forced:
        # `listed` is the caller's literal list
        tagged = long_rows.join(
            F.broadcast(listed.withColumn("_listed", F.lit(True))), ["item_type", "item_a", "item_b"], "left")
        kept = settle(tagged.where(parts.above() | F.col("_listed").isNotNull()).drop("_listed"))
        kept = kept.unionByName(_absent_pairs(listed, kept, counts, ends))
    else:
        kept = long_rows.where(parts.above())
    return kept.join(parts.sections(), "code", "left").select(
        "item_type", "variant", "item_a", "item_b", "n_a", "n_b", "n_ab", "n_ab_first_instance", "top_section", "top_share")


def _absent_pairs(listed: DataFrame, kept: DataFrame, counts: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows with n_ab = 0 for listed pairs that never occur in a variant."""
    variants = listed.select("*", F.explode(F.array(F.lit(RAW), F.lit(REDUCED))).alias("variant"))
    missing = variants.join(kept, ["item_type", "variant", "item_a", "item_b"], "left_anti")
    known = counts.join(F.broadcast(ends), ["item_type", "item"], "left_semi")

    def side(s: str) -> DataFrame:
        return known.select("item_type", F.col("item").alias(f"item_{s}"),
                            F.col("n_raw").alias(f"r_{s}"), F.col("n_reduced").alias(f"f_{s}"))

    zero = F.lit(0).cast("long")
    n = lambda s: F.coalesce(F.when(F.col("variant") == RAW, F.col(f"r_{s}")).otherwise(F.col(f"f_{s}")), zero)
    filled = missing.join(side("a"), ["item_type", "item_a"], "left").join(side("b"), ["item_type", "item_b"], "left")
    return filled.select(
        "item_type", "item_a", "item_b", "variant", n("a").alias("n_a"), n("b").alias("n_b"), zero.alias("n_ab"),
        zero.alias("n_ab_first_instance"), F.lit(None).cast("long").alias("code"),
        F.lit(None).cast("double").alias("top_share"))


def with_statistics(pairs: DataFrame, p: Params = Params()) -> DataFrame:
    """Expected count, PMI, G2, exact p and family membership (needs n_a, n_b, n_ab, n_total)."""
    a, b, ab, n = (F.col(c) for c in ("n_a", "n_b", "n_ab", "n_total"))
    member = (a >= p.floor_item) & (b >= p.floor_item) & (ab >= p.floor_cooc)
    scored = pairs.withColumn("expected", st.expected(a, b, n)).select(
        "*", st.pmi(ab, F.col("expected")).alias("pmi"), st.g2(ab, a, b, n).alias("g2"), member.alias("in_family"))
    return scored.withColumn("p", st.hypergeom_sf(ab, a, b, n))


def collocation_table(
    tokens: DataFrame,
    item_columns: Mapping[str, str],
    ranges: DataFrame | None = None,
    first_units: DataFrame | None = None,
    p: Params = Params(),
    forced: Sequence[tuple[str, str, str]] = (),
) -> DataFrame:
    """The pair table for both variants and all item types, with FDR flags."""
    flagged = flag_masked(tokens, ranges)
    sets = settle(item_sets(item_occurrences(flagged, item_columns)))
    return collocations_of(sets, unit_scopes(flagged), first_units, p, forced)


def collocations_of(
    sets: DataFrame,
    scopes: DataFrame,
    first_units: DataFrame | None = None,
    p: Params = Params(),
    forced: Sequence[tuple[str, str, str]] = (),
) -> DataFrame:
    """The pair table from stored item sets and the variants' scopes."""
    pairs = pair_rows(sets, first_units, p, forced)
    # one row per item type and variant, one row per variant: safe to broadcast
    totals, scopes = F.broadcast(unit_totals(sets)), F.broadcast(scopes)
    scored = settle(with_statistics(
        pairs.join(totals, ["item_type", "variant"]).join(scopes, "variant"), p))
    return benjamini_hochberg(scored, ["variant", "item_type"], p.fdr_q)


def folded_collocations(
    sets: DataFrame,
    scopes: DataFrame,
    first_units: DataFrame | None,
    folds: Mapping[str, tuple[str, str]],
    p: Params = Params(),
) -> DataFrame:
    """:func:`collocations_of` folded by variant, type and first item, with n_significant, the pairs flagged in each.

    ``folds`` has per column the SQL of an aggregate over rows of the pair table and the function that merges such aggregates.
    The table has many times the bytes of the sets, so it is made, scored and folded slice by slice. All p values have to be
    known before any pair is flagged: of every item the counts of its tests stay, with the number of pairs that have them.
    """
    spark, family = sets.sparkSession, ["variant", "item_type"]
    totals, scopes = settle(unit_totals(sets)), settle(scopes)
    parts = PairParts(sets, marginals(sets).where(F.col("n_raw") >= p.floor_item), first_units, p)
    folded, tests = [], []
    for part in parts.counted():
        counted = settle(part)
        let_go(spark)
        rows = parts.rows(counted).where(parts.above()).join(parts.sections(), "code", "left")
        # one row per item type and variant, one row per variant: safe to broadcast
        scored = with_statistics(rows.join(F.broadcast(totals), family).join(F.broadcast(scopes), "variant"), p)
        folded.append(settle(scored.groupBy(*family, "a").agg(*[F.expr(made).alias(name) for name, (made, _) in folds.items()])))
        # p follows from the counts, which are smaller; in order they take about half the bytes
        tests.append(settle(scored.where("in_family").groupBy(*family, "a", "n_a", "n_b", "n_ab").agg(
            F.count(F.lit(1)).alias("n")).sortWithinPartitions(*family, "a", "n_b", "n_ab")))
        unsettle(counted)
        let_go(spark)
    again = with_statistics(reduce(DataFrame.unionByName, tests).join(F.broadcast(totals), family), p)
    limits = significance_limits(again.select(*family, "p", "n"), family, p.fdr_q)
    found = again.join(F.broadcast(limits), family).where(F.col("p") <= F.col("_p_limit")).groupBy(*family, "a").agg(
        F.sum("n").alias("n_significant"))
    merged = reduce(DataFrame.unionByName, folded).groupBy(*family, "a").agg(
        *[F.expr(f"{merge}({name})").alias(name) for name, (_, merge) in folds.items()])
    return merged.join(found, [*family, "a"], "left").join(
        parts.numbers.lookup(F.col("id").alias("a"), "item"), "a").drop("a").fillna(0, ["n_significant"])


def family_sizes(table: DataFrame) -> DataFrame:
    """Tests per FDR family, with the number found significant."""
    return table.groupBy("variant", "item_type").agg(
        F.count(F.when(F.col("in_family"), 1)).alias("family_size"),
        F.count(F.when(F.col("fdr_significant"), 1)).alias("n_significant"))
