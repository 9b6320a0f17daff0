"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item is cut into windows of ``width`` consecutive words; a window is the set of its placed shingles (``SHINGLE`` words
each). A stretch of a document is an occurrence of a window if it has as many words and shares at least ``percent`` of
the shingles, place by place. Then at least one of the window's ``n - need + 1`` rarest shingles is shared, so only these
prefix shingles are joined; the place of a shingle in the window fixes where the occurrence would begin, which the bounds
of the text must allow; what is left is compared word by word.

The texts are read twice and never shuffled. The first pass counts the windows' shingles in all documents, which gives
the order of rarity; the second writes, per document, the places of prefix shingles with the words around them. In both
a fixed bit table drops nearly all places before they become rows; it is a filter alone, the join decides.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.session import settle, with_global_rank

WIDTH = 10              # words of a window
SHINGLE = 3             # words of a shingle; a shorter window is one shingle
MOST_BITS = 21          # the bit table has at most 2**21 places, 32,768 numbers, whatever the benchmark's size
SMALL = 100_000         # windows up to which their table is sent to every task; beyond, both sides are shuffled
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, also where a lambda of ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _shingles(words: Column, size: int) -> Column:
    """Hash of every ``size`` consecutive words."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(size), *[words[i + j] for j in range(size)]))


class _Bits:
    """Which hashes may be wanted: one bit per hash value's leading bits, sized by the number of hashes."""

    def __init__(self, hashes: DataFrame) -> None:
        count = hashes.count()
        self.bits = min(max((64 * count).bit_length(), 10), MOST_BITS)
        place = F.shiftrightunsigned("h", 64 - self.bits)
        rows = hashes.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).alias("bit")).distinct()
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int"))
        # at most 2**MOST_BITS / 64 rows, whatever the input
        found = {r.word: r.mask for r in rows.groupBy("word").agg(F.bit_or(mask).alias("mask")).collect()}
        table = ",".join(str(found.get(i, 0)) for i in range(1 << (self.bits - 6)))
        self.table = F.split(F.lit(table), ",").cast("array<bigint>")       # folded into a literal before execution

    def has(self, h: Column) -> Column:
        place = F.shiftrightunsigned(h, 64 - self.bits)
        return F.getbit(self.table[F.shiftright(place, 6).cast("int")], place.bitwiseAND(F.lit(63)).cast("int")) == 1


def _places(words: Column, sizes: list[int], bits: _Bits) -> Column:
    """(size, at, h) of every shingle of the text that may be wanted."""
    found = [F.array_compact(F.transform(_shingles(words, size), lambda h, i: F.when(
        bits.has(h), F.struct(F.lit(size).alias("size"), i.alias("at"), h.alias("h"))))) for size in sizes]
    return F.concat(*found)


def _overlap(left: Column, right: Column, size: Column) -> Column:
    """How many shingles two word sequences of one length share place by place."""
    at = F.sequence(F.lit(0), F.size(right) - size)
    return F.size(F.filter(at, lambda i: F.slice(left, i + 1, size) == F.slice(right, i + 1, size)))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", width: int = WIDTH, percent: int = 100) -> DataFrame:
    """One row (key, n_words, n_hit, n_items, items, contaminated) per row of ``docs``.

    n_hit counts the words that lie in an occurrence of a window; items are the ids, as sorted strings, of the items
    with an occurring window, n_items their number. An item of fewer than ``width`` words, but not none, is one window.
    With ``percent`` 100 an occurrence is the window's word sequence itself; below, ``percent`` of its shingles suffice.
    Null and empty texts have no words; items without words have no windows. An item without id makes hits, but is not
    named. Repeated items count once, repeated documents give repeated rows, extra columns of either table are ignored.
    An empty benchmark contaminates nothing.
    """
    cut = items.select(F.col(item_key).cast("string").alias("item"), word_array(F.col(item_text)).alias("words")).where(
        F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    owned = settle(cut.select("item", F.explode(F.transform(
        starts, lambda i: F.slice("words", i + 1, F.lit(width)))).alias("window")).distinct())
    windows = with_global_rank(owned.select("window").distinct(), [F.col("window")], "window_id")
    windows = settle(windows.withColumn("size", F.least(F.size("window"), F.lit(SHINGLE))))
    owners = settle(owned.join(windows, "window").where("item is not null").select("window_id", "item"))
    n_windows = windows.count()
    near = F.broadcast if n_windows <= SMALL else (lambda table: table)
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())      # at most SHINGLE numbers

    own = F.lit(None).cast("array<bigint>")
    for size in sizes:
        own = F.when(F.col("size") == size, _shingles(F.col("window"), size)).otherwise(own)
    tokens = settle(windows.select("window_id", F.posexplode(own).alias("off", "h")))
    keyed = docs.select(
        F.xxhash64(key, text).alias("row_a"), F.xxhash64(F.lit(1), text, key).alias("row_b"), F.col(key).alias("key"),
        F.col(text).alias("text"))
    words = word_array(F.col("text"))

    # first pass: how often each wanted shingle occurs in all documents
    wanted = settle(tokens.select("h").distinct())
    bits = _Bits(wanted)
    seen = keyed.select(F.explode(let(words, lambda w: _places(w, sizes, bits))["h"]).alias("h")) if sizes else wanted
    common = seen.join(near(wanted), "h").groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(common, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    in_window = Window.partitionBy("window_id")       # at most ``width`` rows each
    count = F.count(F.lit(1)).over(in_window)
    need = F.ceil(count * percent / 100)
    turn = F.row_number().over(in_window.orderBy("df", "h", "off"))
    prefix = settle(
        ranked.select("window_id", "off", "h", "df", need.alias("need"), (count - need + 1).alias("long"), turn.alias("turn"))
        .where("turn <= long and df > 0").join(windows, "window_id").select("window_id", "off", "h", "need", "window", "size"))

    # second pass: places of prefix shingles with the words that an occurrence could reach
    bits = _Bits(prefix.select("h").distinct())

    def around(w: Column) -> Column:
        first = lambda p: F.greatest(p["at"] - (width - 1), F.lit(0))       # noqa: E731
        return F.transform(_places(w, sizes, bits), lambda p: F.struct(
            p["h"].alias("h"), p["at"].alias("at"), first(p).alias("from"),
            F.slice(w, first(p) + 1, F.lit(2 * width - 1)).alias("around")))

    places = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), around(w).alias("places"))) if sizes else (
        F.struct(F.size(words).cast("long").alias("n_words"),
                 F.array().cast("array<struct<h:bigint,at:int,from:int,around:array<string>>>").alias("places")))
    stored = settle(keyed.select("row_a", "row_b", "key", places.alias("p")).select("row_a", "row_b", "key", "p.*"))

    begin, length = F.col("at") - F.col("off"), F.size("window")
    stretch = F.slice("around", begin - F.col("from") + 1, length)
    fits = (begin >= 0) & (begin + length <= F.col("n_words"))
    candidates = stored.select("row_a", "row_b", "n_words", F.explode("places").alias("s")).select(
        "row_a", "row_b", "n_words", "s.*").join(near(prefix), "h").where(fits)
    same = stretch == F.col("window") if percent == 100 else (
        _overlap(stretch, F.col("window"), F.col("size")) >= F.col("need"))
    hits = candidates.where(same).select("row_a", "row_b", "window_id", F.struct(
        begin.alias("low"), (begin + length).alias("high")).alias("span"))
    # one document's occurrences meet: no more than its words, times the few lengths of windows
    covered = F.aggregate(
        F.sort_array("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["high"] - F.greatest(s["low"], a["reach"]), F.lit(0))).alias("n"),
            F.greatest(a["reach"], s["high"]).alias("reach")), lambda a: a["n"])
    marked = settle(
        hits.groupBy("row_a", "row_b").agg(
            F.collect_set("span").alias("spans"), F.sort_array(F.collect_set("window_id")).alias("found"))
        .select("row_a", "row_b", covered.alias("n_hit"), "found",
                F.xxhash64("found").alias("set_a"), F.xxhash64(F.lit(1), "found").alias("set_b")))
    # documents with the same windows have the same items: copies of a passage are looked up once
    named = (
        marked.select("set_a", "set_b", "found").dropDuplicates(["set_a", "set_b"])
        .select("set_a", "set_b", F.explode("found").alias("window_id")).join(owners, "window_id")
        .groupBy("set_a", "set_b").agg(F.sort_array(F.collect_set("item")).alias("items")))
    results = marked.select("row_a", "row_b", "n_hit", "set_a", "set_b").join(
        settle(named), ["set_a", "set_b"], "left").select("row_a", "row_b", "n_hit", "items")
    out = stored.select("row_a", "row_b", "key", "n_words").join(results, ["row_a", "row_b"], "left")
    named_items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(named_items).cast("long").alias("n_items"), named_items.alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"))
