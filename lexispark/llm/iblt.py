"""Document fingerprints as invertible Bloom lookup tables over paragraphs, in DataFrame functions only.

A paragraph is a line that has a character other than white space; a text is the set of its paragraphs' 64-bit
digests. A table has three parts of ``size`` cells; a digest goes into one cell of each part, and a cell keeps how many
digests it got, the XOR of them and the XOR of their check hashes. Tables of two texts subtract cell by cell, what both
have cancels out. A cell left with one digest gives it away (its check hash proves it); taking it out of its other cells
lays bare more. If cells are left over at the end, the same is tried with larger tables, and after the largest the sets
are compared directly.

Tables are kept as the sorted list of their non-empty cells, so every step costs one sort of what is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.target_ratio import let
from lexispark.session import settle, with_global_rank

SIZE = 8            # cells of a part of the smallest table
TRIES = 12          # sizes tried from the first that could do, each twice (for differences four times) the one before
ROUNDS = 40         # peeling rounds, far above what a table that can be peeled needs

_KEYS = "array<bigint>"


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs; a null text has none."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"\S"))
    return F.array_distinct(F.transform(lines, lambda line: F.xxhash64(line)))


def _entries(key: Column, count: Column, size: Column) -> Column:
    """What one digest adds to its three cells; cells are numbered through all parts."""
    return F.array(*[F.struct(
        (F.pmod(F.xxhash64(key, F.lit(part)), size) + size * part).cast("long").alias("cell"),
        count.cast("long").alias("n"), key.alias("k"), F.xxhash64(key, F.lit(7)).alias("c")) for part in range(3)])


def _merge(entries: Column) -> Column:
    """Entries of equal cells in one, cells that hold nothing left out."""
    def runs(e: Column) -> Column:
        starts = F.filter(F.transform(e, lambda x, i: F.when(
            (i == 0) | (F.get(e, i - 1)["cell"] != x["cell"]), i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda at, j: let(
            F.slice(e, at + 1, F.coalesce(F.get(s, j + 1), F.size(e)) - at), lambda own: F.when(
                F.size(own) == 1, own[0]).otherwise(F.struct(
                    own[0]["cell"].alias("cell"), F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"),
                    F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x["k"])).alias("k"),
                    F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x["c"])).alias("c"))))))

    merged = let(F.sort_array(entries), runs)
    return F.filter(merged, lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))


def table(keys: Column, size: Column) -> Column:
    return _merge(F.flatten(F.transform(keys, lambda k: _entries(k, F.lit(1), size))))


def subtract(left: Column, right: Column) -> Column:
    return _merge(F.concat(left, F.transform(right, lambda x: F.struct(
        x["cell"].alias("cell"), (-x["n"]).alias("n"), x["k"].alias("k"), x["c"].alias("c")))))


def peel(cells: Column, size: Column) -> Column:
    """(cells left, digests only in the first text, digests only in the second); nothing left means success."""
    start = F.struct(cells.alias("cells"), F.array().cast(_KEYS).alias("mine"), F.array().cast(_KEYS).alias("theirs"),
                     F.lit(True).alias("moving"))

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["c"] == F.xxhash64(x["k"], F.lit(7))))
        found = F.array_distinct(F.transform(pure, lambda x: F.struct(x["k"].alias("k"), x["n"].alias("n"))))
        return F.when(~state["moving"], state).otherwise(let(found, lambda f: F.struct(
            F.when(F.size(f) == 0, state["cells"]).otherwise(_merge(F.concat(state["cells"], F.flatten(F.transform(
                f, lambda x: _entries(x["k"], -x["n"], size)))))).alias("cells"),
            F.concat(state["mine"], F.transform(F.filter(f, lambda x: x["n"] == 1), lambda x: x["k"])).alias("mine"),
            F.concat(state["theirs"], F.transform(F.filter(f, lambda x: x["n"] == -1), lambda x: x["k"])).alias("theirs"),
            (F.size(f) > 0).alias("moving"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _steps(count: Column, base: int) -> Column:
    """Exponents of ``TRIES`` growing sizes ``SIZE`` * ``base`` ** j, the first with at least ``count`` cells."""
    first = F.greatest(F.ceil(F.log(float(base), F.greatest(count, F.lit(1)) / (3.0 * SIZE)) - 1e-9), F.lit(0)).cast("int")
    return F.sequence(first, first + TRIES - 1)


def _sized(step: Column, base: int) -> Column:
    return F.round(F.lit(SIZE) * F.pow(F.lit(float(base)), step.cast("double"))).cast("long")


def difference(mine: Column, theirs: Column, sizes: tuple[int, ...] | None = None) -> Column:
    """(mine, theirs, size): digests that only one text has, and the table size that gave them.

    Sizes grow from the least that the numbers of digests allow until peeling ends. With ``sizes`` only those are tried;
    if none of the sizes does (which without ``sizes`` takes digests that share all cells of ever larger tables), size is
    null and the digests are compared directly.
    """
    start = F.struct(F.lit(None).cast(_KEYS).alias("mine"), F.lit(None).cast(_KEYS).alias("theirs"),
                     F.lit(None).cast("long").alias("size"))

    def attempt(state: Column, size: Column) -> Column:
        peeled = peel(subtract(table(mine, size), table(theirs, size)), size)
        return F.when(state["size"].isNotNull(), state).otherwise(let(peeled, lambda p: F.when(
            F.size(p["cells"]) == 0, F.struct(p["mine"].alias("mine"), p["theirs"].alias("theirs"), size.alias("size")))
            .otherwise(state)))

    least = F.abs(F.size(mine) - F.size(theirs))        # at least so many digests differ
    tried = F.array(*[F.lit(s).cast("long") for s in sizes]) if sizes else F.transform(_steps(least, 4), lambda j: _sized(j, 4))
    found = F.aggregate(tried, start, attempt)
    return let(found, lambda t: F.when(t["size"].isNotNull(), t).otherwise(F.struct(
        F.array_except(mine, theirs).alias("mine"), F.array_except(theirs, mine).alias("theirs"), t["size"].alias("size"))))


def likeness(keys: Column, diff: Column) -> Column:
    """Shared paragraphs over all paragraphs of both texts; 1 if neither has any."""
    shared = F.size(keys) - F.size(diff["mine"])
    both = F.size(keys) + F.size(diff["theirs"])
    return F.when(both == 0, F.lit(1.0)).otherwise(shared / both)


def own_table(keys: Column) -> Column:
    """(size, cells) of the smallest table of a text that gives away all of its digests."""
    cell = "array<struct<cell:bigint,n:bigint,k:bigint,c:bigint>>"
    start = F.struct(F.lit(None).cast("long").alias("size"), F.lit(None).cast(cell).alias("cells"))

    def attempt(state: Column, step: Column) -> Column:
        return F.when(state["size"].isNotNull(), state).otherwise(let(_sized(step, 2), lambda size: let(
            table(keys, size), lambda cells: F.when(
                F.size(peel(cells, size)["cells"]) == 0, F.struct(size.alias("size"), cells.alias("cells"))).otherwise(state))))

    return F.aggregate(_steps(F.size(keys), 2), start, attempt)


def fingerprint(keys: Column) -> Column:
    """The stored table as text: number of paragraphs, size, then cell, count and XORs of every non-empty cell."""
    return let(own_table(keys), lambda t: F.concat(
        F.size(keys).cast("string"), F.lit("/"), t["size"].cast("string"), F.lit("/"),
        F.array_join(F.transform(t["cells"], lambda x: F.concat(
            x["cell"].cast("string"), F.lit(":"), x["n"].cast("string"), F.lit(":"), F.lower(F.hex(x["k"])),
            F.lit(":"), F.lower(F.hex(x["c"])))), ";")))


def next_in_order(heads: DataFrame) -> DataFrame:
    """(id, next): the id of the next smaller key, after the smallest the largest; a null key counts as the smallest."""
    ranked = settle(with_global_rank(heads.select("key", "id"), [F.col("key").asc_nulls_first()], "rank"))
    last = ranked.agg(F.max("rank")).first()[0]
    wanted = F.when(F.col("rank") == 1, F.lit(last)).otherwise(F.col("rank") - 1)
    return ranked.select("id", wanted.alias("place")).join(
        ranked.select(F.col("id").alias("next"), F.col("rank").alias("place")), "place").select("id", "next")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its key and fingerprint, those of its edited text, and what differs.

    The edited text keeps the first half of the code points and goes on with as many from the start of the next document
    (the next smaller key). Null texts are empty. Rows with one key share its next document; as a next document a
    repeated key stands for its row with the smallest text hash. A single row is its own next document. An empty table
    gives an empty table; other columns are not read.
    """
    # keys are joined in a form that is never null; both joins read the same two columns, so they share one exchange
    own = docs.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("id"),
                      F.coalesce(F.col(text), F.lit("")).alias("text"))
    real_key = F.when(F.col("id") != "", F.substr(F.col("id"), F.lit(2)).cast(docs.schema[key].dataType))
    heads = settle(own.groupBy("id").agg(
        F.max(F.length("text")).alias("n"), F.min(F.xxhash64("text")).alias("hash")).withColumn("key", real_key))
    if heads.isEmpty():
        order = heads.select("id", F.col("id").alias("next"))
    else:
        order = next_in_order(heads)
    half = F.floor(F.col("n") / 2).cast("int")
    asked = heads.select("id", half.alias("half")).join(order, "id").join(
        heads.select(F.col("id").alias("next"), "hash"), "next").select(F.col("id").alias("asker"), "next", "half", "hash")
    # written so that it stays a filter and no join key: the exchange is then that of the second join
    shown = F.xxhash64("text").bitwiseXOR(F.col("hash")) == 0
    sent = own.join(asked.hint("merge"), own["id"] == asked["next"]).where(shown).select(
        "asker", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("start"), digests(F.col("text")).alias("next_keys"))
    received = sent.groupBy("asker").agg(F.first("start").alias("start"), F.first("next_keys").alias("next_keys"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("start"), F.lit(1), half))
    both = own.join(received.hint("merge"), own["id"] == received["asker"]).select(
        real_key.alias("key"), n.cast("long").alias("n_chars"), digests(F.col("text")).alias("keys"),
        edited.alias("edited"), "next_keys").withColumn("edited_keys", digests(F.col("edited")))
    parts = both.select("key", "n_chars", "keys", F.sha2("edited", 256).alias("edited_sha256"), "edited_keys", "next_keys")
    return parts.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", fingerprint(F.col("keys")).alias("fingerprint"),
        fingerprint(F.col("edited_keys")).alias("edited_fingerprint"),
        let(F.struct("keys", "edited_keys", "next_keys"), lambda s: F.struct(
            let(difference(s["keys"], s["edited_keys"]), lambda d: F.struct(
                likeness(s["keys"], d).alias("near"), d["size"].alias("size"), d["mine"].alias("gone"),
                d["theirs"].alias("come"))).alias("edited"),
            let(difference(s["keys"], s["next_keys"]), lambda d: F.struct(
                likeness(s["keys"], d).alias("near"), d["size"].alias("size"))).alias("next"))).alias("d"))
