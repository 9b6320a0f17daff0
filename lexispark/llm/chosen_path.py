"""Near-duplicate groups by a chosen-path set similarity join.

Equal shingle sets fall together first; what follows works on one representative per set. In each of ``trees``
independent trees a document goes down ``BRANCH`` branches per node. A branch is selected minwise over the whole set:
every tree has hash functions of its own for every level, each orders the document's tokens, and the smallest one names
the child together with the node. Documents of similarity s therefore stay together on a branch with probability s,
whatever else the node holds and however unequal the lengths are.

Small nodes are compared exhaustively. Nodes that stay large branch again. Where a child keeps most of its parent, the
node is one mass of near copies that branching cannot thin out. Its documents are dealt into blocks and compared inside
their block; components are settled then, and a mass that is one component by then is finished. In what is left, two
documents of different components meet if they share one of their rarest shingles, which all linked ones do; the largest
component of a mass needs no comparison with itself. So the work in a mass grows with its documents' shingles, while no
pair of different components that may be linked goes without comparison. All links are confirmed on full shingle sets.
Groups are connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.textkit import Joined, mix, span_hashes, text_chunks, window_hashes, word_spans
from lexispark.session import settle

TREES = 6
BRANCH = 2
SMALL = 24          # a node of at most so many documents is compared in one piece
DENSE = 0.5         # share of its parent from which a large node counts as one mass
BLOCK = 512         # documents of a block of such a mass, at most
BLOCK_TOKENS = 1 << 18      # about as many shingles are in a block, whatever the documents' lengths
DEPTH = 8           # levels after which a large node is compared in blocks, whatever its share

_ROW, _TEXT = "__near_row", "__near_text"
_FIELD = 5          # bits of a minimum kept for the quick test of a pair
_IN_LONG = 12       # such fields in one number
_WORDS = 20         # bits that name a word of the table of wanted sets: at most 2**20 rows, 64 bits each


def shingle_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and where each text's begin (one more at the end).

    A text of fewer than ``width`` words has its whole word sequence as one shingle, one without words has none.
    """
    joined = Joined(batch.column(1).to_pylist(), fold_ascii=True)
    starts, ends, first = word_spans(joined)
    words = span_hashes(joined.codes, starts, ends)
    counts = np.diff(first)
    text_of = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words))
    whole = at[at + width <= first[1:][text_of]] if len(words) else at
    brief = np.flatnonzero((counts > 0) & (counts < width))
    hashes = np.concatenate((window_hashes(words, width)[whole] if len(whole) else np.zeros(0, np.uint64),
                             span_hashes(words, first[:-1][brief], first[1:][brief])))
    text = np.concatenate((text_of[whole], brief))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    if len(hashes):
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]))
        hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(counts) + 1))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _minima(hashes: np.ndarray, lows: np.ndarray, which: int) -> np.ndarray:
    """Smallest value of each set under one of many hash functions."""
    salt = 0x9E3779B97F4A7C15 * (which + 1) & (2**64 - 1)
    odd = np.uint64((0xD6E8FEB86659FD93 + 2 * salt) & (2**64 - 1) | 1)
    return np.minimum.reduceat((hashes ^ np.uint64(salt)) * odd, lows)


def _describe(width: int, trees: int):
    """Per text: set size, a 128-bit name of the set, the minima at the roots, and those for the levels below."""
    below = trees * BRANCH * DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, _TEXT):
            hashes, bounds = shingle_sets(batch, width)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            lows = bounds[:-1][full]
            roots = np.zeros((len(sizes), trees * BRANCH), np.uint64)
            levels = np.zeros((len(sizes), below), np.int32)
            names = np.zeros((2, len(sizes)), np.uint64)
            if len(full):
                for i in range(trees * BRANCH):
                    roots[full, i] = _minima(hashes, lows, i)
                for i in range(below):
                    least = _minima(hashes, lows, trees * BRANCH + i)
                    levels[full, i] = (least ^ (least >> np.uint64(32))).astype(np.uint32).view(np.int32)
                names[0, full] = np.add.reduceat(mix(hashes, 1), lows)
                names[1, full] = np.add.reduceat(mix(hashes, 2), lows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes.astype(np.int64)),
                pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)),
                _lists(levels.ravel(), np.arange(len(sizes) + 1) * below),
                _lists(roots.view(np.int64).ravel(), np.arange(len(sizes) + 1) * trees * BRANCH),
            ], ["row", "n", "name_a", "name_b", "levels", "roots"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, _TEXT):
            hashes, bounds = shingle_sets(batch, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(hashes.view(np.int64), bounds)], ["rep", "tokens"])
    return run


def _agreeing(trees: int, percent: int, risk: float = 1e-9) -> int:
    """The most minima that a pair of just enough similarity shares with probability 1 - ``risk``."""
    count, share = _fields(trees), percent / 100
    below, least = 0.0, 0
    while least < count:
        below += comb(count, least) * share**least * (1 - share) ** (count - least)
        if below > risk:
            break
        least += 1
    return least


def _code(trees: int) -> Column:
    """A few bits of each of ``_fields(trees)`` minima: those of the roots and of some levels, in three numbers."""
    minima = [F.shiftrightunsigned(F.col("roots")[i], 7) for i in range(trees * BRANCH)]
    minima += [F.shiftrightunsigned(F.col("levels")[i], 7).cast("long") for i in range(_fields(trees) - len(minima))]
    mask = F.lit((1 << _FIELD) - 1).cast("long")
    codes = []
    for first in range(0, len(minima), _IN_LONG):
        code = F.lit(0).cast("long")
        for i, least in enumerate(minima[first:first + _IN_LONG]):
            code = code.bitwiseOR(F.shiftleft(least.bitwiseAND(mask), i * _FIELD))
        codes.append(code.alias(f"c{len(codes)}"))
    return F.struct(*codes)


def _fields(trees: int) -> int:
    return min(3 * _IN_LONG, trees * BRANCH * (DEPTH + 1))


def _quick(trees: int) -> Column:
    """How many of the minima of two documents agree, judged by a few bits of each."""
    mask, same = F.lit((1 << _FIELD) - 1).cast("long"), F.lit(0)
    for i in range(_fields(trees)):
        x = F.col("code")[f"c{i // _IN_LONG}"].bitwiseXOR(F.col("code_b")[f"c{i // _IN_LONG}"])
        same = same + F.when(F.shiftright(x, i % _IN_LONG * _FIELD).bitwiseAND(mask) == 0, 1).otherwise(0)
    return same


def _level(depth: int, trees: int) -> Column:
    """The minima that decide ``depth`` levels below the roots, tree by tree."""
    places = [t * BRANCH * DEPTH + BRANCH * (depth - 1) + j for t in range(trees) for j in range(BRANCH)]
    return F.array(*[F.col("levels")[p] for p in places])


def _chosen(branch: int) -> Column:
    """The child on one branch of a node."""
    return F.xxhash64(F.col("level")[F.col("tree") * BRANCH + branch], F.col("node"), F.lit(branch))


def _forest(percent: int):
    """Confirmed links between the documents of a cell that are not in one component yet, as a spanning forest."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        count = len(pdf)
        sizes = pdf["n"].to_numpy()
        tokens = np.concatenate([np.asarray(t, np.int64) for t in pdf["tokens"]])
        owner = np.repeat(np.arange(count), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        fresh = np.append(True, tokens[1:] != tokens[:-1])
        shared_by_some = ~(fresh & np.append(fresh[1:], True))      # what one document has alone is common to none
        tokens, owner = tokens[shared_by_some], owner[shared_by_some]
        column = np.cumsum(np.append(0, tokens[1:] != tokens[:-1]))[:len(tokens)]
        shared = np.zeros((count, count), np.float32)
        low = 0
        while low < len(tokens):                       # some thousand distinct tokens at a time
            high = int(np.searchsorted(column, column[low] + 4096))
            there = np.zeros((count, int(column[high - 1] - column[low]) + 1), np.float32)
            there[owner[low:high], column[low:high] - column[low]] = 1
            shared += there @ there.T
            low = high
        common = shared.astype(np.int64)
        linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        _, first, of = np.unique(pdf["component"].to_numpy(), return_index=True, return_inverse=True)
        parent = first[of].tolist()
        linked &= of[:, None] != of[None, :]

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        reps, found = pdf["rep"].to_numpy(), []
        for i, j in zip(*np.nonzero(np.triu(linked, 1))):
            a, b = top(int(i)), top(int(j))
            if a != b:
                parent[b] = a
                found.append((reps[i], reps[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for every node that has a link.

    Alternates the large-star and small-star steps on tables in the shared folder until nothing changes; a hot node is
    reduced before each shuffle.
    """
    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    def star(edges: DataFrame, keep: Column, self_too: bool) -> DataFrame:
        low = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        moved = edges.join(low, "a").where(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if self_too:
            moved = moved.unionByName(low.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    # stars point from the larger to the smaller id
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, F.col("b") > F.col("a"), False)
        edges = settle(star(large, F.lit(True), True))
    labels = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tokens_b"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(
        100 * common >= percent * (F.size("tokens_a") + F.size("tokens_b") - common)).select("a", "b")


def _in_cells(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links found inside cells; ``cells`` has node, i, j, rep, n and component. A merge join, whatever the input's size."""
    return cells.join(sets.hint("merge"), "rep").groupBy("node", "i", "j").applyInPandas(_forest(percent), "a long, b long")


def _wanted(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """The sets of ``reps`` and few others, so that the rest need not move.

    A table of bits tells them apart; it has ``2**_WORDS`` rows at most, whatever the input, so it may go to every task.
    """
    named = F.xxhash64("rep")
    word, bit = F.shiftrightunsigned(named, 64 - _WORDS), F.shiftrightunsigned(named, 58 - _WORDS).bitwiseAND(F.lit(63)).cast("int")
    held = reps.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy(
        "__word").agg(F.bit_or("bit").alias("__bits"))
    return sets.join(F.broadcast(held), word == F.col("__word")).where(F.getbit("__bits", bit) == 1).select(*sets.columns)


def _blocks(count: Column, weight: Column) -> Column:
    return F.greatest(F.ceil(count / BLOCK), F.ceil(weight / BLOCK_TOKENS), F.lit(1)).cast("int")


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node", "rep"), blocks).cast("int")


def _joined(groups: DataFrame, more: DataFrame) -> DataFrame:
    """Components after links found later."""
    edges = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return settle(components(settle(edges.unionByName(more))))


def _unfinished(mass: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of the masses with their components, and the masses that have more than one, with the largest of each."""
    held = settle(mass.select("node", "rep", "n").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "node", "rep", "n", F.coalesce("component", "rep").alias("component")))
    shares = held.groupBy("node", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    return held, settle(shares.groupBy("node").agg(
        F.max(F.struct("size", "weight", "component")).alias("main"), F.count(F.lit(1)).alias("parts"),
        F.sum("size").alias("size"), F.sum("weight").alias("weight")).where("parts > 1"))


def _sharing_rare(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components of which one is ``outside``, among them all that are linked.

    ``left`` has rep, n, component and outside, a row for each document. All shingles stand in one order, the rarest first.
    From the first one that two linked documents share, both have as many left as they need in common; so a document asks by
    its rarest shingles alone, and those that no other document has ask for nothing. The rows grow with the documents'
    shingles, whatever the size of a mass: what most of its documents have in common is not rare.
    """
    spread = _wanted(sets, left).join(left, "rep").select(*left.columns, F.explode("tokens").alias("token"))
    shared = spread.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rest = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("df"), F.desc("token")))     # from here to the last
    asked = settle(spread.join(shared, "token").withColumn("rest", rest).where(100 * F.col("rest") >= percent * F.col("n")).drop("df"))
    other = asked.select("token", *[F.col(c).alias(f"{c}_b") for c in ("rest", "rep", "n", "component")])
    enough = (100 + percent) * F.least("rest", "rest_b") >= percent * (F.col("n") + F.col("n_b"))
    return asked.where("outside").join(other, "token").where((F.col("component") != F.col("component_b")) & enough).select(
        F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b")).distinct()


def _mass_groups(mass: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Components over ``links`` and all links inside the masses (node, tree, size, weight, rep, n).

    In the first tree every document of a mass is compared with its own block of it, in the job that confirms ``links``, as
    both read the sets through one exchange. Masses that are not one component by then are left to their rarest shingles.
    """
    blocks = _blocks(F.col("size"), F.col("weight"))
    own = mass.where("tree = 0").select("node", _dealt(blocks).alias("i"), F.lit(0).alias("j"), "rep", "n", F.col("rep").alias("component"))
    groups = settle(components(settle(links.unionByName(_in_cells(own, sets, percent)).distinct())))
    held, main = _unfinished(mass, groups)
    if main.isEmpty():
        return groups
    outside = F.col("component") != F.col("main.component")
    left = settle(held.join(main.select("node", "main"), "node").groupBy("rep", "n", "component").agg(F.max(outside).alias("outside")))
    pairs = settle(_sharing_rare(left, sets, percent))
    if pairs.isEmpty():
        return groups
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    more = settle(_confirmed(pairs, _wanted(sets, ends), percent))
    return groups if more.isEmpty() else _joined(groups, more)


def near_groups(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80, trees: int = TREES,
    one_each: bool = False
) -> DataFrame:
    """All rows and columns of ``docs`` with n_shingles, component_id and kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; two texts are linked if their sets of
    ``width``-word shingles have a Jaccard similarity of at least ``percent`` / 100. component_id is the smallest key
    reachable over links, the own key included; kept marks the row whose key that is. A null or empty text has no
    shingles and stays alone. A null key forms no part of a component_id unless nothing else is in the group; equal
    rows are all kept or all dropped. With ``one_each``, kept marks one (key, text) per group even if keys are null or
    shared: the smallest by key, nulls last, then by hash of key and text. An empty table gives an empty table; columns with these names are replaced.
    """
    added = ("n_shingles", "component_id", "kept")
    base = docs.select(*[c for c in docs.columns if c not in added or c in (text, key)])
    keyed = base.withColumn(_ROW, F.xxhash64(F.col(key).cast("string"), F.col(text)))
    source = keyed.select(F.col(_ROW), F.col(text).alias(_TEXT))
    described = settle(
        source.mapInArrow(_describe(width, trees),
                          "row long, n long, name_a long, name_b long, levels array<int>, roots array<long>"))
    # one representative per set; its minima go through the shuffle once per set and task
    reps = settle(described.where("n > 0").groupBy("name_a", "name_b").agg(
        F.min("row").alias("rep"), F.first("n").alias("n"), F.first("levels").alias("levels"),
        F.first("roots").alias("roots")))
    coded = reps.withColumn("code", _code(trees))
    rows = coded.select("rep", "n", "code", F.posexplode("roots").alias("branch", "at")).select(
        F.xxhash64("branch", "at").alias("node"), F.floor(F.col("branch") / BRANCH).cast("int").alias("tree"),
        F.lit(None).cast("long").alias("above"), "rep", "n", "code")
    pieces, masses = [], []
    for depth in range(DEPTH + 1):
        sizes = rows.groupBy("node").agg(
            F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min("above").alias("above"))
        placed = settle(rows.drop("above").join(sizes.where("size > 1"), "node"))
        pieces.append(placed.where(F.col("size") <= SMALL).select("node", "rep", "n", "code"))
        large = placed.where(F.col("size") > SMALL)
        mass = (F.col("size") > DENSE * F.col("above")) if depth < DEPTH else F.lit(True)
        mass = F.coalesce(mass, F.lit(False))
        masses.append(large.where(mass).select("node", "tree", "size", "weight", "rep", "n"))
        open_ = large.where(~mass)
        if open_.isEmpty():
            break
        chosen = [_chosen(j) for j in range(BRANCH)]
        rows = open_.join(reps.select("rep", _level(depth + 1, trees).alias("level")), "rep").select(
            F.explode(F.array_distinct(F.array(*chosen))).alias("node"), "tree", F.col("size").alias("above"), "rep", "n", "code")

    small = pieces[0]
    for piece in pieces[1:]:
        small = small.unionByName(piece)
    other = small.select("node", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("code").alias("code_b"))
    fits = (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")) & (_quick(trees) >= _agreeing(trees, percent))
    pairs = settle(small.join(other, "node").where((F.col("rep") < F.col("b")) & fits).select(
        F.col("rep").alias("a"), "b").distinct())
    mass = masses[0]
    for piece in masses[1:]:
        mass = mass.unionByName(piece)
    mass = settle(mass)
    wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).unionByName(
        mass.select("rep")).distinct()
    # always a merge join: the key list grows with the input, and so the plan is the same at every size
    texts = source.withColumnRenamed(_ROW, "rep").join(wanted.hint("merge"), "rep").dropDuplicates(["rep"])
    sets = settle(texts.mapInArrow(_sets(width), "rep long, tokens array<long>"))
    links = _confirmed(pairs, sets, percent)
    if mass.isEmpty():
        groups = components(settle(links.distinct()))
    else:
        groups = _mass_groups(mass, sets, links, percent)

    named = described.select("row", "n", "name_a", "name_b").join(
        reps.select("name_a", "name_b", "rep"), ["name_a", "name_b"], "left").select("row", "n", "rep").distinct()
    labelled = named.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "row", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "row").alias("__group"))
    out = settle(keyed.select(_ROW, F.col(key).alias("__key")).join(
        labelled.withColumnRenamed("row", _ROW), _ROW))
    # stored before the join, so that a hot group of the other side can be split
    firsts = [F.min(F.struct(F.col("__key").isNull(), F.col("__key"), F.col(_ROW)))[_ROW].alias("__first")] * one_each
    least = settle(out.groupBy("__group").agg(F.min("__key").alias("component_id"), *firsts))
    kept = F.col(_ROW) == F.col("__first") if one_each else F.col("__key").eqNullSafe(F.col("component_id"))
    final = out.join(least, "__group").select(F.col(_ROW), "n_shingles", "component_id", kept.alias("kept"))
    return keyed.join(final.dropDuplicates([_ROW]), _ROW).drop(_ROW)
